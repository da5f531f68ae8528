"""Token counts by a piece model, merged in ragged numpy arrays.

A text gets a leading blank, blanks become the blank mark, and it is cut into pre-tokens before every run of
marks (no piece of a model holds a mark after another character; checked when the model is read). Distinct
pre-tokens of a slice lie end to end in one array of symbols. In every round each sequence's lowest-rank pair
is merged at all its places at once, from the left without overlap, until no sequence has a pair; what is
left is counted: one token a symbol, one a byte for a character that the model lacks. If a merge makes a
pair of the same or a lower rank, which comes before the other places, the round merges only the first place of that sequence.
Sequences of over ``LONG`` symbols take the same rounds by rank on linked arrays, so that a round costs what it
merges rather than the length of the sequence. Counts of pre-tokens are remembered, at most ``KEPT`` at a time.

Defined cases: a null text is empty, an empty text has no tokens; long texts are read whole, in windows that end
before a pre-token; special strings inside texts are ordinary text; null or repeated ids and repeated rows
give a row each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.llm.tasks import tidy
from driftleaf.session import ship_package

MARK = "▁"
PRE_TOKEN = re.compile(" +[^ ]*")
NEXT_PRE_TOKEN = re.compile("(?<=[^ ]) ")
WINDOW = 1 << 20  # characters read at once
SLICE = 1 << 22  # characters whose new pre-tokens are merged together
LONG = 512
KEPT = 1 << 19
NONE = np.iinfo(np.int32).max


class Merges:
    """Symbols and merge table of a piece model; a symbol is a piece or a single character."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = [model.id_to_piece(i) for i in plain]
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
            raise ValueError(f"{path} has pieces that cross the start of a pre-token")
        ranks = np.unique([-model.get_score(i) for i in plain], return_inverse=True)[1]
        letters = sorted(set("".join(pieces)) - set(pieces))
        names = pieces + letters
        at = {name: i for i, name in enumerate(names)}
        lengths = np.repeat(np.arange(1, 5), [0x80, 0x780, 0xF800, 0x100000])
        # Characters that the model lacks: four symbols, by their bytes, that merge with nothing.
        self.of_char = (len(names) + lengths - 1).astype(np.int32)
        for name, i in at.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        self.tokens = np.array([1] * len(pieces) + [len(c.encode()) for c in letters] + [1, 2, 3, 4])
        self.size = len(self.tokens)
        pairs = {}
        for i, piece in enumerate(pieces):
            for cut in range(1, len(piece)):
                left, right = at.get(piece[:cut]), at.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys], np.int32)
        self.ranks = ranks[self.merged].astype(np.int32)
        self.pairs = {k: (int(ranks[i]), i) for k, i in pairs.items()}
        for probe in ("", " ", "a  b ", " \ta▁bé", "</s> x"):
            if self.count([probe])[0] != len(model.encode(probe)):
                raise ValueError(f"{path} normalises texts in another way")

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; rank ``NONE`` where they don't merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words end to end, and the length of each word."""
        points = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), np.uint32)
        return self.of_char[points], np.fromiter(map(len, words), np.int64, len(words))

    def merge(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, word in enumerate(words) if len(word) <= LONG]
        if short:
            out[short] = merge_ragged(self, *self.symbols([words[i] for i in short]))
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = merge_long(self, self.symbols([word])[0])
        return out

    def count(self, texts: list[str], known: dict[str, int] | None = None) -> list[int]:
        """Number of tokens of each whole text; ``known`` remembers pre-tokens."""
        known = {} if known is None else known
        totals, held, size = [0] * len(texts), [], 0

        def settle() -> None:
            new = list(set().union(*(found for _, found in held)) - known.keys())
            if new:
                known.update(zip(new, self.merge(new).tolist()))
            for i, found in held:
                totals[i] += sum(map(known.__getitem__, found))
            held.clear()
            if len(known) > KEPT:
                known.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            text = " " + text.replace(MARK, " ")
            at = 0
            while at < len(text):
                cut = NEXT_PRE_TOKEN.search(text, at + WINDOW)
                stop = cut.start() if cut else len(text)
                held.append((i, PRE_TOKEN.findall(text, at, stop)))
                size += stop - at
                at = stop
                if size >= SLICE:
                    settle()
                    size = 0
        settle()
        return totals


def merge_ragged(table: Merges, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Tokens left in each sequence, by rounds over all sequences at once."""
    out = np.zeros(len(length), np.int64)
    name = np.arange(len(length))
    while len(name):
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        of = np.repeat(np.arange(len(length)), length)
        rank = np.full(len(symbol), NONE, np.int32)
        merged = np.zeros(len(symbol), np.int32)
        inner = np.flatnonzero(of[:-1] == of[1:])
        rank[inner], merged[inner] = table.look_up(symbol[inner], symbol[inner + 1])
        low = np.minimum.reduceat(rank, start)
        done = low == NONE
        if done.any():
            tokens = np.add.reduceat(table.tokens[symbol], start)
            out[name[done]] = tokens[done]
            stay = np.repeat(~done, length)
            symbol, rank, merged = symbol[stay], rank[stay], merged[stay]
            name, length, low = name[~done], length[~done], low[~done]
            if not len(name):
                break
            of = np.repeat(np.arange(len(length)), length)
        place = np.flatnonzero(rank == low[of])
        # From the left, a place that follows a chosen one directly overlaps it.
        run = np.cumsum(np.concatenate(([True], (np.diff(place) > 1) | (np.diff(of[place]) > 0)))) - 1
        first = np.flatnonzero(np.concatenate(([True], np.diff(run) > 0)))
        place = place[(np.arange(len(place)) - first[run]) % 2 == 0]
        bad = np.zeros(len(length), bool)
        bad[of[place[_earlier(table, symbol, merged, of, place, low)]]] = True
        place = place[~bad[of[place]] | np.concatenate(([True], np.diff(of[place]) > 0))]
        symbol = symbol.copy()
        symbol[place] = merged[place]
        symbol = np.delete(symbol, place + 1)
        length = length - np.bincount(of[place], minlength=len(length))
    return out


def _earlier(
    table: Merges, symbol: np.ndarray, merged: np.ndarray, of: np.ndarray, place: np.ndarray, low: np.ndarray
) -> np.ndarray:
    """Where merging ``place`` in order makes a pair that comes before the next place."""
    mine = of[place]
    before, after = place - 1, place + 2
    joins = np.concatenate(([False], (place[1:] == place[:-1] + 2) & (mine[1:] == mine[:-1])))
    left = np.where(joins, merged[np.concatenate(([0], place[:-1]))], symbol[np.maximum(before, 0)])
    has = (before >= 0) & (of[np.maximum(before, 0)] == mine)
    last = len(symbol) - 1
    rank_left = np.where(has, table.look_up(left, merged[place])[0], NONE)
    has = (after <= last) & (of[np.minimum(after, last)] == mine)
    rank_right = np.where(has, table.look_up(merged[place], symbol[np.minimum(after, last)])[0], NONE)
    return np.minimum(rank_left, rank_right) <= low[mine]


def merge_long(table: Merges, symbol: np.ndarray) -> int:
    """Tokens left in one long sequence: rounds by rank over the places that have it."""
    size = len(symbol)
    symbol = symbol.copy()
    back, ahead = np.arange(-1, size - 1), np.arange(1, size + 1)
    rank = np.full(size, NONE, np.int32)  # of the pair that begins here
    merged = np.zeros(size, np.int32)
    waiting: dict[int, list[np.ndarray]] = defaultdict(list)
    order: list[int] = []

    def renew(place: np.ndarray) -> None:
        place = place[(place >= 0) & (ahead[place] < size)]
        rank[place], merged[place] = table.look_up(symbol[place], symbol[ahead[place]])
        place = place[rank[place] < NONE]
        place = place[np.argsort(rank[place], kind="stable")]
        for part in np.split(place, np.flatnonzero(np.diff(rank[place])) + 1):
            if len(part):
                r = int(rank[part[0]])
                if not waiting[r]:
                    heapq.heappush(order, r)
                waiting[r].append(part)

    def apply(place: np.ndarray) -> None:
        """Merge places that don't overlap."""
        gone = ahead[place]
        symbol[place] = merged[place]
        symbol[gone] = -1
        rank[gone] = NONE
        ahead[place] = ahead[gone]
        follows = ahead[place] < size
        back[ahead[place][follows]] = place[follows]
        rank[place] = NONE
        renew(np.unique(np.concatenate((place, back[place]))))

    renew(np.arange(size))
    while order:
        low = heapq.heappop(order)
        place = np.unique(np.concatenate(waiting.pop(low)))
        place = place[rank[place] == low]
        if not len(place):
            continue
        follows = np.concatenate(([False], ahead[place[:-1]] == place[1:]))
        run = np.cumsum(~follows) - 1
        first = np.flatnonzero(~follows)
        place = place[(np.arange(len(place)) - first[run]) % 2 == 0]
        left, right = back[place], ahead[ahead[place]]
        joins = np.concatenate(([False], ahead[ahead[place[:-1]]] == place[1:]))
        before = np.where(joins, merged[np.concatenate(([0], place[:-1]))], symbol[left])
        made = np.minimum(
            np.where(left >= 0, table.look_up(before, merged[place])[0], NONE),
            np.where(right < size, table.look_up(merged[place], symbol[np.minimum(right, size - 1)])[0], NONE),
        )
        if not (made <= low).any():
            apply(place)
        else:
            _leftmost(table, low, symbol, back, ahead, rank, merged, waiting, order, place)
    return int(table.tokens[symbol[symbol >= 0]].sum())


def _leftmost(table, low, symbol, back, ahead, rank, merged, waiting, order, place) -> None:
    """One rank of a long sequence place by place, from the left, for merges that make pairs of the same rank;
    a lower rank ends it, and what is left waits again."""
    size, todo = len(symbol), np.flatnonzero(rank == low).tolist()
    heapq.heapify(todo)

    def wait(r: int, at: list[int]) -> None:
        if not waiting[r]:
            heapq.heappush(order, r)
        waiting[r].append(np.array(at, np.int64))

    while todo:
        at = heapq.heappop(todo)
        if rank[at] != low:
            continue
        gone = ahead[at]
        symbol[at], symbol[gone] = merged[at], -1
        rank[gone], ahead[at] = NONE, ahead[gone]
        if ahead[at] < size:
            back[ahead[at]] = at
        ends = False
        for begin in (back[at], at):
            if begin < 0:
                continue
            rank[begin] = NONE
            if ahead[begin] >= size:
                continue
            key = int(symbol[begin]) * table.size + int(symbol[ahead[begin]])
            new, merged[begin] = table.pairs.get(key, (NONE, 0))
            rank[begin] = new
            if new == low:
                heapq.heappush(todo, int(begin))
            elif new < NONE:
                wait(new, [int(begin)])
                ends |= new < low
        if ends and todo:
            wait(low, todo)
            return


@functools.lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(2)
def known(path: str) -> dict[str, int]:
    return {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row for each row of ``docs``."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = merges(path), known(path)
        for batch in batches:
            counts: list[int] = []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column("_text").slice(at, 256).to_pylist()
                counts += table.count(texts, seen)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text")
    )
    return rows.mapInArrow(tidy(work), "doc_id long, n_bytes long, n_tokens long")


def op12_token_counts(docs: DataFrame, limit: int = 4096) -> DataFrame:
    """Token counts of whole texts by ``piece_bpe_32k.model``."""
    import public_tokenizers

    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
