"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A document's pieces are cut in the tasks. Lengths are at most the capacity, so the table of how many
pieces have each length is bounded by it; the packing is planned on that table and equals a
packing of the single pieces. Pieces above one third of the capacity fit at most twice into a
sequence: the longest is matched with the longest other that still fits. The rest go, longest first,
into the fullest sequence with room, and open new sequences when there is none. The plan maps (length,
number within the length) to (sequence, offset). Pieces are numbered in the task that cut them, and an
offset for each (task, length) follows from counts.

Defined cases: null text is empty and gives the end id alone; repeated rows are packed each; an empty
table gives no row; other columns are ignored. Very long texts are encoded whole; one with a run of white
space that is too long for the fast encoder's pattern is encoded with the tokenizer file. The special tokens of
the vocabulary stand for their ids where a text spells them out, as that file has it.
"""

from __future__ import annotations

import base64
import bisect
import json
import pathlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftleaf.llm.tasks import small_batches, tidy
from driftleaf.session import materialise, ship_package

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length int, ids array<int>, task int, place long"


_encoders: dict = {}  # of a worker, by the vocabulary's path and special tokens
_tokenizers: dict = {}  # of a worker, by the tokenizer file's path


def read_ranks(path: str) -> dict[bytes, int]:
    lines = pathlib.Path(path).read_bytes().splitlines()
    return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def special_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file."""
    added = json.loads(pathlib.Path(path).read_text("utf-8"))["added_tokens"]
    return {token["content"]: token["id"] for token in added}


def default_vocabulary() -> tuple[str, str, dict[str, int], str]:
    """Path of the vocabulary's ranks, its pattern, its special tokens and the path of its tokenizer file."""
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_50k.json")
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special_tokens(file), file


def cut_pieces(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter."""
    head = total % capacity
    starts = ([0] if head else []) + list(range(head, total, capacity))
    stops = starts[1:] + [total]
    return list(zip(starts, [b - a for a, b in zip(starts, stops)]))


def tokenize(
    documents: DataFrame, vocabulary: str, pattern: str, specials: dict[str, int], capacity: int, end_id: int,
    file: str | None = None,
) -> DataFrame:
    """Pieces with their ids, numbered within (task, length). Texts that the ranks' encoder refuses are
    encoded with the tokenizer ``file``; without one they are an error."""
    spark = documents.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))  # a fixed vocabulary
    whole_file = spark.sparkContext.broadcast(pathlib.Path(file).read_text("utf-8")) if file else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        key = vocabulary, *specials
        encoder = _encoders.get(key)
        if encoder is None:
            encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens=specials)
            _encoders[key] = encoder

        def encode(text: str) -> list[int]:
            try:
                return encoder.encode(text, allowed_special="all")
            except ValueError:  # a run of about a million white-space characters exceeds the pattern's stack
                if whole_file is None:
                    raise
            from tokenizers import Tokenizer

            if file not in _tokenizers:
                _tokenizers[file] = Tokenizer.from_str(whole_file.value)
            return _tokenizers[file].encode(text, add_special_tokens=False).ids

        task, places = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            names = [[] for _ in range(5)]
            ids, offsets = [], [0]
            filled = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = encode(text.as_py() or "")
                tokens.append(end_id)
                ids.append(np.array(tokens, np.int32))
                for piece, (start, length) in enumerate(cut_pieces(len(tokens), capacity)):
                    for column, value in zip(names, (doc_id, piece, start, length, places[length])):
                        column.append(value)
                    places[length] += 1
                    filled += length
                    offsets.append(filled)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[0], pa.int64()), pa.array(names[1], pa.int32()),
                    pa.array(names[2], pa.int64()), pa.array(names[3], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                    pa.array([task] * len(names[0]), pa.int32()), pa.array(names[4], pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids", "task", "place"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(work), PIECES)


class Bins:
    """Sequences by free room; runs of equal ones are kept as (first, count)."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.runs: dict[int, list[list[int]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.plan: list[tuple[int, int, int, int, int]] = []

    def put(self, room: int, run: list[int]) -> None:
        if not self.runs[room]:
            bisect.insort(self.rooms, room)
        self.runs[room].append(run)

    def take(self, room: int, most: int) -> list[int]:
        run = self.runs[room][-1]
        got = [run[0], min(most, run[1])]
        run[0] += got[1]
        run[1] -= got[1]
        if not run[1]:
            self.runs[room].pop()
            if not self.runs[room]:
                self.rooms.remove(room)
        return got

    def place(self, length: int, number: int, run: list[int], room: int) -> None:
        """Pieces ``number ..`` of this length go to the run, behind what it holds."""
        self.plan.append((length, number, run[1], run[0], self.capacity - room))

    def open(self, count: int) -> list[int]:
        run = [self.opened, count]
        self.opened += count
        return run


def match_large(bins: Bins, counts: dict[int, int], given: dict[int, int]) -> None:
    """Pair the longest piece with the longest other that fits beside it."""
    third = bins.capacity // 3
    left = {n: c for n, c in counts.items() if n > third and c}
    order = sorted(left)
    while order:
        first = order[-1]
        at = bisect.bisect_right(order, bins.capacity - first) - 1
        if at < 0:
            groups, second = left[first], 0
        else:
            second = order[at]
            groups = left[first] // 2 if second == first else min(left[first], left[second])
            if not groups:  # one piece of this length is left: the next shorter one joins it
                second = order[at - 1] if at else 0
                groups = 1
        run = bins.open(groups)
        room = bins.capacity
        for n in (first, second) if second else (first,):
            bins.place(n, given[n], run, room)
            given[n] += groups
            left[n] -= groups
            room -= n
            if not left[n]:
                order.remove(n)
        if room:
            bins.put(room, run)


def best_fit_small(bins: Bins, counts: dict[int, int], given: dict[int, int]) -> None:
    """Longest first into the fullest sequence with room; equal pieces fill one before the next."""
    third = bins.capacity // 3
    for n in sorted((n for n, c in counts.items() if n <= third and c), reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(bins.rooms, n)
            found = at < len(bins.rooms)
            room = bins.rooms[at] if found else bins.capacity
            times = min(room // n, left)
            run = bins.take(room, left // times) if found else bins.open(left // times)
            for i in range(times):
                bins.place(n, given[n], run, room - i * n)
                given[n] += run[1]
            left -= times * run[1]
            if room > times * n:
                bins.put(room - times * n, run)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first number, count, first sequence, offset), by length and number."""
    bins, given = Bins(capacity), defaultdict(int)
    match_large(bins, counts, given)
    best_fit_small(bins, counts, given)
    return np.array(sorted(bins.plan), np.int64).reshape(-1, 5)


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with task, length and place; other columns are kept."""
    spark = pieces.sparkSession
    sizes = materialise(pieces.groupBy("task", "length").count(), "piece_counts")
    totals = sizes.groupBy("length").agg(F.sum("count")).collect()  # at most ``capacity`` rows
    plan = plan_packing({r[0]: r[1] for r in totals}, capacity)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, first, _, sequence, offset in plan.tolist():
        runs[length].append((first, sequence, offset))
    known = spark.createDataFrame(  # its size depends on the capacity alone
        list(runs.items()), "length int, _runs array<struct<first: long, sequence: long, offset: long>>"
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    kept = [c for c in pieces.columns if c not in ("task", "place")]
    number = F.col("base") + F.col("place")
    last = F.element_at(F.filter("_runs", lambda run: run["first"] <= number), -1)
    placed = pieces.join(bases, ["task", "length"]).join(F.broadcast(known), "length").withColumn("_run", last)
    return placed.select(
        *kept,
        (F.col("_run.sequence") + number - F.col("_run.first")).alias("sequence_id"),
        F.col("_run.offset").alias("offset"),
    )


def cut(
    documents: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    pattern: str | None = None,
    specials: dict[str, int] | None = None,
    file: str | None = None,
) -> DataFrame:
    """The written pieces (doc_id, piece, start, length, ids, task, place)."""
    if vocabulary is None:
        vocabulary, pattern, specials, file = default_vocabulary()
    with small_batches(documents.sparkSession):
        return materialise(tokenize(documents, vocabulary, pattern, specials or {}, capacity, end_id, file), "pieces")


def pack(documents: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset), one row a piece."""
    return place_pieces(cut(documents, capacity, **options), capacity)


@F.pandas_udf(T.LongType())
def ids_crc32(ids: pd.Series) -> pd.Series:
    """Checksum of the ids as little-endian unsigned 32-bit numbers."""
    return ids.map(lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes()))


def op2_packing(documents: DataFrame) -> DataFrame:
    """``pack`` with a checksum in place of the ids; they are not carried through its join."""
    pieces = cut(documents)
    narrow = pieces.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
        ids_crc32("ids").alias("ids_crc32"), "task", "place",
    )
    return place_pieces(narrow, CAPACITY)
