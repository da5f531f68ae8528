import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from driftleaf.llm.packing import cut, cut_pieces, op2_packing, pack, plan_packing


def check_plan(counts, capacity):
    plan = plan_packing(counts, capacity)
    bins = defaultdict(list)
    for length, _, count, first, offset in plan.tolist():
        for b in range(first, first + count):
            bins[b].append((offset, length))
    placed = defaultdict(int)
    for length, number, count, _, _ in plan.tolist():
        assert number == placed[length]
        placed[length] += count
    assert dict(placed) == {k: v for k, v in counts.items() if v}
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity + 2 for _, n in held) <= 2
    return len(bins)


def test_plans_are_gapless_and_close_to_the_bound():
    rng = random.Random(3)
    for capacity in (7, 30, 1024):
        for size in (1, 5, 60, 4000):
            counts = defaultdict(int)
            for _ in range(size):
                counts[rng.randint(1, capacity)] += 1
            total = sum(k * v for k, v in counts.items())
            large = sum(v for k, v in counts.items() if 2 * k > capacity)
            assert check_plan(dict(counts), capacity) <= max(-(-total // capacity), large) * 1.1 + 1
    assert check_plan({}, 10) == 0
    assert check_plan({4: 5, 6: 5}, 10) == 5
    assert check_plan({1: 100}, 10) == 10
    assert check_plan({1024: 10**6, 3: 10**6, 700: 1, 324: 10}, 1024) > 0


def test_pieces():
    assert cut_pieces(3, 4) == [(0, 3)]
    assert cut_pieces(8, 4) == [(0, 4), (4, 4)]
    assert cut_pieces(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_query_against_the_tokenizer_file(spark, documents, docs, no_docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spelled = [(1, "a <|endoftext|>b  <|endoftext|>"), (2, "<|endoftext|>"), (3, "<|endoftext| >  \n")]
    for table in (documents, docs, spark.createDataFrame(spelled, "doc_id long, text string")):
        want = []
        for r in table.select("doc_id", "text").collect():
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            for piece, (start, n) in enumerate(cut_pieces(len(ids), 1024)):
                want.append((r["doc_id"], piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
        rows = op2_packing(table).collect()
        key = lambda x: tuple((v is None, v) for v in x)
        assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in rows), key=key) == sorted(want, key=key)
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for held in bins.values():
            held.sort()
            assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
            assert sum(n for _, n in held) <= 1024
    assert op2_packing(no_docs).count() == 0


def test_real_sequences_hold_the_ids(docs):
    rows = pack(docs).collect()
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert cut(docs).where("piece = 0").count() == docs.count()


def test_long_white_space_is_encoded_with_the_tokenizer_file(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["\n" * 2_000_000, "a <|endoftext|>b" + " " * 1_500_000 + "c <|endoftext|>", "short"]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for doc_id, text in enumerate(texts):
        pieces = sorted((r["piece"], r["ids"]) for r in rows if r["doc_id"] == doc_id)
        ids = [i for _, piece in pieces for i in piece]
        assert ids == t.encode(text, add_special_tokens=False).ids + [2]
