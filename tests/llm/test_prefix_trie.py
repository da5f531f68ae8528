import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from driftleaf.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, x long, leaves string"


def brute(rows):
    own = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            said = hashlib.md5((r.text or "").encode()).hexdigest()
            order = (r.turn is not None, r.turn or 0, (r.role or "").encode(), said)
            own[r.conv_id].append((order, (r.role or "", r.text or "")))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(str(c))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        bytes_ = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += bytes_
    return {
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), children.get(n, 0), leaves[n], saved[n],
         hashlib.sha256(",".join(ends.get(n, [])).encode()).hexdigest())
        for n in members
    }


def result(df, **options):
    rows = [tuple(r) for r in prefix_trie.prefix_trie(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(3)
    rows = []
    for c in range(60):
        for turn in range(draw.randrange(12)):
            same = draw.random() < 0.8
            text = draw.choice(["hello", "", None, "é" * 5]) if not same else f"common {turn}"
            rows.append((c, turn, ["user", "assistant", None][turn % 3], text))
    rows += [(c, t, "user", f"common {t}") for c in range(100, 140) for t in range(6)]
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "user", "again")]
    rows += [(None, 1, "user", "no conversation"), (1000, 0, "user", "long " * 50_000), (23, 0, None, None)]
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 20}, {"shard_rows": 1, "band": 2}, {"shard_rows": 5, "band": 1}])
def test_equals_brute_force(odd, options):
    assert result(odd, **options) == brute(odd.collect())


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    found = {tuple(r) for r in prefix_trie.op13_prefix_trie(table).collect()}
    assert found == brute(table.collect())


def test_without_shipping_and_with_tiny_blocks(odd, small_broadcast, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 1)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    assert result(odd, shard_rows=10, band=3) == brute(odd.collect())


def test_long_conversation_spans_blocks_and_bands(spark):
    rows = [(5, t, "user", f"turn {t}", 0, 0, "") for t in range(9000)]
    rows += [(6, t, "user", f"turn {t}" if t < 8000 else "other", 0, 0, "") for t in range(8100)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_trie(table, shard_rows=500).collect()}
    root = got[5, 0]
    shared = sum(len(f"turn {t}") for t in range(8000))
    assert len(got) == 1 + 9000 + 100
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (2, 1, 2, shared)
    assert (got[5, 4000].n_leaves, got[5, 8000].n_children, got[6, 8001].parent_conv_id) == (2, 2, 5)


def test_empty_table(spark, odd):
    assert result(odd.where("false")) == set()


def test_queue_spills(monkeypatch):
    draw = random.Random(1)
    queue = prefix_trie.SpillingQueue(limit=10)
    keys = sorted({(-draw.randrange(9), draw.randrange(20), draw.randrange(3)) for _ in range(200)})
    want = defaultdict(lambda: [0, 0])
    sent = [(*draw.choice(keys), draw.randrange(5), draw.randrange(100)) for _ in range(2000)]
    for message in sent:
        queue.push(message)
        want[message[:3]][0] += message[3]
        want[message[:3]][1] += message[4]
    assert queue.spilled > 50
    for key in keys:
        assert list(queue.take(key)) == want[key]
    assert len(queue) == 0
