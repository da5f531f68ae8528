import zlib
from collections import Counter, defaultdict

from driftleaf.llm.sharding import F, assign_shards, jump_shards, op9_sharding


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_published_walk(spark):
    keys = [0, 1, 2, 7, 256, -1, -(1 << 63), (1 << 63) - 1, 0xDEAD10CC, 12345678901234567, None] + list(range(1000, 1400))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for r in df.select("k", jump_shards(F.col("k"), 1, 40, 41, 1000).alias("s")).collect():
        for n in (1, 40, 41, 1000):
            assert r["s"][f"s{n}"] == jump(r["k"] or 0, n), (r["k"], n)


def check(table, rows):
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "key" and 0 <= r["shard"] < 40
        assert r["shard"] == jump(r["doc_id"] or 0, 40) and r["grown_shard"] == jump(r["doc_id"] or 0, 41)
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_query(documents, docs, no_docs):
    for table in (documents, documents.repartition(5), docs):
        check(table, op9_sharding(table).collect())
    assert op9_sharding(no_docs).count() == 0


def test_clashing_columns_and_spread(spark):
    df = spark.range(20_000).selectExpr("id", "'x' AS shard")
    out = assign_shards(df, "id", 40)
    assert out.columns == ["id", "shard", "grown_shard"]
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 40 and max(counts) < 620 and min(counts) > 400
    moved = out.where("shard <> grown_shard").count()
    assert 400 < moved < 580


def test_plan_has_no_python(documents):
    plan = op9_sharding(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
