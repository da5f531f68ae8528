import glob
import os

from driftleaf.llm.warc import F, canonical_url, op5_revisits, resolve_revisits
from driftleaf.session import work_root

SCHEMA = "record_id long, kind string, url string, ts long, status int, headers map<string,string>, payload string, outcome string"
DAY = 86_400


def resolve(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r["record_id"]: r for r in resolve_revisits(df, **options).collect()}


def test_latest_earlier_response_over_spans(spark):
    tag = {"ETag": '"a"', "Content-Type": "text/html", "X": "old"}
    rows = [
        (1, "response", "http://WWW.a.com:80/p?b=2&a=1", 10, 200, tag, "one"),
        (2, "response", "https://a.com/p?a=1&b=2#f", 5 * DAY, 200, tag | {"ETag": '"b"'}, "two"),
        (3, "response", "https://a.com/p?a=1&b=2", 20, 404, tag, "gone"),
        (4, "response", "https://a.com/p?a=1&b=2", None, 200, tag, "when"),
        (10, "revisit", "http://a.com/p?a=1&b=2", 3 * DAY, 304, {"etag": 'W/"a"', "content-type": "x", "x": "new"}, None),
        (11, "revisit", "http://a.com/p?a=1&b=2", 5 * DAY, 304, {"etag": '"a"'}, None),
        (12, "revisit", "http://a.com/p?a=1&b=2", 9 * DAY, 304, {"etag": '"a"'}, None),
        (13, "revisit", "http://a.com/p?a=1&b=2", 10, 304, None, None),
        (14, "revisit", "http://a.com/p?a=1&b=2", None, 304, None, None),
        (15, "revisit", None, 50, 304, {}, None),
        (16, "revisit", "http://a.com/p?a=1&b=2", 30, 304, None, None),
    ]
    for span in (DAY, 1, 10**9):
        got = resolve(spark, rows, span_seconds=span)
        assert {k: r["outcome"] for k, r in got.items()} == {
            10: "resolved", 11: "resolved", 12: "mismatch", 13: "orphan", 14: "no_time", 15: "orphan", 16: "unvalidated",
        }
        assert got[10]["payload"] == "one" and got[10]["headers"] == {"etag": 'W/"a"', "content-type": "text/html", "x": "new"}
        assert (got[11]["response_id"], got[12]["response_id"], got[12]["payload"]) == (1, 2, None)


def test_ties_repeats_and_dates(spark):
    rows = [
        (1, "response", "a/x", 5, 200, {"Last-Modified": "d"}, "one"), (2, "response", "a/x", 5, 200, {"Last-Modified": "d"}, "two"),
        (3, "revisit", "a/x", 6, 304, {"last-modified": "d"}, None), (3, "revisit", "a/x", 6, 304, {"last-modified": "e"}, None),
    ]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = sorted((r["outcome"], r["response_id"]) for r in resolve_revisits(df).collect())
    assert got == [("mismatch", 2), ("resolved", 2)]
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_canonical_urls(spark):
    urls = ["HTTP://User@WWW.Ex.com:443", "ex.com/", "https://ex.com/?#x", "ex.com/A?z=1&&b", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(canonical_url(F.col("u"))).collect()] == ["ex.com/", "ex.com/", "ex.com/", "ex.com/A?b&z=1", None, "/"]


def test_query_without_html(spark):
    pages = spark.createDataFrame([(0, "http://a/b", None), (1, None, "x"), (4, "http://a/b", "y")], "page_id long, url string, html string")
    rows = op5_revisits(pages).collect()
    assert len(rows) == 5 and op5_revisits(pages.limit(0)).count() == 0


def test_one_url_with_all_records_of_one_day_is_spread(spark):
    """Bursts at few times, copies of one revisit, and revisits without a time."""
    rows = [(i, "response", "a/x", 60 * (i % 40), 200, {"ETag": f'"{i}"'}, f"p{i}") for i in range(2000)]
    rows += [(5000 + i, "revisit", "a/x", 60 * (i % 40) + i % 2, 304, {"etag": '"no"'}, None) for i in range(2000)]
    rows += [(9000, "revisit", "a/x", 1230, 304, {}, None)] * 500 + [(9001, "revisit", "a/x", None, 304, {}, None)] * 500
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(5)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # would put this small table into one range
    spark.conf.set(coalesce, "false")
    try:
        answers = resolve_revisits(df).select("record_id", "outcome", "response_id").collect()
    finally:
        spark.conf.unset(coalesce)
    want = []
    for n, kind, _, ts, *_ in rows:
        if kind == "revisit":
            earlier = [(r[3], r[0]) for r in rows[:2000] if ts is not None and r[3] < ts]
            outcome = "no_time" if ts is None else "orphan" if not earlier else "unvalidated" if n == 9000 else "mismatch"
            want.append((n, outcome, max(earlier)[1] if earlier else None))
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, answers)) == order(want)
    pieces = spark.read.parquet(sorted(glob.glob(f"{work_root(spark)}/driftleaf-pieces-*"), key=os.path.getmtime)[-1])
    sizes = [r["count"] for r in pieces.groupBy("place", "piece").count().collect()]
    assert pieces.count() == 4500 and max(sizes) < 1500
