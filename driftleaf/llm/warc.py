"""Resolving not-modified revisit records of web archives.

A revisit of the profile "server not modified" holds the headers of a 304 answer and no body. It is
joined as of its time to the latest earlier full response of the same canonical URL; validators are
compared; the response's headers, updated by the permitted ones of the 304, and its payload then
stand for the revisit.

The join cuts each URL's time line into spans of ``span_seconds``, and spans into pieces where a range of
all records (by URL, time and id) ends: the latest response is found inside the piece, and one row a piece
carries the latest of all pieces before it. Ranges hold about as many records each, so a URL that holds
a large share of the records is spread over tasks, even if they all have one time. Revisits without a time
are not joined.

Outcomes: ``resolved`` (entity tags agree by weak comparison, or there is no tag on one side and the
modification dates agree), ``unvalidated`` (nothing to compare), ``mismatch`` (they differ; nothing is
merged), ``orphan`` (no earlier response), ``no_time`` (null time).

Defined cases: a null URL matches other null URLs only; responses of another status than 200 or
without a time never serve; of responses at one time the largest id counts, and a response at the
revisit's own time is not earlier; null headers are none, header names are compared in lower case;
repeated rows resolve each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.session import materialise

# Header fields of a 304 answer that never replace stored ones.
KEPT_FROM_RESPONSE = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer",
    "transfer-encoding", "upgrade",
)

MAP = "map<string,string>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, user and default port, path, sorted query; no scheme, no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(host, "^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(
        host,
        F.when(path == "", "/").otherwise(path),
        F.when(ordered == "", "").otherwise(F.concat(F.lit("?"), ordered)),
    )


def lower_headers(headers: Column) -> Column:
    """Names in lower case; of names that then agree the last in the order of names counts."""
    entries = F.transform(
        F.array_sort(F.map_entries(headers)),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]),
    )
    return F.coalesce(F.map_from_entries(last), F.create_map().cast(MAP))


def merge_headers(stored: Column, newer: Column) -> Column:
    permitted = F.map_filter(newer, lambda k, v: ~k.isin(*KEPT_FROM_RESPONSE))
    untouched = F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k))
    return F.map_concat(untouched, permitted)


def validators(stored: Column, newer: Column) -> Column:
    """The outcome for a revisit that has an earlier response."""
    tag = lambda h: F.regexp_replace(F.trim(h["etag"]), "^W/", "")
    has = lambda h, name: F.map_contains_key(h, F.lit(name))
    by_tag = has(stored, "etag") & has(newer, "etag")
    by_date = has(stored, "last-modified") & has(newer, "last-modified")
    agree = lambda same: F.when(same, "resolved").otherwise("mismatch")
    return (
        F.when(by_tag, agree(tag(stored) == tag(newer)))
        .when(by_date, agree(F.trim(stored["last-modified"]) == F.trim(newer["last-modified"])))
        .otherwise("unvalidated")
    )


def resolve_revisits(records: DataFrame, span_seconds: int = 86_400) -> DataFrame:
    """(record_id, outcome, response_id, payload, headers) of each revisit in (record_id, kind, url,
    ts, status, headers, payload), where ``payload`` is a reference such as a digest or an offset."""
    rows = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("place"),
        F.col("ts").cast("long").alias("ts"),
        (F.col("kind") == "response").alias("full"),
        lower_headers(F.col("headers")).alias("headers"),
        "payload", "status", "kind",
    )
    serves = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull()
    asks = F.col("kind") == "revisit"
    response = F.struct(F.col("ts"), F.col("record_id").alias("id"), F.col("payload"), F.col("headers"))
    rows = rows.where(serves | asks).select(
        "place", "ts", "record_id", "full",
        F.floor(F.col("ts") / span_seconds).alias("span"),
        F.when(asks, F.col("headers")).alias("newer"),
        F.when(F.col("full"), response).alias("response"),
    )
    rows = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "records")
    # Partition numbers only mean something for one evaluation, so they are written.
    dealt = rows.where(F.col("ts").isNotNull()).repartitionByRange("place", "ts", "full", "record_id", "number")
    timed = materialise(dealt.withColumn("piece", F.struct("span", F.spark_partition_id().alias("range"))), "pieces")
    inside = Window.partitionBy("place", "piece").orderBy("ts", "full", "record_id")
    near = timed.withColumn("near", F.last("response", ignorenulls=True).over(inside))
    latest = timed.groupBy("place", "piece").agg(
        F.max_by("response", F.when(F.col("full"), F.struct("ts", "record_id"))).alias("latest")
    )
    before = Window.partitionBy("place").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(
        F.col("place").alias("p"), F.col("piece").alias("s"),
        F.last("latest", ignorenulls=True).over(before).alias("far"),
    )
    joined = near.where(~F.col("full")).join(
        carried, F.col("place").eqNullSafe(F.col("p")) & (F.col("piece") == F.col("s")), "left"
    )
    asked = ["record_id", "ts", "newer"]
    nothing = F.lit(None).cast(rows.schema["response"].dataType)
    found = joined.select(*asked, F.coalesce("near", "far").alias("found")).unionByName(
        rows.where(F.col("ts").isNull()).select(*asked, nothing.alias("found"))
    )
    found = found.withColumn(
        "outcome",
        F.when(F.col("ts").isNull(), "no_time")
        .when(F.col("found").isNull(), "orphan")
        .otherwise(validators(F.col("found.headers"), F.col("newer"))),
    )
    usable = F.col("outcome").isin("resolved", "unvalidated")
    return found.select(
        "record_id",
        "outcome",
        F.col("found.id").alias("response_id"),
        F.when(usable, F.col("found.payload")).alias("payload"),
        F.when(usable, merge_headers(F.col("found.headers"), F.col("newer"))).otherwise(F.col("newer")).alias("headers"),
    )


def capture_log(pages: DataFrame) -> DataFrame:
    """Archive records derived from ``pages`` by rule: a full response of every page, a later revisit
    of it under another spelling of its URL, and for every fourth page a revisit before it."""
    n = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    day = F.concat(F.lit("day "), (n % 9).cast("string"))
    text = lambda *pairs: F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in pairs]), lambda k, v: v.isNotNull())
    at = n * 60
    full = text(
        "Content-Type", "text/html", "ETag", F.when(n % 7 != 6, tag), "Last-Modified", F.when(n % 7 != 5, day),
        "Content-Length", F.octet_length("html").cast("string"), "Cache-Control", "max-age=60", "Server", "origin",
    )
    said = text(
        "etag", F.when(n % 3 == 0, F.concat(F.lit("W/"), tag)).when(n % 11 == 4, '"other"'),
        "LAST-MODIFIED", F.when(n % 3 != 2, F.when(n % 13 == 1, "day 99").otherwise(day)),
        "Cache-Control", "max-age=3600", "Content-Length", "0", "Connection", "close",
        "Date", F.concat(F.lit("minute "), n.cast("string")),
    )
    spelled = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    names = ("record_id", "kind", "url", "ts", "status", "headers")
    record = lambda *values: F.struct(*[(v if not isinstance(v, (str, int)) else F.lit(v)).alias(c) for c, v in zip(names, values)])
    kinds = F.array(
        record(n * 3, "response", F.col("url"), at, 200, full),
        record(n * 3 + 1, "revisit", spelled, at + 1 + (n % 5) * 86_400, 304, said),
        record(n * 3 + 2, "revisit", spelled, at - 1, 304, said),
    )
    wanted = F.filter(kinds, lambda k, i: (i < 2) | (n % 4 == 0))
    digest = F.sha2(F.col("html").cast("binary"), 256).alias("payload")
    return pages.select(digest, F.explode(wanted).alias("r")).select(
        "r.*", F.when(F.col("r.kind") == "response", F.col("payload")).alias("payload")
    )


def op5_revisits(pages: DataFrame) -> DataFrame:
    """Every revisit of the capture log; headers as sorted ``name: value`` lines."""
    lines = F.array_sort(
        F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    )
    return resolve_revisits(capture_log(pages)).select(
        "record_id", "outcome", "response_id", F.col("payload").alias("payload_sha256"),
        F.array_join(lines, "\n").alias("headers"),
    )


SQL = r"""
WITH p AS (
  SELECT page_id AS n, url, html, '"' || md5(html) || '"' AS tag, 'day ' || CAST(page_id % 9 AS VARCHAR) AS day,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages
), c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '^www\.', '') AS host,
    regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '')), '&') AS q
  FROM p
), d AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS place FROM c
), responses AS (
  SELECT n * 3 AS id, place, n * 60 AS ts, sha256(html) AS payload,
    CASE WHEN n % 7 <> 6 THEN tag END AS etag, CASE WHEN n % 7 <> 5 THEN day END AS modified, CAST(octet_length(encode(html)) AS VARCHAR) AS size
  FROM d
), asked AS (
  SELECT n, place, day, tag,
    CASE WHEN n % 3 = 0 THEN 'W/' || tag WHEN n % 11 = 4 THEN '"other"' END AS etag,
    CASE WHEN n % 3 <> 2 THEN CASE WHEN n % 13 = 1 THEN 'day 99' ELSE day END END AS modified
  FROM d
), revisits AS (
  SELECT n * 3 + 1 AS record_id, n * 60 + 1 + (n % 5) * 86400 AS ts, * FROM asked
  UNION ALL SELECT n * 3 + 2, n * 60 - 1, * FROM asked WHERE n % 4 = 0
), found AS (
  SELECT v.*, r.id, r.payload, r.etag AS retag, r.modified AS rmodified, r.size,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.id DESC) AS pick
  FROM revisits v LEFT JOIN responses r ON v.place = r.place AND r.ts < v.ts
), judged AS (
  SELECT *, CASE WHEN id IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND retag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = retag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND rmodified IS NOT NULL THEN CASE WHEN modified = rmodified THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unvalidated' END AS outcome
  FROM found WHERE pick = 1
)
SELECT record_id, outcome, id AS response_id,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN payload END AS payload_sha256,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN
    concat_ws(chr(10), 'cache-control: max-age=3600', 'content-length: ' || size, 'content-type: text/html',
      'date: minute ' || CAST(n AS VARCHAR), 'etag: ' || coalesce(etag, retag), 'last-modified: ' || coalesce(modified, rmodified), 'server: origin')
  ELSE concat_ws(chr(10), 'cache-control: max-age=3600', 'connection: close', 'content-length: 0',
      'date: minute ' || CAST(n AS VARCHAR), 'etag: ' || etag, 'last-modified: ' || modified) END AS headers
FROM judged
"""
