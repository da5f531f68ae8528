"""How far the sources of a language differ in their words, by row accumulation.

Tasks count the terms of their texts for each (lang, source) and hand on one row a term. Terms in enough documents
of their language are kept. Smoothed shares are whole numbers, ``p = 1 + floor(SCALE * (count + 5) / (N + 5 V))``.

The sum of ``abs(p - q)`` over all kept terms is taken for every pair of groups without a row for each pair of postings:
the postings of a language are dealt by term into buckets, large enough for a bucket's sums to be no more than its
postings and small enough for a task; in a bucket they lie in term order, and each group in turn scatters its terms through them into one dense accumulator with a place for
every peer. A place starts at the value that it would have if no term were shared: against the peer's share of an
absent term for the group's own terms, and the other way round. The scatter corrects the terms that both have. The sums of
the buckets add up.

Defined cases: null text, lang or source is ''; a group without terms counts with zero everywhere; without kept terms
all values are 0; a language with one source has no pairs; ids are not read, so null ids and repeated rows count as
documents; long texts are read whole in windows that end between terms; ties go to the smaller item in UTF-8
order; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.llm.tasks import tidy
from driftleaf.session import broadcast_if_small, materialise, ship_package

SCALE = 1_000_000_000
LEAST_DOCS = 30
TOP_TERMS = 50
BUCKET = (1 << 14, 1 << 22)  # least and most postings of a bucket; between them the pairs of sources decide
HELD = 400_000  # distinct (group, term) that a task holds before it hands them on
WINDOW = 1 << 20

# ASCII letters in lower case and all other characters beyond ASCII stay, the rest separates.
_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, window by window."""
    data = text.encode().translate(_BYTES)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + WINDOW)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            names = list(n)
            size = len(names)
            yield pa.record_batch(
                [
                    pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(names, pa.string()),
                    pa.array([n[t] for t in names], pa.int64()), pa.array([docs[t] for t in names], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    held = 0
    for batch in batches:
        columns = [batch.column(name) for name in ("lang", "source", "text")]
        for i in range(batch.num_rows):
            lang, source, text = (c[i].as_py() for c in columns)
            # The term '' marks that the group occurs.
            n, docs = groups.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            held -= len(n)
            seen: set[bytes] = set()
            for part in terms(text):
                n.update(part)
                seen.update(part)
            docs.update(seen)
            held += len(n)
            if held >= HELD:
                yield from hand_on()
                held = 0
    yield from hand_on()


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, leads): occurrences of each kept term in each group that has it, and in its
    language; ``leads`` marks one row a term. A row with the term '' stands for each group."""
    ship_package(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = read.mapInArrow(tidy(_count), "lang string, source string, term string, n long, docs long")
    group = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return (
        group.withColumn("in_docs", F.sum("docs").over(term))
        .withColumn("lang_n", F.sum("n").over(term))
        .withColumn("leads", (F.min("source").over(term) == F.col("source")) & (F.col("term") != ""))
        .where((F.col("in_docs") >= least_docs) | (F.col("term") == ""))
        .select("lang", "source", "term", "n", "lang_n", "leads")
    )


def group_facts(held: DataFrame) -> DataFrame:
    """(lang, source, total, v, lang_total, p0, buckets), one row a group."""
    group = held.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.sum(F.col("leads").cast("long")).alias("leads"), F.count("*").alias("rows")
    )
    lang = group.groupBy("lang").agg(
        F.sum("leads").alias("v"), F.sum("total").alias("lang_total"), F.sum("rows").alias("rows"), F.count("*").alias("peers")
    )
    size = F.least(F.greatest(F.col("peers") * F.col("peers"), F.lit(BUCKET[0])), F.lit(BUCKET[1]))
    lang = lang.select("lang", "v", "lang_total", F.ceil(F.col("rows") / size).cast("int").alias("buckets"))
    facts = group.select("lang", "source", "total").join(lang, "lang")
    return facts.withColumn("p0", share(F.lit(0), F.col("total"), F.col("v")))


def share(count: Column, total: Column, v: Column) -> Column:
    """The smoothed share as a whole number, exact for any count; 1 without kept terms."""
    wide = lambda c: c.cast("decimal(25,0)")
    parts = F.call_function("div", (wide(count) + 5) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(v) * 5)
    return F.when(v > 0, parts + 1).otherwise(F.lit(1).cast("long"))


PARTIAL = "lang string, source string, item string, value long"


def scatter(own: pa.Table, peers: pa.Table) -> pa.Table:
    """Sums of one bucket of terms for every ordered pair of groups, in two parts that add up."""
    names = peers.column("source").to_pylist()
    at = {name: i for i, name in enumerate(names)}
    zero = peers.column("p0").to_numpy().astype(np.int64)
    terms_ = own.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if len(own) else np.zeros(0, np.int64)
    order = np.argsort(terms_, kind="stable")
    # Term-major postings: those of term t are first[t] to first[t + 1].
    term = terms_[order].astype(np.int64)
    group = np.array([at[s] for s in own.column("source").to_pylist()], np.int64)[order]
    p = own.column("p").to_numpy().astype(np.int64)[order]
    v = int(term[-1]) + 1 if len(term) else 0
    first = np.searchsorted(term, np.arange(v + 1))
    by_group = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[by_group], np.arange(len(names) + 1))
    size = np.diff(begin)

    source: list[np.ndarray] = []
    item: list[np.ndarray] = []
    value: list[np.ndarray] = []
    for g in range(len(names)):
        mine = by_group[begin[g] : begin[g + 1]]
        # Own terms against each peer's share of an absent term, from sorted shares and their running sums.
        shares = np.sort(p[mine])
        sums = np.concatenate(([0], np.cumsum(shares)))
        below = np.searchsorted(shares, zero)
        alone = zero * below - sums[below] + (sums[-1] - sums[below]) - zero * (len(shares) - below)
        # Terms that neither has, counted as if none were shared.
        dense = (v - size[g] - size) * np.abs(zero[g] - zero)
        lengths = first[term[mine] + 1] - first[term[mine]]
        met = np.repeat(first[term[mine]] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        peer, theirs, ours = group[met], p[met], np.repeat(p[mine], lengths)
        gap = np.abs(ours - theirs) - np.abs(ours - zero[peer]) - np.abs(theirs - zero[g]) + np.abs(zero[g] - zero[peer])
        np.add.at(dense, peer, gap)
        others = np.delete(np.arange(len(names)), g)
        here = np.full(len(others), g)
        source += [here, others]
        item += [others, here]
        value += [(alone + dense)[others], alone[others]]
    lang = peers.column("lang")[0].as_py()
    take = lambda parts: pa.array(names, pa.string()).take(pa.array(np.concatenate(parts)))
    out = [take(source), take(item), pa.array(np.concatenate(value), pa.int64())]
    return pa.table([pa.array([lang] * len(out[0]), pa.string()), *out], names=["lang", "source", "item", "value"])


def pair_sums(held: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    ship_package(held.sparkSession)
    known = broadcast_if_small(facts, "group_facts", 256)
    rows = held.where("term != ''").join(known, ["lang", "source"])
    left = rows.select(
        "lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "term", "source",
        share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
    )
    right = facts.select("lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "source", "p0")
    key = ["lang", "bucket"]
    partial = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(scatter, PARTIAL)
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def telling_terms(held: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms more frequent in a group than in its language."""
    known = broadcast_if_small(facts, "group_facts", 256)
    rows = held.where("term != '' AND n > 0").join(known, ["lang", "source"])
    gap = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    return rows.select("lang", "source", F.col("term").alias("item"), gap.alias("value")).where("value > 0")


def op11_source_divergence(docs: DataFrame) -> DataFrame:
    """Ranked peers of every (lang, source), and its most telling terms."""
    held = materialise(postings(docs), "postings")
    facts = materialise(group_facts(held), "group-facts")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    head = ["lang", "source"]
    pairs = pair_sums(held, facts).select(*head, F.lit("pair").alias("part"), "item", "value", rank)
    top = telling_terms(held, facts).select(*head, F.lit("term").alias("part"), "item", "value", rank)
    return pairs.unionByName(top.where(F.col("rank") <= TOP_TERMS))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), words AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
), groups_ AS (SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
  FROM groups_ g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT *, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
    1 + (1000000000 * (lang_n + 5)::HUGEINT) // (sum(lang_n) OVER g + 5 * count(*) OVER g) AS q
  FROM dense WINDOW g AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
  SELECT lang, source, term AS item, (p - q)::BIGINT AS value,
    CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS rank
  FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, rank FROM terms WHERE rank <= 50
"""
