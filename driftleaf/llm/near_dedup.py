"""Near-duplicate documents: MinHash signatures joined by coordinate and value.

1. A document's set of shingles gets a digest and a signature of ``COORDINATES`` values. Documents
   with equal sets form a class; from here on classes are compared, so copies are never paired.
2. Each class is posted under its coordinate-value pairs. Two classes that agree in ``MATCHES`` of
   them share a pair among the rarest ``COORDINATES - MATCHES + 1`` of each, so only this prefix is
   posted, rarest first; pairs that one class alone holds need no posting.
3. In a posting list collisions of signatures are counted, skipping classes that are already
   joined; a list gives a spanning forest of the pairs above the threshold, not all pairs.
4. The connected candidates are confirmed on full sets: inside each group every pair that may reach
   the similarity and is not yet connected is checked, again giving a spanning forest.
5. Connected components of the confirmed links; a document's component is its smallest id.

A pair at the similarity of 0.8 misses the match threshold with a probability of about 1e-6.
Long lists and large groups are cut into blocks and each pair of blocks is a task of bounded size.

Defined cases: null or blank text has an empty set and is linked with nothing; repeated rows and rows
with the same id are one group if their texts agree; null ids take part, and their component is the
smallest id that is not null (null if there is none); an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.llm.shingles import digest, seeds, shingle_set, signature
from driftleaf.llm.tasks import tidy
from driftleaf.session import materialise, ship_package

WORDS, PERCENT = 4, 80
COORDINATES, MATCHES = 32, 14
LIST_ROWS, GROUP_BYTES = 4096, 16 << 20
LINK = "a binary, b binary"


def fingerprints(documents: DataFrame, words: int, coordinates: int) -> DataFrame:
    """(doc_id, class, n_shingles, sig)"""
    ship_package(documents.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = seeds(coordinates, 7)
        for batch in batches:
            names, sizes, sigs = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                names.append(digest(s))
                sizes.append(len(s))
                sigs.append(signature(s, turns).view(np.int32))
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
            ends = pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * coordinates)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                names=["doc_id", "class", "n_shingles", "sig"],
            )

    schema = "doc_id long, class binary, n_shingles long, sig array<int>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(work), schema)


def class_of(text: Column, words: int = WORDS) -> Column:
    """The class of a text, as ``fingerprints`` names it."""

    def work(texts: pa.Array) -> pa.Array:
        return pa.array([digest(shingle_set(t.as_py(), words)) for t in texts], pa.binary())

    work.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(work, "binary")(text)


def block_pairs(blocks: Column, *key: str) -> Column:
    """All pairs of blocks that hold this row's block; one pair if there is one block."""
    own = F.pmod(F.xxhash64(*key), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda o: (o != own) | (blocks == 1))
    return F.transform(others, lambda o: F.least(o, own) * blocks + F.greatest(o, own))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from sorted batches; a group may span batches."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        cuts = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
        if held and rows[0] != last:
            yield pa.concat_tables(held)
            held = []
        at = 0
        for cut in cuts:
            part = table.slice(at, cut - at)
            yield pa.concat_tables([*held, part]) if held else part
            held, at = [], cut
        held.append(table.slice(at))
        last = rows[-1]
    if held:
        yield pa.concat_tables(held)


def forest(count: int, partners: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component of each row. ``partners(i, others)`` gives those of ``others`` linked with i; it is
    asked only about later rows that are not connected with i yet."""
    label = np.arange(count)
    for i in range(count - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if others.size and (linked := partners(i, others)).size:
            joined = np.unique(np.append(label[linked], label[i]))
            label[np.isin(label, joined)] = joined[0]
    return label


def link_batch(names: list[bytes], label: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    rows = np.flatnonzero(label != np.arange(len(label)))
    return [names[i] for i in rows], [names[label[i]] for i in rows]


def batches_of_links(found: Iterator[tuple[list[bytes], list[bytes]]], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for more_a, more_b in found:
        a += more_a
        b += more_b
        if len(a) >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def candidate_links(classes: DataFrame, coordinates: int, matches: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b) of classes: per posting list a spanning forest of the pairs with enough collisions."""
    entry = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = classes.select("class", F.posexplode("sig").alias("at", "value")).select("class", entry.alias("entry"))
    shared = posted.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1")
    rarest = Window.partitionBy("class").orderBy("n", "entry")
    ranked = posted.join(shared, "entry").select(
        "class", "entry", "n",
        F.row_number().over(rarest).alias("place"),
        F.count("*").over(Window.partitionBy("class")).alias("m"),
    )
    prefix = ranked.where(F.col("place") <= F.col("m") - matches + 1)
    lists = (
        prefix.join(classes.select("class", "sig"), "class")
        .withColumn("blocks", F.ceil(F.col("n") / list_rows).cast("int"))
        .select("class", "sig", "entry", F.explode(block_pairs(F.col("blocks"), "class")).alias("pair"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for group in sorted_groups(batches, ["entry", "pair"]):
                if group.num_rows < 2:
                    continue
                sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, coordinates)
                near = lambda i, others: others[(sig[others] == sig[i]).sum(1) >= matches]
                yield link_batch(group.column("class").to_pylist(), forest(len(sig), near))

        return batches_of_links(found())

    return lists.repartition("entry", "pair").sortWithinPartitions("entry", "pair").mapInArrow(tidy(work), LINK)


def confirmed_links(
    documents: DataFrame, groups: DataFrame, words: int, percent: int, coordinates: int, matches: int,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(a, b): in each group of ``groups`` (class, root, first_id, n_shingles) a spanning forest of the
    pairs whose full sets reach the similarity."""

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), words) for text in batch.column(0)]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(digest, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["class", "shingles"],
            )

    firsts = groups.select("first_id").distinct()
    texts = documents.join(firsts, F.col("doc_id").cast("long").eqNullSafe(F.col("first_id")), "left_semi").select("text")
    sets = texts.mapInArrow(tidy(make_sets), "class binary, shingles array<long>")
    sets = sets.groupBy("class").agg(F.first("shingles").alias("shingles"))
    blocks = groups.groupBy("root").agg(F.ceil(F.sum("n_shingles") * 8 / group_bytes).cast("int").alias("blocks"))
    members = (
        groups.select("class", "root").join(blocks, "root").join(sets, "class")
        .select("root", "class", "shingles", F.explode(block_pairs(F.col("blocks"), "class")).alias("pair"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = seeds(coordinates, 7)

        def found():
            for group in sorted_groups(batches, ["root", "pair"]):
                if group.num_rows < 2:
                    continue
                held = group.column("shingles").combine_chunks()
                values = held.flatten().to_numpy().view(np.uint64)
                ends = held.offsets.to_numpy().astype(np.int64)
                ends = ends - ends[0]
                sizes = np.diff(ends)
                known, index = np.unique(values, return_inverse=True)
                sig = np.stack([signature(values[a:b], turns) for a, b in zip(ends, ends[1:])])
                mark = np.zeros(len(known), bool)

                def similar(i: int, others: np.ndarray) -> np.ndarray:
                    small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
                    others = others[(100 * small >= percent * large)]
                    others = others[(sig[others] == sig[i]).sum(1) >= matches]
                    if not others.size:
                        return others
                    own = index[ends[i] : ends[i + 1]]
                    mark[own] = True
                    both = np.array([np.count_nonzero(mark[index[ends[j] : ends[j + 1]]]) for j in others])
                    mark[own] = False
                    return others[100 * both >= percent * (sizes[others] + sizes[i] - both)]

                yield link_batch(group.column("class").to_pylist(), forest(len(sizes), similar))

        return batches_of_links(found())

    return members.repartition("root", "pair").sortWithinPartitions("root", "pair").mapInArrow(tidy(work), LINK)


def components(links: DataFrame) -> DataFrame:
    """(class, root) of every linked class but the roots; root is the smallest class of its component.
    Alternates large-star and small-star rounds until the links are stars. A hub's edges are many: its
    minimum is found from partial minima and written, so that the join that hands it to the edges
    shuffles plain tables, whose large partitions are split."""
    ordered = lambda df: df.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    minima = lambda df: materialise(df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "minima")
    edges = materialise(ordered(links), "edges")
    while True:
        stars = minima(edges)
        roots = edges.select(F.col("b").alias("a")).distinct()
        if stars.where("n > 1").isEmpty() and stars.join(roots, "a", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("class"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = minima(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(ordered(large), "edges")
        least = minima(edges).select("a", "m")
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(ordered(small.unionByName(least.select("a", F.col("m").alias("b")))), "edges")


def near_duplicates(
    documents: DataFrame, words: int = WORDS, percent: int = PERCENT,
    coordinates: int = COORDINATES, matches: int = MATCHES,
) -> DataFrame:
    """(doc_id, class, n_shingles, component_id, root, kept), one row a document; ``root`` tells components
    apart whose ids are null or repeated, and is null for an empty set."""
    documents = documents.select("doc_id", "text")
    prints = materialise(fingerprints(documents, words, coordinates), "prints")
    classes = prints.where("n_shingles > 0").groupBy("class", "sig", "n_shingles").agg(F.min("doc_id").alias("first_id"))
    classes = materialise(classes, "classes")
    chained = components(candidate_links(classes, coordinates, matches))
    roots = chained.select("root").distinct().select(F.col("root").alias("class"), "root")
    groups = materialise(
        classes.drop("sig").join(chained.unionByName(roots), "class"), "groups"
    )
    linked = components(confirmed_links(documents, groups, words, percent, coordinates, matches))
    rooted = groups.select("class", "first_id").join(linked, "class", "left").select(
        "class", "first_id", F.coalesce("root", "class").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    single = classes.select("class", "first_id").join(groups.select("class"), "class", "left_anti")
    named = rooted.join(least, "root").select("class", "component_id", "root").unionByName(
        single.select("class", F.col("first_id").alias("component_id"), F.col("class").alias("root"))
    )
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        prints.drop("sig").join(named, "class", "left")
        .select("doc_id", "class", "n_shingles", component.alias("component_id"), "root")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op8_near_dedup(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select("doc_id", "n_shingles", "component_id", "kept")


#: By comparing full sets of all classes that share a shingle.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS held
  FROM words
), classes AS (
  SELECT min(doc_id) AS class, len(held) AS n, held FROM sets WHERE len(held) > 0 GROUP BY held
), posted AS (
  SELECT class, n, unnest(held) AS shingle FROM classes
), links AS (
  SELECT a.class AS a, b.class AS b FROM posted a JOIN posted b USING (shingle)
  WHERE a.class <> b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT class AS a, class AS b FROM classes
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a AS class, min(b) AS root FROM reached GROUP BY a
)
SELECT s.doc_id, CAST(len(s.held) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id,
  s.doc_id = coalesce(r.root, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON s.held = c.held LEFT JOIN roots r ON c.class = r.class
"""
