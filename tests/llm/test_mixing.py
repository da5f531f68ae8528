from collections import defaultdict

from driftleaf.llm.mixing import mix, mixed_documents, op4_mixing


def words(text):
    return len((text or "").encode().split())


def water_fill(sizes):
    """Targets by repeated sharing, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, left, capped = {}, 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        goal = {s: 2.0 * sizes[s] for s in capped} | {s: (left - sum(2.0 * sizes[c] for c in capped)) * weight[s] / total for s in free}
        over = {s for s in free if goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        capped |= over


def check(table, rows):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    source = defaultdict(list)
    for r in table.collect():
        source[(r["doc_id"], words(r["text"]))].append(r["source"])
        sizes[r["source"]] += words(r["text"])
    goal = water_fill(sizes)
    assert len(rows) == table.count()
    for r in rows:
        s = source[(r["doc_id"], r["size"])][0]
        assert r["source_size"] == sizes[s]
        assert abs(r["target"] - goal[s]) <= 1e-6 * max(1, goal[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s]


def test_table(documents):
    rows = op4_mixing(documents).collect()
    check(documents, rows)
    assert sorted(map(str, rows)) == sorted(map(str, op4_mixing(documents.repartition(7)).collect()))


def test_odd_rows(spark, docs, no_docs):
    out = mix(docs)
    again = mixed_documents(docs)
    assert again.columns == docs.columns
    words_taken = sum(words(r["text"]) for r in again.collect())
    assert words_taken == out.agg({"taken": "sum"}).first()[0]
    assert out.select("size").where("size < 0").count() == 0
    got = {r["doc_id"]: r["size"] for r in out.collect()}
    assert got == {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    assert op4_mixing(no_docs).count() == 0
    blank = docs.where("doc_id in (3, 4, 5)")
    assert {(r["size"], r["target"], r["taken"]) for r in op4_mixing(blank).collect()} == {(0, 0.0, 0)}


def test_many_sources_and_a_hot_one(spark):
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(1 + i % 17)), None, "hot" if i % 3 else f"s{i % 50}", 0, "", "") for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, taken string, label string")
    check(table, op4_mixing(table).collect())


def test_rows_without_ids_are_parted(spark):
    rows = [(None, f"{s} {i} " + "w " * 18, s) for s in "abc" for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source_size"]: 0 for r in op4_mixing(table).collect()}
    taken = op4_mixing(table).groupBy("target").sum("taken").collect()
    assert list(got) == [6000] and len(taken) == 3
    for row in taken:
        assert abs(row["sum(taken)"] - row["target"]) <= 20
