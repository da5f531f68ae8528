import corpus_pipeline
from driftleaf.llm import mixing, near_dedup
from driftleaf.session import materialise


def test_stages(spark, sf, documents):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, sf), "stage")
        seen.append(out)
        if name != "pack":
            assert out.columns == documents.columns
            docs = out
    languages, unique, mixed, packed = seen
    assert languages.where("lang is null or text is null").count() == 0
    assert languages.count() >= 0.8 * documents.count()
    kept = {r["doc_id"] for r in near_dedup.op8_near_dedup(languages).where("kept").collect()}
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(kept)
    want = {}
    for r in mixing.op4_mixing(unique).collect():
        if r["taken"]:
            want[r["doc_id"]] = r["taken"] // r["size"]
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert packed.where("piece = 0").count() == sum(want.values())


def test_odd_and_empty_tables(spark, sf, docs, no_docs):
    for table in (docs, no_docs):
        current = table
        for name, stage in corpus_pipeline.STAGES:
            current = materialise(stage(spark, current, sf), "stage")
            if name != "pack":
                assert current.columns == table.columns
    twice = docs.where("doc_id = 7 or doc_id is null")
    assert corpus_pipeline.without_near_duplicates(spark, twice, sf).count() == 2


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_near_duplicates_by_shuffle(spark, sf, documents, small_broadcast):
    kept = corpus_pipeline.without_near_duplicates(spark, documents, sf)
    want = near_dedup.op8_near_dedup(documents).where("kept")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in want.collect())


def test_one_document_of_a_group_whose_ids_are_null_or_repeated(spark, sf):
    def text(start, change=None):
        words = [f"w{start + i}" for i in range(60)]
        if change:
            words[30] = change
        return " ".join(words)

    rows = [
        (None, text(0)), (None, text(0, "other")),  # near copies, no id: one stays
        (3, text(100)), (None, text(100, "other")),  # document 3 stays
        (5, text(200)), (5, text(200, "other")), (5, text(200)),  # one id, near copies: one stays
        (6, text(300)), (6, text(400)),  # one id, two groups: both stay
        (7, text(400, "other")),  # goes with the second document 6
        (6, text(100, "again")),  # goes with document 3
        (8, text(500)), (8, text(500).upper()),  # one class, two texts
        (9, ""), (9, ""), (9, None), (None, None), (None, None),  # no group: equal rows once
    ]
    table = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    out = corpus_pipeline.without_near_duplicates(spark, table, sf)
    assert out.columns == table.columns
    stay = [r["row"] for r in out.collect()]
    groups = [{0, 1}, {2}, {4, 5, 6}, {7}, {8}, {11, 12}, {13, 14}, {15}, {16, 17}]
    assert [len(g & set(stay)) for g in groups] == [1] * len(groups)
    assert len(stay) == len(groups)
