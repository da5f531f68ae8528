from driftleaf.llm import packing
from driftleaf.llm.tasks import small_batches


def test_texts_reach_the_encoder_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(packing, "tokenize", lambda docs, *a: docs)
    monkeypatch.setattr(packing, "materialise", lambda df, name: seen.append(spark.conf.get(key)) or df)
    packing.cut(spark.range(1).selectExpr("id AS doc_id", "'a' AS text"), vocabulary="v", pattern="p")
    assert seen == ["512"] and spark.conf.get(key) == before
    with small_batches(spark):
        sizes = spark.range(0, 3000, 1, 1).mapInArrow(lambda bs: (b for b in bs), "id long")
        assert sizes.count() == 3000
