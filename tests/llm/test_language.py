import zlib

import numpy as np
import pytest

from driftleaf.llm import language


def test_held_out_accuracy(spark, documents):
    rows = language.op6_language(documents).collect()
    truth = {r["doc_id"]: r for r in documents.collect()}
    assert len(rows) == len(truth)
    right = total = 0
    for r in rows:
        d = truth[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["held_out"]:
            total += 1
            right += r["lang_pred"] == d["lang"]
    assert right >= 0.9 * total


def test_prediction_ignores_other_columns(spark, documents):
    model = language.fit(documents.where(~language.held_out()))
    a = language.predict(documents.select("doc_id", "text"), model)
    b = language.predict(documents.selectExpr("doc_id", "text", "'x' AS lang", "'en' AS lang_pred"), model)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_odd_rows(docs, no_docs):
    got = {r["doc_id"]: r for r in language.op6_language(docs).collect()}
    assert {got[k]["lang_pred"] for k in (3, 4, 5, 9)} == {"und"}
    assert got[6]["lang_pred"] in {"la", "en", "de", "fr"}
    assert language.op6_language(no_docs).count() == 0
    unlabelled = docs.withColumn("lang", language.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.op6_language(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("text", ["Été à la plage 😀, 12 MAI! " * 50, "ΟΔΟΣ ΣΑΣ" * 40, "12 !! " * 60 + "ab", "ab" + " 12" * 70, "é"])
@pytest.mark.parametrize("window", [1, 2, 7, 97])
def test_windows_give_the_same_counts(text, window):
    whole = np.bincount(np.concatenate(list(language.gram_codes(text, 15))), minlength=1 << 15)
    parts = np.bincount(np.concatenate(list(language.gram_codes(text, 15, window))), minlength=1 << 15)
    assert whole.sum() and (whole == parts).all()
    assert not list(language.gram_codes("12 !! " * 30, 15, window))


def test_counts_against_plain_python():
    text = "Été  à 12 la"
    kept = " été à la "
    want = sum(len(kept) - order + 1 for order in language.ORDERS)
    assert len(np.concatenate(list(language.gram_codes(text, 15)))) == want


def test_penalty_makes_weights_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = i % 2
        rows.append((np.array([y, 2 + int(rng.integers(50))]), np.array([0.9, 0.4]), y))
    w = language.fit_ftrl(rows, 2, 60, language.Options(l1=0.5))
    assert (w == 0).any() and w[0, 0] > w[1, 0] and w[1, 1] > w[0, 1]
    y = rng.integers(0, 2, 4000)
    sharp = np.where(rng.random(4000) < 0.75, y, 1 - y)
    scores = np.eye(2)[sharp] * 10
    t = language.fit_temperature(scores, y)
    p = 1 / (1 + np.exp(-10 / t))
    assert abs(p - 0.75) < 0.03
