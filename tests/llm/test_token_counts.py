import random

import public_tokenizers
import pytest
import sentencepiece

from driftleaf.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def table():
    return token_counts.merges(PATH)


ALPHABETS = ["a ", "  ", "ab c▁", "éü日本語의 ", "0123 \n\t", "xyzXYZ aeiou", "the and ing ", "\x00 a", "😀👍 a ", "<s>/ "]


def random_texts(count, size):
    draw = random.Random(5)
    for _ in range(count):
        letters = draw.choice(ALPHABETS) + draw.choice(ALPHABETS)
        yield "".join(draw.choice(letters) for _ in range(draw.randrange(size)))


@pytest.mark.parametrize("long", [token_counts.LONG, 2])
def test_equals_the_library_on_random_texts(table, model, monkeypatch, long):
    monkeypatch.setattr(token_counts, "LONG", long)
    texts = list(random_texts(4000, 60))
    assert table.count(texts) == [len(x) for x in model.encode(texts)]


def test_windows_and_slices_do_not_change_counts(table, model, monkeypatch):
    monkeypatch.setattr(token_counts, "WINDOW", 7)
    monkeypatch.setattr(token_counts, "SLICE", 50)
    monkeypatch.setattr(token_counts, "KEPT", 20)
    texts = list(random_texts(500, 200))
    assert table.count(texts, {}) == [len(x) for x in model.encode(texts)]


@pytest.mark.parametrize("text", [" " * 100_000, "x" * 100_000, "\n" * 100_000, "日本中国" * 20_000, "qJ7zA/k0" * 10_000])
def test_long_pre_tokens(table, model, text):
    assert table.count([text]) == [len(model.encode(text))]


def test_whole_table(spark, documents, model):
    got = {r.doc_id: r for r in token_counts.op12_token_counts(documents).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        text = row.text or ""
        n = len(model.encode(text))
        assert tuple(got[row.doc_id]) == (row.doc_id, len(text.encode()), n, n > 4096)


def test_nulls_long_texts_and_repeated_rows(docs, no_docs, model):
    got = token_counts.op12_token_counts(docs).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect()]
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)
    assert token_counts.op12_token_counts(no_docs).count() == 0
