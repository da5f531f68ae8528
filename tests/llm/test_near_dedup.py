import random
import re
from collections import Counter

import numpy as np
import pytest

from driftleaf.llm import near_dedup
from driftleaf.llm.shingles import seeds, shingle_set, signature, word_hashes

SCHEMA = "doc_id long, text string, kept string, component_id string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    """(doc_id, n, component, kept) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return Counter(out)


def run(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op8_near_dedup(df).collect())


def test_table(documents):
    assert run(documents) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_rows(spark, docs, no_docs):
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert near_dedup.op8_near_dedup(no_docs).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e", "", ""), (None, "a b c d e", "", ""), (3, "A b  c\td e", "", "")], SCHEMA)
    assert run(nulls) == Counter({(None, 2, 3, False): 2, (3, 2, 3, True): 1})


@pytest.fixture(scope="module")
def chains():
    """Texts that drift from a few bases, so that components are chains and hubs at the threshold."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for b in range(4):
        base = [word() for _ in range(rng.choice((12, 60, 150)))]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("blocks", [False, True])
def test_chains_and_hubs(spark, chains, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(near_dedup.candidate_links, "__defaults__", (7,))
        monkeypatch.setattr(near_dedup.confirmed_links, "__defaults__", (9000,))
    df = spark.createDataFrame([(*r, "", "") for r in chains], SCHEMA)
    assert run(df) == brute(chains)


def test_components_of_paths(spark):
    path = [(bytes([0, i]), bytes([0, i + 1])) for i in range(60)] + [(b"z", b"zz"), (b"q", b"q")]
    got = near_dedup.components(spark.createDataFrame(path, "a binary, b binary")).collect()
    assert {(bytes(r["class"]), bytes(r["root"])) for r in got} == {(bytes([0, i]), b"\0\0") for i in range(1, 61)} | {(b"zz", b"z")}


def test_words_match_the_pattern():
    text = "Ab\tcd  É\x0bx" + "y" * 50 + " Ab"
    h = word_hashes(text)
    assert len(h) == 5 and h[0] == h[-1] and len(set(h.tolist())) == 4
    assert (word_hashes("aa bb " * 900, window=64) == word_hashes("aa bb " * 900)).all()
    assert len(word_hashes("")) == 0


def test_signatures_estimate_similarity():
    a = shingle_set(" ".join(f"a{i}" for i in range(3000)), 4)
    b = shingle_set(" ".join(f"a{i}" for i in range(330, 3330)), 4)
    turns = seeds(2000, 7)
    share = np.mean(signature(a, turns) == signature(b, turns))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(share - true) < 0.04
