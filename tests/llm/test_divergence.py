import re
from collections import Counter, defaultdict

import pytest

from driftleaf.llm import divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, item long, value string, rank string"


def brute(rows, least=30, top=50):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for row in rows:
        lang, source = row.lang or "", row.source or ""
        groups.add((lang, source))
        words = WORD.findall((row.text or "").translate(LOWER))
        counts[lang, source].update(words)
        in_docs[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        peers = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in peers}
        q = shares(sum((counts[lang, s] for s in peers), Counter()))
        for s in peers:
            far = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in peers if o != s]
            told = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", far, None), ("term", told, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(found[:most])}
    return out


def result(df):
    rows = [tuple(r) for r in divergence.op11_source_divergence(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(documents):
    assert result(documents) == brute(documents.collect())


@pytest.fixture(scope="module")
def odd(spark):
    rows = []
    for i in range(90):
        text = ("Éa b'c " * (i % 7) + f"w{'x' * (i % 3)} The ÄB zß").strip()
        rows.append((i, text, "en", f"s{i % 4}" if i % 5 else None))
    rows += [(None, None, None, "z"), (1, "", "en", "silent"), (1, "", "en", "silent"), (2, "12 34 \x00", "de", "only")]
    rows += [(3, "The " * 400_000 + "end", "en", "long")]
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("bucket, held, window", [((1 << 14, 1 << 22), 400_000, 1 << 20), ((1, 3), 2, 5)])
def test_buckets_and_windows_do_not_change_results(odd, monkeypatch, bucket, held, window):
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    monkeypatch.setattr(divergence, "HELD", held)
    text = divergence.terms
    monkeypatch.setattr(divergence, "WINDOW", window)
    assert b"the" in sum(text("The End"), [])
    assert result(odd) == brute(odd.collect())


def test_without_shipping(odd, small_broadcast):
    assert result(odd) == brute(odd.collect())


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).select(
        divergence.share(divergence.F.lit(10**15), divergence.F.lit(3 * 10**15), divergence.F.lit(7)).alias("p")
    )
    assert row.first().p == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 35)


def test_empty_table(no_docs):
    assert result(no_docs) == set()
