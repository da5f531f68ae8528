import re

from driftleaf.llm.licences import BASE, TEMPLATES, build_index, op10_licences, phrase_places, scan_text


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_part(documents, docs, no_docs):
    for table in (documents, docs):
        want = sorted(((r["doc_id"], *brute(r["text"])) for r in table.collect()), key=str)
        rows = op10_licences(table).collect()
        assert sorted(((r["doc_id"], r[1], r[2], r[3], r[4], r[5]) for r in rows), key=str) == want
        for r in rows:
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
            assert 0 <= r["score"] <= 1
    assert op10_licences(no_docs).count() == 0


def test_phrases_that_touch():
    joined = b" mit license mit license x mit license "
    assert phrase_places(joined, b" mit license ") == [0, 2, 5]
    text = "MIT-License, the\nGeneral Public LICENSE; mit licenses; é mit license"
    assert scan_text(text, index_of_nothing())[:5] == brute(text)


def index_of_nothing():
    from driftleaf.llm.licences import Index, template_words

    return Index(template_words(), {}, {})


def test_templates_are_found_with_gaps_and_need_their_phrase(spark):
    filler = "some plain words that stand before and after it " * 20
    rows = [(i, f"{filler}\n# {t.upper()}\n{filler}") for i, (_, _, t) in enumerate(TEMPLATES)]
    mit = TEMPLATES[0][2]
    rows.append((100, filler + mit.replace("obtaining a copy", "getting any copy") + filler))
    rows.append((101, filler + mit.replace("free of charge", "for a charge") + filler))
    rows.append((102, " ".join(reversed(mit.split()))))
    got = {r["doc_id"]: r for r in op10_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(TEMPLATES):
        assert label in got[i]["labels"].split(","), label
        assert got[i]["score"] == 1.0
    assert got[100]["labels"] == "mit" and 0.6 <= got[100]["score"] < 1 and got[100]["base_labels"] == ""
    assert got[101]["labels"] == "" and got[102]["labels"] == ""


def test_index_has_every_template_word(documents):
    index = build_index(documents)
    assert all(w.encode() in index.postings for _, _, t in TEMPLATES for w in t.split())
    assert min(index.idf.values()) >= 0


def test_one_licence_does_not_hide_another(documents):
    index = build_index(documents)
    filler = " words between the parts and of the text " * 5
    text = filler.join(t for _, _, t in TEMPLATES)
    assert scan_text(text, index)[5].split(",") == sorted(label for label, _, _ in TEMPLATES)
    for label, _, t in TEMPLATES:
        assert scan_text(t, index)[5].split(",").count(label) == 1


def test_a_long_text_of_template_words_needs_little_memory(documents):
    import tracemalloc

    index = build_index(documents)
    text = " ".join(w for _, _, t in TEMPLATES for w in t.split()[:-3]) * 8
    text = (text + " the license you may not use of this software ") * 600
    assert len(text) > 5_000_000
    tracemalloc.start()
    found = scan_text(text, index)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert found[0] == len(text.split())
