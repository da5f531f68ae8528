"""Licence scan with a positional index of rare words.

1. Document frequencies of the words of all templates are counted over every whole text.
2. In a text, the words of each template with the highest IDF are looked up in the index of template
   postings (word -> template, position); each hit votes for where the template would begin. Rare words
   are chosen for each template, once for all texts, so one licence never hides another.
3. Where enough different words agree on a place, the template is aligned there: the share of its
   words found within a small slack is the score, and its mandatory phrase must stand in the text
   inside the aligned range.

Besides, every place of the base phrases is reported and gives its label with score 1.

Words are runs of letters and digits of ASCII and of all characters beyond, A-Z lower-cased. Defined
cases: null text is empty; a text without words has zero counts, null places, empty labels and
score 0; repeated rows are scanned each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.llm.tasks import tidy
from driftleaf.session import ship_package

# Phrases that always count, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Excerpts of licence texts (label, mandatory phrase, words).
TEMPLATES = [
    ("mit", "free of charge to any person",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "apache license version 2 0",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "gnu general public license",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license",
     "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license",
     "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "released into the public domain",
     "this is free and unencumbered software released into the public domain"),
    ("cc0", "creative commons",
     "to the extent possible under law the author has waived all copyright and related rights to this work under the creative commons cc0 dedication"),
]

RAREST, VOTES, SLACK, COVERAGE = 12, 3, 2, 0.6
_WORD_BYTE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTE).split()


@dataclass
class Index:
    templates: list[tuple[str, bytes, list[bytes]]]
    postings: dict[bytes, list[tuple[int, int]]]
    idf: dict[bytes, float]

    def __post_init__(self) -> None:
        by_idf = lambda w: (-self.idf[w], w)
        self.rarest = [sorted({w for w in words if w in self.idf}, key=by_idf)[:RAREST] for _, _, words in self.templates]
        self.voters = frozenset().union(*self.rarest)


def template_words() -> list[tuple[str, bytes, list[bytes]]]:
    return [(label, b" %s " % phrase.encode(), text.encode().split()) for label, phrase, text in TEMPLATES]


def document_frequencies(documents: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    ship_package(documents.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen[None] += batch.num_rows
            for text in batch.column(0):
                seen.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k and k.decode() for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["word", "n"],
        )

    rows = documents.select("text").mapInArrow(tidy(work), "word string, n long")
    found = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # <= vocabulary
    return {k.encode(): n for k, n in found.items() if k}, found.get(None, 0)


def build_index(documents: DataFrame) -> Index:
    templates = template_words()
    postings = defaultdict(list)
    for t, (_, _, words) in enumerate(templates):
        for at, word in enumerate(words):
            postings[word].append((t, at))
    counts, total = document_frequencies(documents, frozenset(postings))
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in postings}
    return Index(templates, dict(postings), idf)


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers where ``phrase`` begins; both are joined by, and wrapped in, single blanks."""
    places, at, word, counted = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        places.append(word)
        at = joined.find(phrase, at + 1)
    return places


def alignments(words: list[bytes], index: Index) -> Iterator[tuple[int, int]]:
    """(template, place where it would begin) that enough of the template's rare words agree on. Votes are
    numbers in sorted arrays, so that a long text needs memory in proportion to its length."""
    spots: dict[bytes, list[int]] = defaultdict(list)
    for at, word in enumerate(words):
        if word in index.voters:
            spots[word].append(at)
    for template, rare in enumerate(index.rarest):
        present = [(i, word) for i, word in enumerate(rare) if word in spots]
        if len(present) < VOTES:
            continue
        votes = [
            (np.array(spots[word], np.int64) - position) * len(rare) + i
            for i, word in present
            for t, position in index.postings[word]
            if t == template
        ]
        begins, counts = np.unique(np.unique(np.concatenate(votes)) // len(rare), return_counts=True)
        for begin in begins[counts >= VOTES].tolist():
            yield template, begin


def scan_text(text: str | None, index: Index) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)"""
    words = words_of(text)
    joined = b" %s " % b" ".join(words)
    base, score = set(), 0.0
    places: list[int] = []
    for phrase, label in BASE.items():
        found = phrase_places(joined, b" %s " % phrase.encode())
        if found:
            base.add(label)
            places += found
            score = 1.0
    labels = set(base)
    for template, begin in alignments(words, index):
        label, phrase, wanted = index.templates[template]
        low, high = max(0, begin - SLACK), begin + len(wanted) + SLACK
        near = words[low:high]
        hits = sum(w in words[max(0, begin + i - SLACK) : max(0, begin + i + SLACK + 1)] for i, w in enumerate(wanted))
        share = hits / len(wanted)
        if share >= COVERAGE and phrase in b" %s " % b" ".join(near):
            labels.add(label)
            score = max(score, share)
    joined_labels = [",".join(sorted(x)) for x in (base, labels)]
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, *joined_labels, score


OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, ...) one row a document."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(build_index(documents))  # a fixed set of templates

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [part.split()[0] for part in OUT.split(", ")]
        for batch in batches:
            rows = [scan_text(text.as_py(), shared.value) for text in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(work), f"doc_id long, {OUT}")


def op10_licences(documents: DataFrame) -> DataFrame:
    return scan(documents)
