"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one blank, and n-grams of ``ORDERS`` characters are
hashed to ``2**bits`` features. Document frequencies count every training document over its whole
text. The classifier is fitted on a sample of at most ``per_label`` training documents of each label
(chosen by hash) with follow-the-regularised-leader updates and elastic-net penalties; a fifth of the
sample is kept back to fit one temperature. Prediction reads every whole text.

Fixed bounds: ``per_label`` sampled documents a label and ``max_labels`` labels; with more labels
``fit`` raises an error. Counting sends at most ``2**bits`` numbers to the driver.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; rows whose label is null
are not learned from; a null ``doc_id`` hashes as the empty string; without any label everything is
``und``; repeated rows are learned and predicted like others; other columns are kept by ``predict``,
and replaced where ``lang_pred`` or ``score`` clash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftleaf.llm.tasks import tidy
from driftleaf.session import materialise, ship_package

UNKNOWN = "und"
ORDERS, BITS = (1, 2, 3), 15
PER_LABEL, MAX_LABELS = 1000, 256


@dataclass(frozen=True)
class Options:
    bits: int = BITS
    per_label: int = PER_LABEL
    max_labels: int = MAX_LABELS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    rounds: int = 3


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    bits: int


@functools.cache
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_codes(text: str, bits: int, window: int = 1 << 20) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams, in windows of the text; empty if it has no letter. What a gram needs
    from the windows before is carried over, so the size of a window changes nothing."""
    low = text.lower()
    carried, fresh = np.zeros(0, np.uint32), np.zeros(1, np.uint32)
    for at in range(0, len(low), window):
        points = np.frombuffer(low[at : at + window].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(letters()[points], points, 0).astype(np.uint32)
        before = np.concatenate((fresh[-1:] if len(fresh) else carried[-1:], points))
        points = points[(before[1:] != 0) | (before[:-1] != 0)]
        fresh = np.concatenate((fresh, points))
        last = at + window >= len(low)
        if not fresh.any() and not len(carried):
            continue
        if last and len(fresh) and fresh[-1]:
            fresh = np.append(fresh, np.uint32(0))
        elif last and not len(fresh) and carried[-1]:
            fresh = np.zeros(1, np.uint32)
        yield from _grams(carried, fresh, bits)
        carried = np.concatenate((carried, fresh))[-(max(ORDERS) - 1) :]
        fresh = np.zeros(0, np.uint32)


def _grams(carried: np.ndarray, fresh: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The n-grams that end in ``fresh``, which follows ``carried``."""
    points = np.concatenate((carried, fresh))
    rolled = np.zeros(len(points), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        rolled = rolled[: len(points) - order + 1] * np.uint32(0x01000193) + points[order - 1 :]
        if order in ORDERS:
            code = (rolled[max(0, len(carried) - order + 1) :] + np.uint32(order)) * np.uint32(0x9E3779B1)
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77)
            yield (code >> np.uint32(32 - bits)).astype(np.int64)


def gram_counts(text: str | None, bits: int) -> np.ndarray | None:
    counts = None
    for codes in gram_codes(text or "", bits):
        more = np.bincount(codes, minlength=1 << bits)
        counts = more if counts is None else counts + more
    return counts


def features(text: str | None, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and values, of length 1; None without letters."""
    counts = gram_counts(text, bits)
    if counts is None:
        return None
    index = np.flatnonzero(counts)
    values = (1 + np.log(counts[index])) * idf[index]
    length = math.sqrt(float(values @ values))
    return index, (values / length if length else values)


def held_out() -> Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 4 == 2


def document_frequencies(documents: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """How many documents hold each feature, and how many have any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, documents_here = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                mark = np.zeros(1 << bits, bool)
                for codes in gram_codes(text.as_py() or "", bits):
                    mark[codes] = True
                seen += mark
                documents_here += bool(mark.any())
        index = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(index, -1)), pa.array(np.append(seen[index], documents_here))],
            names=["feature", "n"],
        )

    rows = documents.select("text").mapInArrow(tidy(work), "feature long, n long")
    table = rows.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most 2**bits + 1 rows
    index, n = table.column(0).to_numpy(), table.column(1).to_numpy()
    counts = np.zeros(1 << bits, np.int64)
    counts[index[index >= 0]] = n[index >= 0]
    return counts, int(n[index < 0].sum())


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, size: int, o: Options) -> np.ndarray:
    """Weights (labels x size) after ``rounds`` passes of follow-the-regularised-leader updates."""
    z, n = np.zeros((labels, size)), np.zeros((labels, size))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - o.l1, 0)
        return -shrunk / ((o.beta + np.sqrt(ni)) / o.alpha + o.l2)

    for _ in range(o.rounds):
        for index, values, label in rows:
            zi, ni = z[:, index], n[:, index]
            w = weights(zi, ni)
            miss = softmax(w @ values)
            miss[label] -= 1
            g = miss[:, None] * values
            n[:, index] = ni + g * g
            z[:, index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / o.alpha * w
    return weights(z, n)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the smallest log loss, by golden section over its logarithm."""
    if not len(scores):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / math.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]).mean())

    low, high, golden = -4.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(training: DataFrame, options: Options = Options()) -> Model:
    """Learns from ``text`` and ``lang`` of every row given."""
    spark = training.sparkSession
    ship_package(spark)
    training = training.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    labels = training.groupBy("lang").count().limit(options.max_labels + 1).collect()
    if len(labels) > options.max_labels:
        raise ValueError(f"more than {options.max_labels} labels")
    counts, documents = document_frequencies(training, options.bits)
    idf = np.log((1 + documents) / (1 + counts)) + 1
    names = sorted(r["lang"] for r in labels)
    if not names:
        return Model([], idf, np.zeros((0, 1 << options.bits), np.float32), 1.0, options.bits)
    shared = spark.sparkContext.broadcast(idf)

    def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), shared.value, options.bits) for t in batch.column(2)]
            good = [i for i, r in enumerate(rows) if r is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(good, pa.int64())),
                    batch.column(1).take(pa.array(good, pa.int64())),
                    pa.array([rows[i][0].astype(np.int32) for i in good], pa.list_(pa.int32())),
                    pa.array([rows[i][1].astype(np.float32) for i in good], pa.list_(pa.float32())),
                ],
                names=["lang", "draw", "index", "value"],
            )

    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("language"))
    share = {r["lang"]: min(1.0, 1.5 * options.per_label / r["count"]) for r in labels}
    cut = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    drawn = training.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 40)) < cut * (1 << 40))
    order = Window.partitionBy("lang").orderBy("draw")
    sampled = (
        drawn.select("lang", "draw", "text")
        .mapInArrow(tidy(sample_features), "lang string, draw long, index array<int>, value array<float>")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= options.per_label)
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, spare = [], []
        for batch in batches:
            for lang, place, index, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                row = (index.values.to_numpy(), value.values.to_numpy().astype(float), names.index(lang))
                (spare if place % 5 == 0 else rows).append(row)
        w = fit_ftrl(rows, len(names), 1 << options.bits, options)
        scores = np.array([w[:, i] @ v for i, v, _ in spare]).reshape(-1, len(names))
        heat = fit_temperature(scores, np.array([y for _, _, y in spare], int))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([heat])], names=["weights", "heat"])

    ordered = sampled.select("lang", "place", "index", "value", "draw").repartition(1).sortWithinPartitions("draw", "lang", "place")
    got = ordered.select("lang", "place", "index", "value").mapInArrow(tidy(train), "weights binary, heat double").first()
    weights = np.frombuffer(got["weights"], np.float32).reshape(len(names), -1)
    return Model(names, idf, weights, got["heat"], options.bits)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with lang_pred and score, the calibrated probability of the prediction."""
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by bits and max_labels
    kept = documents.drop("lang_pred", "score")
    at = kept.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = np.ascontiguousarray(m.weights.T)
        for batch in batches:
            said, sure = [], []
            for text in batch.column(at):
                row = features(text.as_py(), m.idf, m.bits) if m.labels else None
                if row is None:
                    said.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                p = softmax((row[1] @ table[row[0]]) / m.temperature)
                best = int(p.argmax())
                said.append(m.labels[best])
                sure.append(float(p[best]))
            yield batch.append_column("lang_pred", pa.array(said, pa.string())).append_column("score", pa.array(sure, pa.float64()))

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(tidy(work), schema)


def op6_language(documents: DataFrame) -> DataFrame:
    model = fit(documents.where(~held_out()))
    rows = documents.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
