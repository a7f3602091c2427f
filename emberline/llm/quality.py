"""Quality by ordinal regression: one score, ordered thresholds.

A cumulative-link (proportional odds) model: the log-odds that a document's grade is at most k are threshold k minus its
score. The score is a linear function of hashed words, the same for all thresholds; thresholds are a first value plus positive
steps, so they stay ordered. The expected grade and the probability of reaching a grade follow and select documents.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.words import blocks, bounded_batches, column, plain_words, spread, tokens
from emberline.storage import materialize

BUCKETS = 1 << 22
# A word gets a weight when it occurs in at least so many of the fitted documents.
MIN_DOCS = 5
# The model is fitted on at most so many graded documents, those with the smallest hashes, and so many words of them.
TRAIN_ROWS, TRAIN_ENTRIES = 8_000, 6_000_000
EPOCHS, RATE, PENALTY, L1 = 200, 0.1, 2e-4, 5e-4
# Fixed positions of the features that are not words.
SHOUTED, BARE, MARKED, REPEATED = range(4)
SHAPES = 4

USUAL = set(".,;:'\"-()")


def _token_features(token: str, buckets: int) -> list[int]:
    """Hashed words of a token, and what it looks like: all capitals, no letter at all, or unusual marks."""
    out = [SHAPES + xxhash.xxh64_intdigest(w) % (buckets - SHAPES) for w in plain_words(token)]
    if len(token) > 3 and token.isupper():
        out.append(SHOUTED)
    if not any(c.isalpha() for c in token):
        out.append(BARE)
    if any(not c.isalnum() and c not in USUAL for c in token):
        out.append(MARKED)
    return out


def hashed(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), sorted: 1 for every hashed word of the text; for the shapes of tokens and for repetition
    ten times their share of all tokens."""
    vocab, codes, ends = tokens(texts)
    flat, cut = spread(codes, ends, [_token_features(t, buckets) for t in vocab], np.int64)
    n = len(ends) - 1
    text = np.repeat(np.arange(n), np.diff(cut))
    key, times = np.unique(text * buckets + flat, return_counts=True)
    text, feature = key // buckets, key % buckets
    total = np.maximum(np.diff(ends), 1)
    value = np.where(feature < SHAPES, 10.0 * times / total[text], 1.0)
    # Repetition: tokens beyond the first of each kind.
    who = np.repeat(np.arange(n), np.diff(ends))
    distinct = np.bincount(np.unique(who * max(len(vocab), 1) + codes) // max(len(vocab), 1), minlength=n)
    again = 10.0 * (np.diff(ends) - distinct) / total
    rows = np.flatnonzero(again > 0)
    text, feature, value = np.concatenate([text, rows]), np.concatenate([feature, np.full(len(rows), REPEATED)]), np.concatenate([value, again[rows]])
    order = np.lexsort((feature, text))
    return text[order], feature[order], value[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def thresholds(raw: np.ndarray) -> np.ndarray:
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def tail(score: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """P(grade >= 1), ..., P(grade >= levels - 1) per row."""
    return _sigmoid(score[:, None] - thresholds(raw)[None, :])


def fit(text: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, levels: int, epochs: int = EPOCHS,
        min_docs: int = MIN_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features in use, their weights, and raw thresholds, by Adam on the penalised likelihood; rare grades count more."""
    n = len(grade)
    used, docs = np.unique(feature, return_counts=True)
    used = used[(docs >= min_docs) | (used < SHAPES)]
    at = np.minimum(np.searchsorted(used, feature), max(len(used) - 1, 0))
    on = used[at] == feature if len(used) else np.zeros(len(feature), bool)
    text, at, value, k = text[on], at[on], value[on], len(used)
    w, raw = np.zeros(k), np.zeros(levels - 1)
    size = np.bincount(grade, minlength=levels)
    each = np.sqrt(n / levels / np.maximum(size, 1))[grade]
    m, v = np.zeros(k + levels - 1), np.zeros(k + levels - 1)
    rows, shape = np.arange(n), used < SHAPES
    for step in range(1, epochs + 1):
        score = np.bincount(text, w[at] * value, n)
        at_least = np.concatenate([np.ones((n, 1)), tail(score, raw), np.zeros((n, 1))], axis=1)
        slope = at_least * (1 - at_least)
        p = np.maximum(at_least[rows, grade] - at_least[rows, grade + 1], 1e-12)
        low, high = each * slope[rows, grade] / p, each * slope[rows, grade + 1] / p
        g_theta = np.zeros((n, levels + 1))
        g_theta[rows, grade] = low
        g_theta[rows, grade + 1] = -high
        by_theta = g_theta[:, 1:levels].sum(axis=0)
        g_raw = np.array([by_theta.sum(), *[by_theta[j:].sum() * np.exp(raw[j]) for j in range(1, levels - 1)]])
        slope_w = np.bincount(at, (high - low)[text] * value, k) / n + PENALTY * w
        g = np.concatenate([np.where(shape, slope_w, slope_w + L1 * np.sign(w)), g_raw / n])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = RATE * (1 - (step - 1) / epochs)
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        w, raw = w - move[:k], raw - move[k:]
        # A word whose evidence is weaker than the lasso penalty stays at no weight.
        w = np.where(shape | (np.abs(slope_w) > L1) | (np.abs(w) > rate), w, 0.0)
    keep = w != 0
    return used[keep], w[keep], raw


def score(text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, used: np.ndarray, w: np.ndarray) -> np.ndarray:
    if not len(used):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(used, feature), len(used) - 1)
    return np.bincount(text, np.where(used[at] == feature, w[at], 0.0) * value, n)


def train(docs: DataFrame, grades: DataFrame, levels: int, rows: int = TRAIN_ROWS, entries: int = TRAIN_ENTRIES) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The model, or None when fewer than two grades are there. ``grades`` has (doc_id, grade); null grades and ids are not
    used; of several grades of one document the largest counts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    best = grades.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    best = best.select(F.col("doc_id").alias("_id"), "grade").orderBy(F.xxhash64("_id"), "_id").limit(rows)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(best), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "grade"), "graded")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            text, feature, value = hashed(column(t, "text"))
            ends = np.searchsorted(text, np.arange(t.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [column(t, "doc_id"), column(t, "grade"), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.float32)))], names=["doc_id", "grade", "feature", "value"])

    table = sample.mapInArrow(cut, "doc_id long, grade int, feature array<int>, value array<float>").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("feature"))
    features, values, grade, held = [], [], [], 0
    for r in table.toLocalIterator():  # bounded by rows and entries
        if held + len(r.feature) > entries:
            break
        held += len(r.feature)
        features.append(np.array(r.feature, np.int64))
        values.append(np.array(r.value, float))
        grade.append(min(max(r.grade, 0), levels - 1))
    if len(set(grade)) < 2:
        return None
    text = np.repeat(np.arange(len(grade)), [len(f) for f in features])
    return fit(text, np.concatenate(features), np.concatenate(values), np.array(grade), levels)


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, levels: int, select: float = 0.5, keep: list[Column | str] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns, expected_grade, p_top (probability of the highest grade), selected (p_top >= select).

    Null and empty texts have the score 0, so the thresholds alone decide. Without a model expected_grade and p_top are
    null and nothing is rejected. Every row is answered, also repeated and null ids; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select("doc_id", *keep, "text")
    fields = [f for f in src.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", expected_grade double, p_top double, selected boolean"
    sent = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            n = t.num_rows
            if sent.value is None:
                e, p, s = pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), np.ones(n, bool)
            else:
                used, w, raw = sent.value
                text, feature, value = hashed(column(t, "text"))
                probs = tail(score(text, feature, value, n, used, w), raw)
                e, p, s = pa.array(probs.sum(axis=1)), pa.array(probs[:, -1]), probs[:, -1] >= select
            yield pa.RecordBatch.from_arrays([*[column(t, f.name) for f in fields], e, p, pa.array(s)],
                                             names=[f.name for f in fields] + ["expected_grade", "p_top", "selected"])

    return src.mapInArrow(run, schema)
