"""Language identification as multilingual mixture inference.

Every language is a smoothed distribution over hashed character trigrams, counted over all learning documents. A document
is a mixture: expectation-maximisation estimates the share of each language from the likelihoods of its trigrams. The
language set is chosen by penalised likelihood: starting from all languages, the one with the smallest share leaves as
long as the Bayesian information criterion improves. The language with the largest share in the chosen set is predicted.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.words import bounded_batches, by_block, column, tokens
from emberline.storage import materialize

BUCKETS = 1 << 15
STEPS = 10
MINOR = 0.02
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}]+")
UNKNOWN = "und"
BLOCK = 1 << 20


def trigrams(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the hashed letter trigrams of each text, sorted, and whether each text has a letter.

    Words are lower-cased runs of letters with a blank on either side. Distinct tokens are cut into trigrams once.
    """
    vocab, codes, ends = tokens(texts)
    n, v = len(ends) - 1, len(vocab)
    parts = [NOT_LETTERS.sub(" ", t.lower()).strip() for t in vocab]
    letters = np.array([bool(p) for p in parts], bool)
    size = np.array([len(p) for p in parts], np.int64)  # a word of n letters has n trigrams with its two blanks
    chars = np.frombuffer("".join(f" {p} " for p in parts).encode("utf-32-le"), np.uint32).astype(np.uint64) if v else np.zeros(0, np.uint64)
    start = np.cumsum(size + 2) - size - 2
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    grams = ((chars[at] * np.uint64(0x9E3779B1) + chars[at + 1]) * np.uint64(0x85EBCA77) + chars[at + 2]) if len(at) else np.zeros(0, np.uint64)
    grams = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
    # Tokens per text first, then their trigrams: repeated tokens are expanded once.
    text = np.repeat(np.arange(n), np.diff(ends))
    pair, times = np.unique(text * max(v, 1) + codes, return_counts=True)
    text, code = pair // max(v, 1), pair % max(v, 1)
    has = np.zeros(n, bool)
    has[text[letters[code]]] = True
    first = np.cumsum(size) - size
    reps = size[code] if v else np.zeros(0, np.int64)
    back = np.cumsum(reps) - reps
    flat = grams[np.repeat(first[code] - back, reps) + np.arange(reps.sum())] if v else grams
    key = np.repeat(text, reps) * buckets + flat
    weight = np.repeat(times, reps)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.add.reduceat(weight, cut) if len(cut) else np.zeros(0, np.int64)
    return key[cut] // buckets, key[cut] % buckets, count, has


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def add(t: pa.Table) -> None:
            langs = np.array(column(t, "lang").to_pylist(), object)
            text, bucket, count, _ = trigrams(column(t, "text"), buckets)
            for lang in set(langs):
                on = (langs == lang)[text]
                total[lang] = total.get(lang, 0) + np.bincount(bucket[on], count[on], buckets)

        for _ in by_block(batches, BLOCK, add):
            pass
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at].astype(np.int64))],
                                             names=["lang", "bucket", "n"])
    return run


def learn(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Trigram counts (lang, bucket, n) of all documents with a text and a language, combined per task before the shuffle."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    parts = src.mapInArrow(_counts(buckets), "lang string, bucket long, n long")
    return materialize(parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")


def _em(text: np.ndarray, count: np.ndarray, like: np.ndarray, n: int, allowed: np.ndarray, steps: int):
    """Shares (texts x languages) and log-likelihood of the mixture restricted to the allowed languages.

    ``text`` is sorted. Where one language is allowed there is nothing to iterate.
    """
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    ll = np.zeros(n)
    if not len(text):
        return share, ll
    steps = steps if (allowed.sum(axis=1) > 1).any() else 0
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    who, reps = text[starts], np.diff(np.append(starts, len(text)))
    total, open_ = np.add.reduceat(count, starts)[:, None], allowed[who]
    now = share[who]
    for step in range(steps + 1):
        joint = np.repeat(now, reps, axis=0)
        joint *= like
        p = joint.sum(axis=1)
        if step == steps:
            break
        joint *= (count / p)[:, None]
        now = np.where(open_, np.maximum(np.add.reduceat(joint, starts, axis=0) / total, 1e-6), 0.0)
        now /= now.sum(axis=1, keepdims=True)
    share[who], ll[who] = now, np.add.reduceat(count * np.log(p), starts)
    return share, ll


def mixture(text: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int, prob: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Shares of the chosen language set of each text; rows of texts without a trigram are 0.

    A set of k languages has k - 1 free shares. Sets shrink from all languages: first all those below ``MINOR`` go together
    if the criterion allows, then one after the other.
    """
    like = prob[bucket]
    size = np.bincount(text, count, n)
    allowed = np.ones((n, prob.shape[1]), bool)
    share, ll = _em(text, count, like, n, allowed, steps)
    open_, first = size > 0, True
    while open_.any():
        trial = allowed.copy()
        rows = np.flatnonzero(open_ & (allowed.sum(axis=1) > 1))
        if first:
            trial[rows] &= (share[rows] >= MINOR) | (share[rows] == share[rows].max(axis=1, keepdims=True))
        else:
            trial[rows, np.where(allowed, share, np.inf).argmin(axis=1)[rows]] = False
        on = np.zeros(n, bool)
        for single in (True, False):  # texts left with one language need no iterations
            on[:] = False
            on[rows] = (trial[rows].sum(axis=1) == 1) == single
            pick = on[text]
            new, new_ll = _em(text[pick], count[pick], like[pick], n, np.where(on[:, None], trial, False), steps)
            better = on & (2 * (ll - new_ll) <= (allowed.sum(axis=1) - trial.sum(axis=1)) * np.log(np.maximum(size, 2)))
            allowed[better], share[better], ll[better] = trial[better], new[better], new_ll[better]
            open_ &= better | ~on
        open_ &= allowed.sum(axis=1) > 1
        if first:  # whatever the joint step gave, single steps follow
            open_, first = (size > 0) & (allowed.sum(axis=1) > 1), False
    share[size == 0] = 0.0
    return share


def predict(docs: DataFrame, counts: DataFrame, buckets: int = BUCKETS, steps: int = STEPS, keep: list[Column | str] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns, lang_pred, score (share of that language), langs (the chosen set, largest share first).

    ``counts`` has at most ``buckets`` rows per language and is sent to all tasks. A null text and a text without a letter
    give ``und`` and score 0, as does everything when nothing was learnt. Ties go to the first language by name. Every row
    is answered, also repeated and null ids; only the text is an input.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = sorted(r[0] for r in counts.select("lang").distinct().collect())
    prob = np.full((buckets, len(names)), 0.5)
    for r in counts.select("lang", "bucket", "n").toLocalIterator():
        prob[r[1], names.index(r[0])] += r[2]
    prob = prob / prob.sum(axis=0) if names else prob
    sent = spark.sparkContext.broadcast((names, prob))
    src = docs.select("doc_id", *keep, "text")
    fields = [f for f in src.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, langs string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prob = sent.value

        def answer(t: pa.Table) -> pa.RecordBatch:
            n = t.num_rows
            text, bucket, count, has = trigrams(column(t, "text"), buckets)
            has = has & bool(names)
            share = mixture(text, bucket, count, n, prob, steps) if names else np.zeros((n, 1))
            best = share.argmax(axis=1)
            langs = [",".join(names[k] for k in np.argsort(-s, kind="stable") if s[k] > 0) if h else "" for s, h in zip(share, has)]
            cols = [column(t, f.name) for f in fields]
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array([names[b] if h else UNKNOWN for b, h in zip(best, has)], pa.string()),
                 pa.array(np.where(has, np.clip(share[np.arange(n), best], 0, 1), 0.0)), pa.array(langs, pa.string())],
                names=[f.name for f in fields] + ["lang_pred", "score", "langs"])

        yield from by_block(batches, BLOCK, answer)

    return src.mapInArrow(run, schema)


def identified(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents that are in some language, with all their columns; texts without a letter are rejected.

    What is rejected is what ``predict`` answers with ``und``. The rows pass through the same task, whatever their columns.
    """
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: i for i, c in reversed(list(enumerate(names)))}
    text = F.col(f"c{at['text']}")
    tagged = safe.select(F.col(f"c{at['doc_id']}").alias("doc_id"), text.alias("text"), F.struct(*safe.columns).alias("row"))
    kept = predict(tagged, counts, keep=["row"]).filter(F.col("lang_pred") != UNKNOWN)
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
