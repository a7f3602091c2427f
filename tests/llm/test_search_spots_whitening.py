"""Ranked search, spot signatures and whitening against brute force and on awkward rows."""
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import lexical, queries, spotsigs, whitening

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
ODD = [(1, "a  b\n c"), (2, "a b c"), (3, None), (4, ""), (5, LONG), (5, LONG), (5, "the other five"), (None, "a b c"), (None, "x é B"), (7, "### ***"),
       (8, "The MIT License"), (9, "x" * 50_000), (10, "a b c")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("n", "score", "rank", "codes", "range", "guest", "h", "signatures", "item", "own", "w0", "_place", "text_items", "id"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def cut(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_ranks(docs, items, k):
    bags = [(d, Counter(cut(t))) for d, t in docs]
    n, length = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 50 + 50 * b.total() * n // length if length else 0
            s = sum(weight[t] * (10 ** 9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(cut(text)) if t in b)
            scored += [(-s, d is None, d or 0)] if s > 0 else []
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def ranks(df):
    return sorted(str(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("docs_at_once", [3, 2048])
def test_ranks_are_those_of_scoring_all(spark, monkeypatch, docs_at_once):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(25)
    rows, asked = [tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()]
    wide = (1000, " ".join(t for _, t in asked))
    asked.append(wide)
    items = spark.createDataFrame(asked, "item_id long, text string")
    monkeypatch.setattr(lexical, "DOCS_AT_ONCE", docs_at_once)
    assert ranks(lexical.search(docs, items, 7, at_once=10)) == brute_ranks(rows, asked, 7)


def test_masks_left_out_cannot_win(spark):
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(400)] + [(1000 + i, "t1 t2 t3") for i in range(300)]
    items = [(0, "t1 t2 t3 t9"), (1, " ".join(words)), (2, "t0")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert ranks(got) == brute_ranks(docs, items, 10)


def test_search_of_awkward_rows(spark, odd, empty):
    items = [(1, "A b"), (1, "A b"), (1, "mit"), (None, "b x"), (4, None), (5, ""), (6, "nowhere"), (7, LONG), (8, "###")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("y"))
    assert ranks(lexical.search(odd, asked, 3)) == brute_ranks(ODD, list(dict.fromkeys(items)), 3)
    assert lexical.search(empty, asked).count() == 0
    assert lexical.search(odd, asked.limit(0)).count() == 0




def spots(text):
    low = re.sub(r"[\x00-\x20]+", " ", (text or "").lower())
    plain = re.sub(r"[\x00-\x20.,;:!?\"'()\[\]{}¡¿«»“”„’…]+", " ", low).strip(" ") or low.strip(" ")
    common = {w for ws in spotsigs.ANCHORS.values() for w in ws.split()}
    words, after = [], []
    ws = [w for w in plain.split(" ") if w]
    for i, w in enumerate(ws):
        # The last word is content even if it is common: nothing follows it.
        if w in common and i + 1 < len(ws):
            continue
        words.append(w)
        after.append(i == 0 or (i > 0 and ws[i - 1] in common))
    return {tuple(words[i:i + 3]) for i, a in enumerate(after) if a or i == 0}


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_fingerprints_of_edited_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in spotsigs.edited_pairs(docs.repartition(3)).collect()}
    assert len(got) == len(texts)
    prints = {}
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        k = len(t) // 3
        edited = t[:len(t) - k] + after[:k]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(spots(t), spots(edited))) and r.near_next == pytest.approx(alike(spots(t), spots(after)))
        assert r.n_signatures == len(spots(t)) == len(r.fingerprint.split())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_next_rows_at_every_range_size(spark):
    rng = np.random.default_rng(2)
    ids = [int(i) for i in rng.choice(10 ** 6, 300, replace=False)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    falling = sorted(ids, reverse=True)
    want = {i: f"text {j}" for i, j in zip(falling, [*falling[1:], falling[0]])}
    for rows in (1, 7, 1000):
        assert {r.doc_id: r.next_text for r in spotsigs.with_next(docs, range_rows=rows).collect()} == want


def test_fingerprints_of_awkward_rows(spark, odd, empty):
    rows = spotsigs.edited_pairs(odd).collect()
    assert len(rows) == len(ODD) and spotsigs.edited_pairs(empty).count() == 0
    by = {(r.doc_id, r.n_chars): r for r in rows}
    assert by[3, 0].fingerprint == by[4, 0].fingerprint == "" and by[4, 0].near_next == 1.0
    assert by[1, 7].fingerprint == by[2, 5].fingerprint == by[None, 5].fingerprint
    assert sum(r.doc_id is None for r in rows) == 2 and all(0 <= v <= 1 for r in rows for v in (r.near_edited, r.near_next))
    one = spotsigs.edited_pairs(odd.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    for n in (1, 2):
        assert {r.next_text for r in spotsigs.with_next(odd.select("doc_id", "text"), range_rows=n).collect()} == {t for _, t in ODD} - set()


def test_next_rows_follow_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, f"n{i}") for i in range(40)] + [(3, f"r{i}") for i in range(40)] + [(4, "top"), (1, "low")], "doc_id long, text string")
    for n in (1, 5, 100):
        rows = spotsigs.with_next(docs, range_rows=n).collect()
        after = {r.text: r.next_text for r in rows}
        assert len(after) == 82 and len(set(after.values())) == 82
        at, seen = "top", []
        for _ in range(82):
            seen.append(at[0] if at not in ("top", "low") else at)
            at = after[at]
        assert at == "top" and seen == ["top", *["r"] * 40, "low", *["n"] * 40]


def test_search_finds_all_alike_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    base = [f"w{i}" if i % 2 else "the" for i in range(120)]
    near = [(10_000 + k, " ".join(base[:2 * k + 1] + [f"new{k}"] + base[2 * k + 2:])) for k in range(30)] + [(11_000, None), (11_001, " ")]
    docs = docs.unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    sets = {r.doc_id: spots(r.text) for r in docs.collect()}
    asked = [d for d in sets if d % 5 == 0]
    for threshold in (0.8, 0.5):
        want = {(a, b) for a in asked for b in sets if sets[a] and sets[b] and alike(sets[a], sets[b]) >= threshold}
        got = spotsigs.search(docs.filter("doc_id % 5 = 0"), docs, threshold).collect()
        assert {(r.query_id, r.doc_id) for r in got} == want and len(got) == len(want)
        assert all(r.likeness == pytest.approx(alike(sets[r.query_id], sets[r.doc_id])) for r in got)


def spectrum(n, values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("n,k", [(1, 1), (2, 2), (3, 3), (40, 4), (40, 40), (90, 25)])
def test_components_are_the_largest(n, k):
    x = np.random.default_rng(n).standard_normal((5 * n, n)) * np.linspace(1, 9, n)
    v = np.cov(x.T, bias=True).reshape(n, n)
    e, u = whitening.components(v, k)
    assert len(e) == k and np.allclose(e, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-12)
    assert np.abs(v @ u - u * e).max() < 1e-12 * e[0] * n and np.abs(u.T @ u - np.eye(k)).max() < 1e-9


def test_components_with_equal_and_no_variance():
    e, u = whitening.components(spectrum(9, [3, 3, 3, 3, 3, 1, 1, 0, 0]), 4)
    assert np.allclose(e, 3) and np.abs(u.T @ u - np.eye(4)).max() < 1e-12
    assert np.allclose(whitening.components(spectrum(9, [3, 3, 3, 3, 3, 1, 1, 0, 0]), 9)[0], [3] * 5 + [1] * 2)
    assert len(whitening.components(np.zeros((3, 3)), 2)[0]) == 0


def test_close_values_are_told_apart():
    values = [1 + 1e-7, 1, 1 - 1e-7, 0.5, 1e-6, 1e-9]
    e, u = whitening.components(spectrum(6, values), 6)
    assert np.allclose(e, values, rtol=0, atol=1e-14)


def test_inertia_counts():
    values = np.array([5, 4, 4, 1, 0.5, -2])
    counts = whitening.Inertia(spectrum(6, values))
    assert [counts.above(s) for s in (6, 4.5, 3.9, 0.7, 0, -3)] == [0, 1, 3, 4, 5, 6]


def brute_whitened(rows, k=4):
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    e, u = np.linalg.eigh(np.atleast_2d(np.cov(fit.astype(float).T, bias=True)))
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), np.abs((x - s / n).astype(float) @ u[:, :k] / np.sqrt(e[:k])), e[:k] / e.sum()


def test_whitened_rows(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = whitening.whiten(df.repartition(4)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, w, explained = brute_whitened(sorted(rows))
    assert set(got.n) == {n} and list(got.deviation[::4]) == list(deviation)
    assert np.allclose(got.whitened.abs().to_numpy().reshape(-1, 4), w, atol=1e-9)
    assert np.allclose(got.explained.to_numpy()[:4], explained, rtol=1e-10) and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_awkward_rows(spark):
    good = [(1, [0.5, 1.0, 0.0]), (1, [0.5, 1.0, 0.0]), (None, [0.25, -1.0, 2.0]), (3, [1.5, 0.5]), (4, [-0.0, 0.125, 7.0]), (8, [0.0, 0.001, -0.001])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [1.0, float("nan"), 2.0]), (9, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = whitening.whiten(df).collect()
    full = [(i, v + [0.0] * (3 - len(v))) for i, v in good]
    n, deviation, _, _ = brute_whitened(full, 3)
    assert len(got) == len(good) * 3 and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((i, d) for (i, _), d in zip(full, deviation))
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 1")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).count() == 0


def test_deviation_of_large_entries(spark):
    rows = [(i, [float(i) * 1e7, -3.0 * i, 1e6 * (i % 3)]) for i in range(1, 30)] + [(99, [1e30, 0.0, 0.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows[:-1], "vec_id long, embedding array<double>"), 1).collect()}
    n, deviation, _, _ = brute_whitened(rows[:-1], 1)
    assert got == {i: (d if d < 2 ** 63 else None) for (i, _), d in zip(rows, deviation)}
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).count() == 30


def test_queries_give_the_contract_columns(spark):
    want = {"op11_presence_masks": "item_id rank doc_id score", "op12_spot_signatures": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
            "op13_feast_whitening": "vec_id component n deviation whitened explained identity_error"}
    for name, cols in want.items():
        assert queries.QUERIES[name](spark, SF).columns[:len(cols.split())] == cols.split()
