"""What the language model moves and writes, and the encodings it does so in."""
import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline import storage
from emberline.llm import elias_fano, language_model as lm, queries

SF = "/root/testdata/sf0.01"


def test_chunks_stay_where_they_lie(spark):
    out = lm.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), F.lit(True), chunk_tokens=5000, shard_words=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    own, answers = plan[plan.index("FlatMapCoGroupsInPandas"):].split("Bucketed: true")
    assert "Exchange" not in own and "codes#" in own and answers.count("Exchange") == 1


def test_intermediate_tables_are_smaller_than_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_root", lambda spark: str(tmp_path))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert lm.score(docs, queries.fold(5) != 1).count() == docs.count()
    written = sum(os.path.getsize(os.path.join(folder, f)) for folder, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet"))
    assert written < 0.9 * docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_cleared_scratch_leaves_no_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_root", lambda spark: str(tmp_path / "scratch"))
    monkeypatch.setattr(storage, "_tables", {})
    df = storage.bucketed(spark.range(20), "numbers", 3, "id")
    assert df.count() == 20 and "Exchange" not in df.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert storage.bucketed(spark.range(3), "numbers", 10 ** 9, "id").count() == 3  # more than Spark allows
    names = [t.split("`")[3] for t in storage._tables[spark.sparkContext.applicationId]]
    assert len(names) == 2 and all(spark.catalog.tableExists(n) for n in names)
    storage.clear_scratch(spark)
    assert not any(spark.catalog.tableExists(n) for n in names) and not (tmp_path / "scratch").exists()


@pytest.mark.parametrize("top", [3, 10 ** 6, 2 ** 40])
def test_columns_in_order(top):
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, top, 3000), rng.integers(0, top, 3000)
    assert (lm.order_by(high, low) == np.lexsort((low, high))).all()
    a, b, number = lm.numbered(high, low)
    assert (a[number] == high).all() and (b[number] == low).all() and len(a) == len(set(zip(high.tolist(), low.tolist())))
    assert [len(x) for x in lm.numbered(high[:0], low[:0])] == [0, 0, 0]


def test_sent_numbers_come_back():
    rng = np.random.default_rng(4)
    size = rng.integers(0, 4, 500)
    x = np.concatenate([np.sort(rng.integers(0, 2 ** 40, n)) for n in size])
    assert (lm.summed(lm.steps(x, size), size) == x).all() and (lm.summed(lm.steps(np.sort(x))) == np.sort(x)).all()
    assert len(lm.summed(lm.steps(x[:0], size[:0]), size[:0])) == 0
    for kind in (np.uint8, bool, "<i4", "<i8"):
        assert (lm.expand(lm.squeeze(size.astype(kind)), kind) == size.astype(kind)).all()
    assert len(lm.squeeze(np.arange(4000, dtype="<i8"))) < 8000


@pytest.mark.parametrize("n,top", [(1, 0), (5, 3), (1000, 10 ** 6), (3000, 10 ** 12)])
def test_places_alone_and_whole_sequence_agree(n, top):
    rng = np.random.default_rng(5)
    v = np.sort(rng.integers(0, top + 1, n))
    e = elias_fano.EliasFano(np.frombuffer(elias_fano.encode(v), np.uint8))
    assert (e.seek(np.arange(n)) == v).all() and (e.values == v).all()
    target = np.append(rng.integers(0, top + 2, 400), v)
    begin, end = np.sort(rng.integers(0, n + 1, (2, len(target))), axis=0)
    whole = e.successor(target, begin, end)
    e._many = lambda asked: False
    assert all((a == b).all() for a, b in zip(e.successor(target, begin, end), whole))


def by_hand(texts: list[str], train: list[bool], shards: int) -> pd.DataFrame:
    """The rounds of ``score`` without Spark, several chunks."""
    table = pa.table({"row": pa.array(range(len(texts)), pa.int64()), "train": train, "text": texts})
    rows = pd.concat([b.to_pandas() for b in lm._chunks(iter(table.to_batches(5)))], ignore_index=True)
    asked = pd.concat(list(lm._ask_words(3)(iter([rows]))))
    answers = pd.concat([lm._answer_words(3)(g) for _, g in asked.groupby("shard")])
    distinct, total = (int(answers.loc[answers.chunk.isna(), c].sum()) for c in ("distinct", "total"))
    one = answers[answers.chunk.notna()].assign(kind=1, n_words=0)

    def visit(run, *sent):
        return pd.concat([run(shards, distinct, total)(rows[rows.chunk == c], g) for c, g in pd.concat(sent).groupby("chunk")], ignore_index=True)

    two = pd.concat([lm._answer_pairs(g) for _, g in visit(lm._ask_pairs, one).rename(columns={"size": "size_"}).groupby("shard")])
    two = two.rename(columns={"shard": "n_words", "codes": "ids", "places": "place", "begins": "counts"}).assign(kind=2)
    three = pd.concat([lm._answer_triples(g) for _, g in visit(lm._ask_triples, one, two).groupby("shard")])
    return visit(lm._score, one, two, three.rename(columns={"shard": "n_words", "codes": "ids", "backoffs": "counts"}).assign(kind=3))


def test_spread_contexts_score_alike(monkeypatch):
    """Successors of frequent words lie in all shards; scores do not depend on that, nor on the number of shards."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"W{k}" for k in rng.zipf(1.4, rng.integers(0, 60)) % 300) for _ in range(60)]
    train = [k % 4 != 1 for k in range(60)]
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    got = []
    for hot, shards in ((10 ** 9, 1), (10 ** 9, 4), (20, 4), (0, 5)):
        monkeypatch.setattr(lm, "HOT", hot)
        got.append(by_hand(texts, train, shards).sort_values("row").reset_index(drop=True))
    assert len(got[0]) == 60 and (got[0].score > got[0].bigram_score).mean() > 0.5
    for other in got[1:]:
        pd.testing.assert_frame_equal(got[0], other)
