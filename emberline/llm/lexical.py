"""Ranked lexical search by presence masks.

Every task turns its documents into postings of the asked terms. For each item the documents get a bitmap of the item's
terms they hold; documents with one bitmap form a group, whose highest possible score follows from the bitmap and the largest
weight each term reaches. Groups are scored from the highest possible score down, until no group left can enter the item's
best ``k``. The best of all tasks are merged in two steps, so no task takes more than a share of an item's candidates.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberline.llm.words import blocks, bounded_batches, column, tokens
from emberline.storage import materialize

# Items searched in one pass over the documents, documents judged together, texts tokenised together.
ITEMS_AT_ONCE, DOCS_AT_ONCE, BLOCK_BYTES = 2048, 2048, 2 << 20
# Bits of a mask kept in one double, which holds whole numbers up to 2**53.
MASK_BITS = 52
# Bytes of ASCII that belong to no term become blanks, A to Z are lower-cased, all other bytes stay.
TERM_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct terms, their codes in text order and offsets per text. Null has none."""
    t = texts.cast(pa.large_string()).fill_null("")
    if not len(t):
        return [], np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, offsets, data = t.buffers()
    plain = pa.LargeStringArray.from_buffers(len(t), offsets, pa.py_buffer(data.to_pybytes().translate(TERM_BYTES)) if data else data, offset=t.offset)
    return tokens(plain)


def postings(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """One row per document: doc_id, n (its terms), codes and counts of the vocabulary's terms it holds."""
    ids = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, BLOCK_BYTES):
            vocab, codes, ends = terms(column(b, "text"))
            known = np.fromiter((vocabulary.get(v, -1) for v in vocab), np.int64, len(vocab))
            n = np.diff(ends)
            row, code = np.repeat(np.arange(len(n)), n), known[codes] if len(codes) else codes
            key, tf = np.unique((row * (len(vocabulary) + 1) + code)[code >= 0], return_counts=True)
            row, code = np.divmod(key, len(vocabulary) + 1)
            at = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
            yield pa.record_batch([column(b, "doc_id"), pa.array(n), pa.ListArray.from_arrays(at, pa.array(code, pa.int32())),
                                   pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], ["doc_id", "n", "codes", "counts"])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {ids}, n long, codes array<int>, counts array<long>")


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and the weight of every vocabulary term."""
    documents: int
    length: int
    weight: np.ndarray


def statistics(posted: DataFrame, size: int) -> Corpus:
    """Counts over all documents; a task sends one number a vocabulary term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(size, np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column("codes").flatten().to_numpy(), minlength=size)
            own = b.column("n").to_numpy()
            n, length = n + int((own > 0).sum()), length + int(own.sum())
        yield pa.record_batch([pa.array(np.arange(-2, size, dtype=np.int32)), pa.array(np.concatenate([[n, length], df]))], ["code", "n"])
    found = posted.select("n", "codes").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(size + 2, np.int64)
    for r in found:
        n[r.code + 2] = r.n
    documents = int(n[0])
    return Corpus(documents, int(n[1]), np.array([int(1000 * log((2 * documents + 2) / (2 * int(d) + 1))) for d in n[2:]], np.int64))


class Block:
    """Postings of some documents, ordered by term, with the part of a score that each one has before the term's weight."""

    def __init__(self, b: pa.Table, corpus: Corpus):
        codes, counts, n = column(b, "codes"), column(b, "counts").flatten().to_numpy(), column(b, "n").to_numpy()
        row = np.repeat(np.arange(len(n)), np.diff(codes.offsets.to_numpy()))
        m = 50 + 50 * n * corpus.documents // max(corpus.length, 1)
        flat = codes.flatten().to_numpy()
        by = np.argsort(flat, kind="stable")
        self.size, self.code, self.row = len(n), flat[by], row[by]
        self.part = (1_000_000_000 * counts // (1000 * counts + 20 * m[row]))[by]
        self.first = np.searchsorted(self.code, np.arange(len(corpus.weight) + 1))
        self.highest = np.zeros(len(corpus.weight), np.int64)
        np.maximum.at(self.highest, self.code, self.part)
        self.weight = corpus.weight

    def of(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of an item's terms, and the number of each one's term within the item."""
        first, size = self.first[item], self.first[item + 1] - self.first[item]
        before = np.cumsum(size) - size
        return np.repeat(first - before, size) + np.arange(size.sum()), np.repeat(np.arange(len(item)), size)

    def masks(self, item: np.ndarray, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Bitmaps of the item's terms in every document, as rows of whole numbers."""
        words = [np.bincount(self.row[at[bit // MASK_BITS == w]], 2.0 ** (bit[bit // MASK_BITS == w] % MASK_BITS), self.size)
                 for w in range(-(-len(item) // MASK_BITS))]
        return np.stack(words, axis=1)

    def best(self, item: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best ``k`` given the best scores known so far, with their scores."""
        at, bit = self.of(item)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        masks = self.masks(item, at, bit)
        if masks.shape[1] == 1:
            _, one, group, size = np.unique(masks[:, 0], return_index=True, return_inverse=True, return_counts=True)
        else:
            _, one, group, size = np.unique(masks, axis=0, return_index=True, return_inverse=True, return_counts=True)
        # The highest score of a mask, read off one of its documents.
        top = np.bincount(self.row[at], (self.weight * self.highest)[self.code[at]].astype(float), self.size)[one]
        order = np.argsort(-top, kind="stable")
        order = order[top[order] > 0]
        seen, docs, scores = 0, [], []
        while seen < len(order):
            least = floor[0] if len(floor) >= k else 1
            # As many masks as hold k documents, at first; then ever more. Equal scores may still win by their id.
            upto = seen + int(np.searchsorted(np.cumsum(size[order[seen:]]), k << min(len(docs), 20))) + 1
            chosen = order[seen:upto]
            chosen = chosen[top[chosen] >= least]
            if not len(chosen):
                break
            wanted = np.zeros(len(one), bool)
            wanted[chosen] = True
            keep = at[wanted[group.reshape(-1)[self.row[at]]]]
            score = np.bincount(self.row[keep], (self.weight[self.code[keep]] * self.part[keep]).astype(float), self.size)
            found = np.flatnonzero(score >= least)
            docs.append(found)
            scores.append(score[found].astype(np.int64))
            floor = np.sort(np.concatenate([floor, scores[-1]]))[-k:]
            seen = upto
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(docs), np.concatenate(scores)


def candidates(posted: DataFrame, items: list[np.ndarray], corpus: Corpus, k: int) -> DataFrame:
    """``(item, doc_id, score)``: at least the best ``k`` documents that every task has for each item; ties are all kept up to
    the smallest ids."""
    kind = dict(posted.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, object)) for _ in items]
        for part in blocks(batches, BLOCK_BYTES):
            for start in range(0, part.num_rows, DOCS_AT_ONCE):
                b = part.slice(start, DOCS_AT_ONCE).combine_chunks()
                block, ids = Block(b, corpus), np.array(column(b, "doc_id").to_pylist(), object)
                for i, item in enumerate(items):
                    docs, scores = block.best(item, np.sort(held[i][0]), k)
                    if not len(docs):
                        continue
                    scores, own = np.concatenate([held[i][0], scores]), np.concatenate([held[i][1], ids[docs]])
                    order = sorted(range(len(scores)), key=lambda j: (-scores[j], own[j] is None, own[j]))[:k]
                    held[i] = scores[order], own[order]
        found = [(i, d, int(s)) for i, (scores, own) in enumerate(held) for s, d in zip(scores, own)]
        names, kinds = ["item", "doc_id", "score"], [pa.int32(), id_kind, pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found) if found else [(), (), ()], kinds)], names)
    id_kind = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    return posted.mapInArrow(run, f"item int, doc_id {kind}, score long")


def ranked(found: DataFrame, by: str, k: int) -> DataFrame:
    """Best ``k`` rows of each ``by``: first those of salted shares, then of the shares' winners."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    shares = found.withColumn("_salt", F.spark_partition_id() % 64)
    part = shares.withColumn("rank", F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order))).filter(F.col("rank") <= k)
    return part.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The ``k`` best documents of every item with a score above 0: item_id, rank, doc_id, score.

    Every distinct (item_id, text) of ``items`` is an item; null and empty texts, of items as of documents, have no term and
    give no row. Equal scores rank by ascending doc_id, null ids last; repeated rows are documents of their own. An empty
    table on either side gives an empty result; other columns are not read. Items are taken ``at_once`` in a pass over the
    documents, chosen by hash, so what a task is sent does not grow with their number.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = materialize(items.select("item_id", F.col("text").cast("string").alias("text")).distinct(), "items")
    passes, results = max(1, -(-asked.count() // at_once)), []
    for p in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()
        vocab, codes, ends = terms(pa.array([r.text for r in rows], pa.large_string()))
        own = [np.unique(codes[a:b]) for a, b in zip(ends, ends[1:])]
        posted = materialize(postings(docs, {v: i for i, v in enumerate(vocab)}), "postings")
        corpus = statistics(posted, len(vocab))
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {dict(items.dtypes)['item_id']}")
        best = ranked(candidates(posted, own, corpus, k), "item", k)
        results.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, results)
