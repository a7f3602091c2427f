"""Near duplicates by weighted minwise hashing over hierarchical Poisson processes (BagMinHash), bands, exact verification.

A document is the multiset of its five-word shingles. The weight axis is discretised at the integers and cut into the
intervals [0, 1), [1, 2), [2, 4), [4, 8) ...; every (shingle, interval) owns a Poisson process whose points come in rising
order from a hash seed. A point carries a signature slot and, bit by bit, the half of the interval it falls into; it counts
when it lies below the shingle's weight. The first counting point of a slot is its signature value, so two documents agree
in a slot with probability equal to their weighted Jaccard similarity. Points beyond the time by which all slots are
filled are never made, so the cost per document is its length plus a constant, not length times slots.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberline.llm.words import blocks, bounded_batches, by_block, column, mix, shingles, word_hashes
from emberline.operators.components import connected_components
from emberline.operators.joins import is_small
from emberline.storage import materialize

SHINGLE, SIMILARITY = 5, 0.8
# 32 bands of 6 slots: a pair at similarity 0.8 shares no band with probability (1 - 0.8^6)^32 = 6e-5.
BANDS, ROWS = 32, 6
# Buckets up to this size are compared in full; larger ones by rounds of pivots, many more each round.
SMALL, PIVOTS = 8, 2
# Shingles fall into so many groups by their hash; what two documents can have in common is bounded group by group.
GROUPS = 64
# Bytes of text that a task works on at a time.
BLOCK = 1 << 20

GOLD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _times(k: int, step: np.uint64) -> np.uint64:
    return np.uint64(k * int(step) & (2 ** 64 - 1))


def weigh(sh: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) triples, sorted."""
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((sh, doc))
    doc, sh = doc[order], sh[order]
    first = np.ones(len(sh), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (sh[1:] != sh[:-1])
    at = np.flatnonzero(first)
    return doc[at], sh[at], np.diff(np.append(at, len(sh)))


def _points(doc, sh, count, limit, slots, best, value) -> None:
    """Lower ``best`` (time) and ``value`` (hash) of every document's slots by all points before its limit."""
    level = 0
    while len(doc):
        low, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        on = count > low
        doc, sh, count = doc[on], sh[on], count[on]
        seed = mix(sh + _times(level + 1, GOLD))
        d, w, s, t, step = doc, count, seed, np.zeros(len(doc)), 0
        while len(d):
            step += 1
            r = mix(s + _times(step, STEP))
            t = t - np.log((r >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / (slots * size)
            on = t < limit[d]
            d, w, s, t, r = d[on], w[on], s[on], t[on], r[on]
            q = mix(r ^ GOLD)
            slot = d * slots + ((q & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            place = low + (q >> np.uint64(32)).astype(np.float64) * (size * 2.0 ** -32)
            hit = np.flatnonzero((place < w) & (t < best[slot]))
            np.minimum.at(best, slot[hit], t[hit])
            won = hit[best[slot[hit]] == t[hit]]
            value[slot[won]] = r[won]
        level += 1


def signatures(doc: np.ndarray, sh: np.ndarray, count: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Signature matrix (documents x slots) of weighted shingle sets; rows of documents without a shingle are 0."""
    total = np.bincount(doc, count, n_docs)
    best, value = np.full(n_docs * slots, np.inf), np.zeros(n_docs * slots, np.uint64)
    todo, spare = total > 0, 3.0
    while todo.any():
        limit = np.where(todo, (np.log(slots) + spare) / np.maximum(total, 1), 0.0)
        on = todo[doc]
        _points(doc[on], sh[on], count[on], limit, slots, best, value)
        todo = todo & np.isinf(best.reshape(n_docs, slots)).any(axis=1)
        spare *= 3
    return value.reshape(n_docs, slots)


def _sketch(bands: int, rows: int):
    def sketch(t: pa.Table) -> pa.RecordBatch:
        words, ends = word_hashes(column(t, "text"))
        sh, ends = shingles(words, ends, SHINGLE)
        doc, s, c = weigh(sh, ends)
        sig = signatures(doc, s, c, t.num_rows, bands * rows)
        key = np.zeros((t.num_rows, bands), np.uint64)
        for b in range(bands):
            h = np.full(t.num_rows, b + 1, np.uint64)
            for r in range(rows):
                h = mix(h * GOLD + sig[:, b * rows + r])
            key[:, b] = h
        one = mix(s * STEP + c.astype(np.uint64))
        k1, k2 = np.zeros(t.num_rows, np.uint64), np.zeros(t.num_rows, np.uint64)
        np.add.at(k1, doc, one)
        np.add.at(k2, doc, mix(one ^ GOLD))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(t.num_rows + 1) * bands, pa.int32()),
                                         pa.array(key.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays(
            [column(t, "doc_id"), pa.array(np.diff(ends)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists],
            names=["doc_id", "n", "k1", "k2", "bands"])
    return lambda batches: by_block(batches, BLOCK, sketch)


def overlap(texts: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of the text pairs (a[i], b[i]); each text is cut up once."""
    n = len(a)
    sh, ends = shingles(*word_hashes(texts), SHINGLE)
    doc, s, c = weigh(sh, ends)
    size = np.bincount(doc, minlength=len(texts))
    first, total = np.cumsum(size) - size, np.bincount(doc, c, len(texts))
    who = np.stack([a, b], axis=1).ravel()
    reps = size[who]
    at = np.repeat(first[who] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    pair = np.repeat(np.arange(2 * n) // 2, reps)
    s, c = s[at], c[at]
    order = np.lexsort((s, pair))
    pair, s, c = pair[order], s[order], c[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (s[1:] == s[:-1]))  # a text holds a shingle once
    common = np.bincount(pair[same], np.minimum(c[same], c[same + 1]), n)
    return common / np.maximum(total[a] + total[b] - common, 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def compare(t: pa.Table) -> pa.RecordBatch:
        enc = pa.concat_arrays([column(t, "text_a").cast(pa.large_string()), column(t, "text_b").cast(pa.large_string())]).dictionary_encode()
        at = enc.indices.to_numpy(zero_copy_only=False)
        j = overlap(enc.dictionary, at[:t.num_rows], at[t.num_rows:])
        return pa.RecordBatch.from_arrays([column(t, "a"), column(t, "b"), column(t, "p"), pa.array(1.0 - j)], names=["a", "b", "p", "d"])

    return by_block(batches, BLOCK, compare)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: every distinct shingle with the number of documents that hold it (2 stands for more), one of them and
    its count there."""
    for t in blocks(batches, BLOCK):
        sh, ends = shingles(*word_hashes(column(t, "text")), SHINGLE)
        doc, s, c = weigh(sh, ends)
        order = np.argsort(s, kind="stable")
        doc, s, c = doc[order], s[order], c[order]
        at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        ids = column(t, "doc_id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(s[at].view(np.int64)), pa.array(np.minimum(np.diff(np.append(at, len(s))), 2)), pa.array(ids[doc[at]].astype(np.int64)),
             pa.array(c[at])], names=["shingle", "docs", "node", "weight"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much of each document's multiset falls into each group of shingles."""
    for t in blocks(batches, BLOCK):
        sh, ends = shingles(*word_hashes(column(t, "text")), SHINGLE)
        doc = np.repeat(np.arange(t.num_rows), np.diff(ends))
        count = np.bincount(doc * GROUPS + (sh % np.uint64(GROUPS)).astype(np.int64), minlength=t.num_rows * GROUPS)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(t.num_rows + 1) * GROUPS, pa.int32()), pa.array(count.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([column(t, "doc_id"), lists], names=["node", "groups"])


def _shared(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, c, g): how much of each open document's multiset also occurs in another open document, in all and by group."""
    nodes = materialize(opened.groupBy("node").agg(F.first("n").alias("n")), "open")
    own = texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id")
    cut = (own.mapInArrow(_cut, "shingle long, docs long, node long, weight long")
           .groupBy("shingle").agg(F.sum("docs").alias("docs"), F.min("node").alias("node"), F.max("weight").alias("weight")))
    # GROUPS is a power of two, so the signed hash falls into the same group.
    alone = cut.filter("docs = 1").groupBy("node", F.pmod("shingle", F.lit(GROUPS)).alias("at")).agg(F.sum("weight").alias("alone"))
    alone = alone.groupBy("node").agg(F.sum("alone").alias("alone"), F.map_from_entries(F.collect_list(F.struct("at", "alone"))).alias("by"))
    left = F.transform("groups", lambda n, i: (n - F.coalesce(F.element_at("by", i.cast("long")), F.lit(0))).cast("int"))
    spread = own.mapInArrow(_grouped, "node long, groups array<int>")
    out = nodes.join(spread, "node").join(alone, "node", "left")
    return materialize(out.select("node", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"), F.when(F.col("by").isNull(), F.col("groups")).otherwise(left).alias("g")), "shared")


def _stars(links: DataFrame) -> DataFrame:
    """``(src, dst)``: the same components by fewer links. Of a document's links to several pivots one stays, to the smallest;
    the other pivots are tied to that one, once for all documents that share them."""
    tied = links.withColumn("v", F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    tied = tied.withColumn("m", F.min("p").over(Window.partitionBy("v")))
    return tied.select(F.col("m").alias("src"), F.col("v").alias("dst")).unionByName(
        tied.filter("p <> m").select(F.col("m").alias("src"), F.col("p").alias("dst"))).filter("src <> dst").distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, small: int = SMALL, pivots: int = PIVOTS) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its class), class_size (documents), n_verified, kept.

    Classes are the connected groups of documents whose multisets of five-word shingles (lower-cased runs of letters and
    digits) overlap by ``similarity`` or more. n_verified counts the links of the document's distinct content that had to
    be verified; pairs that other links already connect are not, so it can be below the number of similar contents.
    Null, empty and wordless texts belong to no group; texts of one to four words have one shingle. Rows that repeat a
    doc_id are one document. Rows with a null doc_id form no group: their class_id is null and they are kept.
    An empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = materialize(src.mapInArrow(_sketch(BANDS, ROWS), "doc_id long, n long, k1 long, k2 long, bands array<long>"), "sketch")
    named = sketch.filter("doc_id is not null")
    # Identical content is one node from here on, named by its smallest doc_id.
    content = named.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    content = materialize(content, "content")
    opened = content.select("node", "n", F.explode("bands").alias("bucket"))
    size = opened.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    opened = materialize(opened.join(size, "bucket").select("bucket", "node", "n", "k"), "buckets")
    wanted = opened.select(F.col("node").alias("_node")).distinct()
    wanted = materialize(wanted, "wanted")
    side = F.broadcast(wanted) if is_small(wanted) else wanted
    texts = materialize(src.join(side, F.col("doc_id") == F.col("_node"), "left_semi").groupBy("doc_id").agg(F.first("text").alias("text")), "texts")

    far = 1.0 - similarity + 1e-9
    # The middle of a group of copies shares the most bands with the others, so it makes the best pivot.
    rank = materialize(opened.groupBy("node").agg(F.sum("k").alias("rank")), "rank")
    opened = opened.join(rank, "node").withColumn("c", F.col("n"))
    need = (1 - far) / (2 - far)
    done = spark.createDataFrame([], "a long, b long, p long, d double")
    comp = None
    while True:
        # Pairs inside one component can give nothing new, so the members outside the bucket's main component are the
        # ones to compare: all of them in small buckets, the first ``pivots`` in large ones.
        part = opened if comp is None else opened.join(comp.select(F.col("v").alias("node"), "root"), "node", "left")
        part = part.withColumn("root", F.coalesce("root", "node")) if comp is not None else part.withColumn("root", F.col("node"))
        by_root = part.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"))
        main = by_root.groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("x"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("k"))
        part = materialize(part.drop("k").join(main.filter("parts > 1").select("bucket", F.col("x.root").alias("main"), "k"), "bucket"), "parts")
        if part.isEmpty():
            break
        order = Window.partitionBy("bucket").orderBy(F.desc("rank"), "node")
        large = (part.filter((F.col("k") > small) & (F.col("root") != F.col("main")))
                 .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= pivots).drop("r"))
        few = materialize(large.unionByName(part.filter((F.col("k") <= small) & (F.col("root") != F.col("main")))), "pivots")
        # A pair that meets in several buckets is made in one of them, the first that its pivot serves (32 at most).
        bounds = comp is not None  # by group, from the second round on
        p = few.join(few.groupBy("node").agg(F.collect_set("bucket").alias("pb")), "node").select(
            "bucket", "pb", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("root").alias("pr"), *[F.col("g").alias("pg")] * bounds)
        w = part.join(part.groupBy("node").agg(F.collect_set("bucket").alias("vb")), "node").select(
            "bucket", "vb", F.col("node").alias("v"), F.col("n").alias("vn"), F.col("c").alias("vc"), F.col("root").alias("vr"), *[F.col("g").alias("vg")] * bounds)
        # Similar multisets of sizes m and n have at least need * (m + n) in common, which neither can exceed.
        w = w.withColumnRenamed("bucket", "_bucket")
        fit = F.least("pc", "vc") >= need * (F.col("pn") + F.col("vn"))
        if bounds:
            fit &= F.aggregate(F.zip_with("pg", "vg", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x) >= need * (F.col("pn") + F.col("vn"))
        pairs = p.join(w, (F.col("bucket") == F.col("_bucket")) & (F.col("pr") != F.col("vr")) & fit
                       & (F.array_min(F.array_intersect("pb", "vb")) == F.col("bucket")))
        fresh = pairs.groupBy(F.least("p", "v").alias("a"), F.greatest("p", "v").alias("b")).agg(F.min("p").alias("p")).join(done, ["a", "b"], "left_anti")
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        checked = materialize(fresh.join(right, "b").join(left, "a").mapInArrow(_verify, "a long, b long, p long, d double"), "checked")
        done = materialize(done.unionByName(checked), "done")
        rest = part.filter(F.col("k") > small).select("bucket", "node", "n", "c", "k", "rank", *["g"] * bounds).join(few.select("bucket", "node"), ["bucket", "node"], "left_anti")
        opened = materialize(rest, "buckets")
        if comp is None and not opened.isEmpty():  # what only one of the open documents holds cannot be shared
            opened = opened.drop("c").join(_shared(opened, texts), "node")
            least = opened.groupBy("bucket").agg(F.min("n").alias("least"))
            opened = materialize(opened.join(least, "bucket").filter(F.col("c") >= need * (F.col("n") + F.col("least"))).drop("least"), "buckets")
        if opened.isEmpty():
            break
        stars = materialize(_stars(done.filter(F.col("d") <= far)), "stars")
        nodes = stars.select(F.col("src").alias("v")).unionByName(stars.select(F.col("dst").alias("v"))).distinct()
        comp = connected_components(nodes, stars)
        pivots *= 32
    links = done.filter(F.col("d") <= far)
    # Rows that repeat a doc_id with different content tie their contents together.
    home = named.join(content.select("k1", "k2", "n", "node"), ["k1", "k2", "n"], "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"))
    home = materialize(home.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("copies")), "home")
    tied = home.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    tied = home.join(tied.select("doc_id", "a"), "doc_id").filter("node > a").select(F.col("a").alias("src"), F.col("node").alias("dst"))
    edges = materialize(_stars(links).unionByName(tied), "edges")
    ends = edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).distinct()
    comp = connected_components(ends, edges)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_verified"))
    by_node = (home.groupBy("node").agg(F.countDistinct("doc_id").alias("m"), F.min("doc_id").alias("low"))
               .join(comp.withColumnRenamed("v", "node"), "node", "left").join(degree, "node", "left")
               .select("node", "m", "low", F.coalesce("root", "node").alias("root"), F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified")))
    by_node = materialize(by_node, "nodes")
    by_root = by_node.groupBy("root").agg(F.sum("m").alias("class_size"), F.min("low").alias("class_id"))
    by_node = materialize(by_node.join(by_root, "root").select("node", "class_id", "class_size", "n_verified"), "classed")
    # A node may hold a third of all rows: rows reach it through (node, salt), a few rows per node.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-home.count() // 100_000)))).alias("salt")
    home = home.withColumn("salt", salt)
    spot = home.select("node", "salt").distinct().join(by_node, "node")
    one = home.join(spot, ["node", "salt"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("class_size").alias("class_size"),
                                                          F.max("n_verified").alias("n_verified"), F.sum("copies").alias("copies"))
    out = one.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "*").select(
        "doc_id", "class_id", "class_size", "n_verified", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    lone = sketch.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
                                                  F.lit(0).cast("long").alias("n_verified"), F.lit(True).alias("kept"))
    return out.unionByName(lone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of the documents that stay, one document per class, with all their columns."""
    gone = materialize(classes(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    side = F.broadcast(gone) if is_small(gone) else gone
    return docs.join(side, docs.doc_id.cast("long") == side._gone, "left_anti")
