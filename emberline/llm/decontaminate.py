"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of ``min_match`` words (the seeds) are joined. For each such pair the
longest common runs are marked one after the other, longest first and never overlapping, by running Karp-Rabin matching:
hashes of all unmarked windows of the current length are compared, equal ones are checked and extended; the length goes
up when a match is at least twice as long and down to ``min_match`` otherwise. Tiles may lie anywhere in the document, so
passages whose parts were reordered are found as well. The share of the item's words that tiles cover decides.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from emberline.llm.words import blocks, bounded_batches, column, shingles, word_hashes
from emberline.operators.joins import is_small
from emberline.storage import materialize

MIN_MATCH, COVERAGE = 5, 0.5
# The benchmark is sent to all tasks only when it has at most so many items and bytes of text; else it is joined.
BROADCAST_ITEMS, BROADCAST_BYTES = 20_000, 16 << 20
# Bytes of text that a task works on at a time.
BLOCK = 2 << 20
BASE, MOD = 1_000_003, (1 << 61) - 1


def _window_hashes(prefix: list[int], power: list[int], size: int, free: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of every window of ``size`` words without a marked word."""
    run = 0
    for i, ok in enumerate(free):
        run = run + 1 if ok else 0
        if run >= size:
            yield i - size + 1, (prefix[i + 1] - prefix[i + 1 - size] * power[size]) % MOD


def _free_runs(free: np.ndarray) -> list[int]:
    """Free words from each place on."""
    out, run = [0] * len(free), 0
    for i in range(len(free) - 1, -1, -1):
        run = run + 1 if free[i] else 0
        out[i] = run
    return out


def _common(item: list[int], doc: list[int], a: int, b: int, most: int) -> int:
    """Length of the common stretch from ``a`` and ``b`` on, by halving over whole slices."""
    if item[a:a + most] == doc[b:b + most]:
        return most
    low = 0
    while most - low > 1:
        mid = (low + most) // 2
        if item[a + low:a + mid] == doc[b + low:b + mid]:
            low = mid
        else:
            most = mid
    return low


def tiles(item: list[int], doc: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in item, start in doc, length), non-overlapping on both sides, longest first."""
    if not item or not doc:
        return []
    power = [1]
    for _ in range(max(len(item), len(doc))):
        power.append(power[-1] * BASE % MOD)
    prefixes = []
    for seq in (item, doc):
        h = [0]
        for w in seq:
            h.append((h[-1] * BASE + w + 1) % MOD)
        prefixes.append(h)
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    out, size = [], max(min_match, min(20, len(item)))
    while True:
        # Starts by the hash of their window and the free word before: a start that continues the document's own word before is
        # part of a match further left, so in repetitive texts whole groups are passed over at once.
        table: dict[int, dict[int | None, list[int]]] = {}
        for a, h in _window_hashes(prefixes[0], power, size, free_i):
            table.setdefault(h, {}).setdefault(item[a - 1] if a and free_i[a - 1] else None, []).append(a)
        found: dict[int, list[tuple[int, int]]] = {}
        left_i, left_d = _free_runs(free_i), _free_runs(free_d)
        for b, h in _window_hashes(prefixes[1], power, size, free_d) if table else ():
            before = doc[b - 1] if b and free_d[b - 1] else None
            for last, starts in table.get(h, {}).items():
                for a in starts if last is None or last != before else ():
                    k = _common(item, doc, a, b, min(left_i[a], left_d[b]))
                    if k >= size:
                        found.setdefault(k, []).append((a, b))
        longest = max(found, default=0)
        if longest >= 2 * size:
            size = longest
            continue
        for k in sorted(found, reverse=True):
            for a, b in found[k]:
                if free_i[a:a + k].all() and free_d[b:b + k].all():
                    out.append((a, b, k))
                    free_i[a:a + k] = False
                    free_d[b:b + k] = False
        if size == min_match:
            # Cut remainders of occluded matches are matches of their own: go on until nothing new is marked.
            if not found:
                return out
            continue
        size = max(min_match, size // 2)


def _seed_lengths(n_words: int, min_match: int) -> int:
    return min(n_words, min_match)


class Items:
    """Benchmark items as word hashes, with a sorted seed index; built from a bounded table or one batch of pairs."""

    def __init__(self, ids: list[int], texts: list[str | None], min_match: int):
        words, ends = word_hashes(pa.array(texts, pa.string()))
        self.words = [words[ends[i]:ends[i + 1]] for i in range(len(ids))]
        self.ids, self.min_match = ids, min_match
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, w in enumerate(self.words):
            k = _seed_lengths(len(w), min_match)
            if k:
                by_size.setdefault(k, []).append((shingles(w, np.array([0, len(w)]), k)[0], i))
        for k, parts in by_size.items():
            h = np.concatenate([p[0] for p in parts])
            owner = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            # A seed that an item repeats points to the item once.
            new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
            self.index[k] = h[new], owner[new]


def seed_hits(words: np.ndarray, ends: np.ndarray, index: dict[int, tuple[np.ndarray, np.ndarray]]):
    """(text, position, seed length, owner) of every seed found in the texts."""
    for k, (keys, owner) in sorted(index.items()):
        n = np.diff(ends)
        sh, cut = shingles(words, ends, k)
        text = np.repeat(np.arange(len(n)), np.diff(cut))
        lo, hi = np.searchsorted(keys, sh, "left"), np.searchsorted(keys, sh, "right")
        at = np.flatnonzero((hi > lo) & (n[text] >= k))
        many = hi[at] - lo[at]
        pos = np.repeat(at - cut[text[at]], many)
        back = np.cumsum(many) - many
        own = owner[np.repeat(lo[at] - back, many) + np.arange(many.sum())] if len(at) else np.zeros(0, np.int64)
        yield from zip(np.repeat(text[at], many).tolist(), pos.tolist(), [k] * len(own), own.tolist())


def cover(item: np.ndarray, doc: np.ndarray, spots: list[tuple[int, int]], min_match: int) -> tuple[int, int]:
    """(words of the item that tiles cover, tiles). Only the seeded stretches of the document can hold tiles."""
    mask = np.zeros(len(doc), bool)
    for p, k in spots:
        mask[p:p + k] = True
    at = np.flatnonzero(mask)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    seq: list[int] = []
    for stretch in np.split(at, gaps):
        seq += [*doc[stretch].tolist(), -1 - len(seq)]  # a separator that equals nothing
    found = tiles(item.tolist(), seq, min(min_match, len(item)))
    return sum(k for _, _, k in found), len(found)


SCHEMA = "doc_id long, item_id long, n_words long, n_covered long, n_tiles long, coverage double"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "item_id", "n_words", "n_covered", "n_tiles", "coverage"]
    kinds = [pa.int64()] * 5 + [pa.float64()]
    cols = list(zip(*out)) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _tile_texts(items: Items, ids: list, words: np.ndarray, ends: np.ndarray) -> list[tuple]:
    spots: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for text, pos, k, own in seed_hits(words, ends, items.index):
        spots.setdefault((text, own), []).append((pos, k))
    out, seen = [], {}
    for (text, own), where in spots.items():
        doc = words[ends[text]:ends[text + 1]]
        near = b"".join(doc[p:p + k].tobytes() + p.to_bytes(8, "little") for p, k in where)
        key = (own, xxhash.xxh128_digest(near))
        if key not in seen:  # passages that many documents hold at one place are tiled once per block
            seen[key] = cover(items.words[own], doc, where, items.min_match)
        covered, n = seen[key]
        total = len(items.words[own])
        out.append((ids[text], items.ids[own], total, covered, n, covered / total))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
            broadcast_items: int = BROADCAST_ITEMS) -> DataFrame:
    """(doc_id, item_id) pairs whose tiles cover at least ``coverage`` of the item's words, with the figures.

    Words are lower-cased runs of letters and digits. Items shorter than ``min_match`` words match as a whole; items and
    texts that are null, empty or without words match nothing. Rows with a null doc_id or item_id are not matched.
    Repeated rows give one pair, with the best coverage. Every document is read whole; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).filter("item_id is not null and item_text is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if is_small(bench, broadcast_items) and size <= BROADCAST_BYTES:
        rows = bench.orderBy("item_id", "item_text").collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value, min_match)
            for t in blocks(batches, BLOCK):
                words, ends = word_hashes(column(t, "text"))
                yield _rows(_tile_texts(items, column(t, "doc_id").to_pylist(), words, ends))

        found = src.mapInArrow(whole, SCHEMA)
    else:
        found = _joined(src, materialize(bench, "bench"), min_match)
    return (found.filter(F.col("coverage") >= coverage).groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("coverage", "n_covered", "n_tiles", "n_words")).alias("m"))
            .select("doc_id", "item_id", "m.coverage", "m.n_covered", "m.n_tiles", "m.n_words"))


def _joined(src: DataFrame, bench: DataFrame, min_match: int) -> DataFrame:
    """The same pairs by shuffles, for a benchmark too large to send: seeds are joined by hash, then texts to the pairs."""
    def seeds_of(key: str, text: str, sizes: list[int], whole: bool):
        def run(batches):
            for t in blocks(batches, BLOCK):
                words, ends = word_hashes(column(t, text))
                n = np.diff(ends)
                for k in sizes:
                    sh, cut = shingles(words, ends, k)
                    own = np.repeat(np.arange(len(n)), np.diff(cut))
                    on = (n[own] >= k) & ((np.minimum(n[own], min_match) == k) if whole else True)
                    ids = column(t, key).to_numpy(zero_copy_only=False)
                    both = np.unique(np.stack([ids[own[on]].astype(np.int64), sh[on].view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(np.full(both.shape[1], k))],
                                                     names=["id", "seed", "k"])
        return run

    sizes = list(range(1, min_match + 1))
    schema = "id long, seed long, k long"
    seeds = materialize(bench.mapInArrow(seeds_of("item_id", "item_text", sizes, True), schema).withColumnRenamed("id", "item_id"), "seeds")
    used = sorted(r[0] for r in seeds.select("k").distinct().collect())
    pairs = (src.mapInArrow(seeds_of("doc_id", "text", used, False), schema).withColumnRenamed("id", "doc_id")
             .join(seeds, ["seed", "k"]).select("doc_id", "item_id").distinct())

    def tile(batches):
        for t in blocks(batches, BLOCK):
            words, ends = word_hashes(column(t, "text"))
            ids, items, texts = (column(t, c).to_pylist() for c in ("doc_id", "item_id", "item_text"))
            out = []
            for i in range(t.num_rows):
                one = Items([items[i]], [texts[i]], min_match)
                out += _tile_texts(one, [ids[i]], words[ends[i]:ends[i + 1]], np.array([0, ends[i + 1] - ends[i]]))
            yield _rows(out)

    return pairs.join(bench, "item_id").join(src, "doc_id").mapInArrow(tile, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document: doc_id, n_items, coverage (largest), items (sorted item ids as text)."""
    return matches(docs, benchmark, **options).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.max("coverage").alias("coverage"),
        F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of all documents that are not contaminated, with all their columns.

    Rows are decided by their text, so a contaminated row goes whatever its id is, null and repeated ones too, and no other row
    goes for having its id. Null and empty texts stay; an empty table gives an empty result.
    """
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select(own.alias("doc_id"), "text")
    bad = materialize(matches(texts, benchmark, **options).select(F.col("doc_id").alias("_bad")).distinct(), "bad")
    side = F.broadcast(bad) if is_small(bad) else bad
    return docs.join(side, own == side._bad, "left_anti")
