"""Words of many texts at once: Arrow splits and numbers them, costly work is done once per distinct token."""
from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

BLOCK_BYTES = 8 << 20
PLAIN_WORD = re.compile(r"[^\W_]+")


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches short, so that very long texts cannot meet in one huge batch; blocks gather them by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return freed memory to the machine: Python workers live on and share an executor's memory with its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes; a task never holds more than one of them, nor the batches it was made of."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        del b
        if size >= limit:
            yield _joined(held)
            size = 0
            give_back()
    if held:
        yield _joined(held)
    give_back()


def _joined(held: list[pa.RecordBatch]) -> pa.Table:
    """One table of the batches, which are let go."""
    table = pa.Table.from_batches(held).combine_chunks()
    held.clear()
    return table


def by_block(batches: Iterator[pa.RecordBatch], limit: int, work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` on each block. What it needed besides its result is freed and given back before the next block is read."""
    for t in blocks(batches, limit):
        out = work(t)
        del t
        yield out
        del out


def column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens between ``[\\x20\\x09-\\x0D]+``, their codes in text order, and offsets per text. Null is empty."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    enc = parts.flatten().dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocab = enc.dictionary.to_pylist()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if "" in vocab:
        keep = codes != vocab.index("")
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return vocab, codes, ends


def spread(codes: np.ndarray, ends: np.ndarray, lists: list, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Replace every code by its list of values; new flat values and offsets per text."""
    size = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), dtype, int(size.sum()))
    first = np.cumsum(size) - size
    n = size[codes]
    before = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[codes] - before[:-1], n) + np.arange(before[-1])
    return flat[at], before[ends]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (wrapping multiplications and shifts)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return PLAIN_WORD.findall(text.lower())


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the plain words of each text, and offsets per text."""
    vocab, codes, ends = tokens(texts)
    one = xxhash.xxh64_intdigest
    lists = [(one(t.lower()),) if t.isalnum() else [one(w) for w in plain_words(t)] for t in vocab]
    return spread(codes, ends, lists, np.uint64)


def shingles(words: np.ndarray, ends: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``k`` consecutive words; a text of 1 to k-1 words has one shingle of all of them."""
    n = np.diff(ends)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(ends[:-1] - out[:-1], count) + np.arange(out[-1])
    stop = np.repeat(ends[1:], count)
    h = np.zeros(len(start), np.uint64)
    for i in range(k):
        at = start + i
        w = np.where(at < stop, words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else np.uint64(0), np.uint64(i + 1))
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h, out
