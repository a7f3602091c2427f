"""Best-fit packing by a configuration linear program over the length histogram.

Pieces of one length are interchangeable, so the program only knows how many pieces each length has: its size is bounded
by the sequence length, however many documents there are. A configuration is a multiset of lengths that fit one sequence.
The covering program (fewest sequences so that every length is covered) is solved by multiplicative weights; the
configuration of most weight is priced by an unbounded knapsack dynamic program. The solution is rounded down, the
remaining histogram is packed by best fit, and the ranges of ranks that each configuration takes are looked up per piece.
"""
from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
import gc
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from emberline.llm.words import blocks, bounded_batches, by_block, column, spread, tokens
from emberline.storage import materialize

SIZE = 2048
ROUNDS = 300
# Steepness of the weights, and configurations taken per pricing.
ETA, COLUMNS = 6.0, 32
# Shares of the fractional solution that rounding tries, with full configurations only and with all; the plan with the fewest sequences is taken.
SHARES = (1.0, 0.6)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Plain words: Latin letters, perhaps with closing marks. The tokenizer lower-cases them and cuts them from the marks.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@{-~]*)")
# Bytes of text that a task works on at a time.
BLOCK = 2 << 20
CACHE = 150_000


def byte_symbols() -> list[str]:
    """The symbol of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordIds:
    """Ids of tokens between white space. Plain words go straight to the tokenizer's model, one call for each distinct
    word; all others through the whole tokenizer. The cache is emptied when it is full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.symbols, self.cache = Tokenizer.from_file(path), byte_symbols(), {}
        # The short cut holds for tokenizers that lower-case; it is tried on a few words and left out if it differs.
        probe = ["Added", "word,", "été.", "Straße", "ZEBRA!!", "x###", "a|;"]
        self.short = [list(self._plain(PLAIN.fullmatch(w))) for w in probe] == [e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]

    def _part(self, text: str) -> array:
        got = self.cache.get(text)
        if got is None:
            got = array("I", [t.id for t in self.tokenizer.model.tokenize("".join(self.symbols[b] for b in text.encode()) if not text.isascii() else text)])
            self.cache[text] = got
        return got

    def _plain(self, m: re.Match) -> array:
        return self._part(m[1].lower()) + self._part(m[2]) if m[2] else self._part(m[1].lower())

    def __call__(self, vocab: list[str]) -> list:
        out: list = [None] * len(vocab)
        other, match, get, part = [], PLAIN.fullmatch, self.cache.get, self._part
        for i, w in enumerate(vocab):
            m = match(w) if self.short else None
            if m is None:
                other.append(i)
                continue
            word, marks = m.groups()
            word = word.lower()
            ids = get(word) or part(word)
            out[i] = ids + (get(marks) or part(marks)) if marks else ids
        for i, e in zip(other, self.tokenizer.encode_batch_fast([vocab[i] for i in other], add_special_tokens=False)):
            out[i] = e.ids
        if len(self.cache) > CACHE:
            self.cache.clear()
        return out


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One tokenizer and cache per Python worker, which serves many tasks."""
    return WordIds(path)


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        task, ranks = TaskContext.get().partitionId(), Counter()

        def cut(t: pa.Table) -> pa.RecordBatch:
            # The tokenizer drops white space and never joins across it, so every distinct token is encoded once.
            vocab, codes, ends = tokens(column(t, "text"))
            gc.disable()  # half a million short arrays, none in a cycle
            ids, ends = spread(codes, ends, encode(vocab), np.uint32)
            gc.enable()
            docs, out = column(t, "doc_id").to_pylist(), []
            for i, doc in enumerate(docs):
                own = np.append(ids[ends[i]:ends[i + 1]], 0).astype("<u4")
                for p, start in enumerate(range(0, len(own), size)):
                    part = own[start:start + size]
                    out.append((doc, p, start, len(part), zlib.crc32(part.tobytes()), task, ranks[len(part)]))
                    ranks[len(part)] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                              names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

        yield from by_block(batches, BLOCK, cut)
    return run


def knapsack(weight: np.ndarray, size: int) -> np.ndarray:
    """For each room 1..size the first length of a filling of most weight (0: leave a place unused);
    ``weight[l]`` is the weight of one piece of length l, which may be taken any number of times."""
    best, pick = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        got = weight[1:room + 1] + best[room - 1::-1][:room]
        k = int(got.argmax())
        best[room], pick[room] = (got[k], k + 1) if got[k] > best[room - 1] else (best[room - 1], 0)
    return pick


def filling(pick: np.ndarray, room: int) -> Counter:
    out = Counter()
    while room > 0:
        if pick[room]:
            out[int(pick[room])] += 1
        room -= int(pick[room]) or 1
    return out


def solve(hist: dict[int, int], size: int = SIZE, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths, longest first) and how often each is used; together they cover the histogram exactly."""
    demand = np.zeros(size + 1, np.int64)
    for length, n in hist.items():
        demand[length] = n
    fractional, covered = _weights_method(demand.astype(float), size, rounds)
    # Lengths that the fractional solution covers too often scale their configurations back.
    over = np.maximum(covered / np.maximum(demand, 1e-9), 1.0)
    scaled = [(conf, Counter(conf), x / max(over[k] for k in set(conf))) for conf, x in fractional.items()]
    scaled.sort(key=lambda e: (-e[2], e[0]))
    plans = (_rounded(demand.copy(), scaled, share, size, slack) for share in SHARES for slack in (False, True))
    return sorted(min(plans, key=lambda used: sum(used.values())).items(), key=lambda e: e[0], reverse=True)


def _rounded(left: np.ndarray, scaled: list[tuple[tuple[int, ...], Counter, float]], share: float, size: int, slack: bool) -> Counter:
    """A share of the fractional solution rounded down, the rest of the histogram by best fit. Without ``slack`` only
    configurations that fill a sequence are taken."""
    used: Counter = Counter()
    for conf, count, x in scaled:
        m = int(min(x * share, *[left[k] // n for k, n in count.items()]))
        if m > 0 and (slack or sum(conf) == size):
            used[conf] += m
            for k, n in count.items():
                left[k] -= n * m
    _best_fit(left, size, used)
    return used


def _weights_method(demand: np.ndarray, size: int, rounds: int) -> tuple[Counter, np.ndarray]:
    """Fractional covering by multiplicative weights: how often each priced configuration is used, and what that covers.

    A length's weight falls exponentially with the share of its demand that is covered. Each round prices the best
    configurations at these weights and takes a step of them that is small against the demand of all their lengths.
    """
    out, covered, need = Counter(), np.zeros(size + 1), demand > 0
    total = float((demand * np.arange(size + 1)).sum())
    lengths = np.flatnonzero(need)
    for _ in range(rounds if total else 0):
        share = covered[lengths] / demand[lengths]
        if (share >= 1).all():
            break
        weight = np.zeros(size + 1)
        weight[lengths] = np.exp(-ETA * share) * lengths
        pick = knapsack(weight, size)
        # One table prices every room: the lengths that lag most each get the best filling of the rest.
        for k in lengths[np.argsort(share, kind="stable")[:COLUMNS]]:
            conf = filling(pick, size - int(k))
            conf[int(k)] += 1
            step = min(demand[c] / n for c, n in conf.items()) / 4
            out[tuple(sorted(conf.elements(), reverse=True))] += step
            for c, n in conf.items():
                covered[c] += n * step
    return out, covered


def _best_fit(left: np.ndarray, size: int, used: Counter) -> None:
    """Pack what is left, whole runs of equal sequences at a time: the longest piece, then the longest that still fits."""
    while left.any():
        free, conf, taken = size, [], Counter()
        have = np.flatnonzero(left)
        while True:
            have = have[(have <= free) & (left[have] > np.array([taken[int(h)] for h in have]))]
            if not len(have):
                break
            k = int(have[-1])
            conf.append(k)
            taken[k] += 1
            free -= k
        m = int(min(left[k] // n for k, n in taken.items()))
        used[tuple(conf)] += m
        for k, n in taken.items():
            left[k] -= n * m


def ranges(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) of the plan, sorted: rank r of a length sits in the last range
    that starts at or before r, in sequence ``first sequence + r - first rank``."""
    rank, rows, seq = Counter(), [], 0
    for conf, times in plan:
        at = 0
        for k in conf:
            rows.append((k, rank[k], seq, at))
            rank[k] += times
            at += k
        seq += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the tokenizer's ids of its whole text, without special tokens, and a closing 0; null and empty texts are
    that 0 alone. Only documents longer than ``size`` are cut. Rows that repeat a doc_id, also a null one, are packed each.
    An empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = materialize(src.mapInArrow(_pieces(path or tokenizer_path(), size),
                                        "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long"), "pieces")
    counts = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``size`` rows
    plan = ranges(solve(hist, size, rounds))
    # A piece's rank among its length: the rows of earlier tasks (one window row per task) and its place in its task.
    from pyspark.sql import Window
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sent = spark.sparkContext.broadcast(plan)  # bounded by rounds x size rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        lows = np.searchsorted(table[:, 0], np.arange(size + 2))
        for t in blocks(batches):
            length, rank = (column(t, c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cut):
                part = table[lows[length[rows[0]]]:lows[length[rows[0]] + 1]]
                at = np.searchsorted(part[:, 1], rank[rows], "right") - 1
                seq[rows] = part[at, 2] + rank[rows] - part[at, 1]
                off[rows] = part[at, 3]
            yield pa.RecordBatch.from_arrays([*[column(t, c) for c in names[:5]], pa.array(seq), pa.array(off)], names=names)

    ranked = pieces.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
