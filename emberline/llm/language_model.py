"""A trigram language model in sharded Elias-Fano tries, trained and queried by the same shuffles.

Texts are cut into chunks with a vocabulary of their own. A chunk asks word shards for the ids and training counts of its
distinct words, then pair shards for the probabilities of its distinct pairs of neighbouring words; with the question it
tells how often it saw each pair in training texts. A pair shard adds these counts up, smooths them, quantises the
probabilities, builds its trie, and answers from it. So counting and scoring send each distinct word and pair of a chunk
once, whatever the corpus size, and no task holds more than a shard or a chunk. Successors of very frequent words are
spread over all shards.

A pair shard also tells a pair's place in its trie and where the successors of a context begin, so the rank among them. A third
round asks the shards of the first two words of each trigram: the two words go by their place, the last one by its rank after the
middle word, and the shard hangs the trigrams below its pairs. It answers with the trigram's code, or none, and with the backoff
weight of the two words, so unseen trigrams fall back to the pair.

Chunks are written once, in buckets by their name, and stay there: answers come to them. What travels is sorted, kept as steps,
and compressed byte by byte; ids and codes follow the frequency, so most of their bytes are zero.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.elias_fano import Third, build, build_third, mapped
from emberline.llm.words import blocks, bounded_batches, column, mix, tokens
from emberline.storage import bucketed, materialize

CHUNK_BYTES = 12 << 20
# Words and tokens per shard; contexts with more training tokens than HOT are spread over all shards.
SHARD_WORDS, SHARD_TOKENS, HOT = 400_000, 2_000_000, 100_000
# Weight of the unigram distribution in a bigram's and of the bigram's in a trigram's, in tokens; range of the 8-bit codes in powers of ten.
PRIOR, RANGE = 4.0, 12.0
END = "\n"  # no word can be this
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeeze(x: np.ndarray) -> bytes:
    """The array's bytes, all first ones, then all second ones and so on, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def expand(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(x: np.ndarray, size: np.ndarray | None = None) -> bytes:
    """Ascending numbers as differences; with ``size`` they are runs of these lengths, each ascending by itself."""
    d = np.diff(x, prepend=0)
    if size is not None:
        first = _firsts(size)
        d[first] = x[first]
    return squeeze(d.astype("<i8"))


def summed(b: bytes, size: np.ndarray | None = None) -> np.ndarray:
    d = expand(b, "<i8")
    x = np.cumsum(d)
    if size is not None:
        first = _firsts(size)
        x -= np.repeat((x - d)[first], size[size > 0])
    return x


def _firsts(size: np.ndarray) -> np.ndarray:
    size = size[size > 0].astype(np.int64)
    return np.cumsum(size) - size


def order_by(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The places in order of two columns of non-negative numbers, equal ones as they stand; packed into one word if they fit."""
    a, b, c = (int(x).bit_length() for x in (high.max(initial=0), low.max(initial=0), len(high)))
    if a + b + c < 64:
        key = high.astype(np.int64) << b
        key |= low
        key <<= c
        key |= np.arange(len(high))
        key.sort()
        key &= (1 << c) - 1
        return key
    return np.argsort((high.astype(np.int64) << b) | low, kind="stable") if a + b < 64 else np.lexsort((low, high))


def distinct_of(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of two columns, and where in it each distinct combination begins."""
    order = order_by(high, low)
    a, b = high[order], low[order]
    return order, np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(order)])


def numbered(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted, distinct combinations of two columns, and which one each row has."""
    order, first = distinct_of(high, low)
    number = np.empty(len(order), np.int32)
    number[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(order))))
    return high[order[first]], low[order[first]], number


def by_shard(shard: np.ndarray) -> np.ndarray:
    """The places in order of their shards, otherwise as they stand."""
    return np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 2 ** 16 else shard, kind="stable")


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of probabilities, evenly spaced in the logarithm."""
    return (1 + np.rint(np.clip(-np.log10(p), 0, RANGE) * (254 / RANGE))).astype(np.uint8)


def log10_of(code: np.ndarray) -> np.ndarray:
    return -(code.astype(float) - 1) * (RANGE / 254)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for k, t in enumerate(blocks(batches, CHUNK_BYTES)):
        vocab, codes, ends = tokens(pc.ascii_lower(column(t, "text").cast(pa.large_string())))
        full = np.insert(codes, ends[1:], len(vocab))
        ends = ends + np.arange(len(ends))
        seen = np.bincount(full, minlength=len(vocab) + 1)
        order = np.argsort(-seen, kind="stable")[:np.count_nonzero(seen)]
        code = np.zeros(len(seen), np.int64)
        code[order] = np.arange(len(order))
        full, end = code[full], int(code[len(vocab)])
        number = np.array([*vocab, END], object)[order]
        train = column(t, "train").to_numpy(zero_copy_only=False).astype(bool)
        count = np.bincount(full[np.repeat(train, np.diff(ends))], minlength=len(number))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{task}-{k}"]), pa.array([len(full)]), pa.array([len(number)]), pa.array([end]),
             pa.array([squeeze(column(t, "row").to_numpy(zero_copy_only=False).astype("<i8"))], pa.binary()), pa.array([squeeze(train)], pa.binary()),
             pa.array([squeeze(ends.astype("<i4"))], pa.binary()), pa.array([squeeze(full.astype("<i4"))], pa.binary()),
             pa.array([zstandard.compress(" ".join(number).encode(), 3)], pa.binary()), pa.array([squeeze(count.astype("<i4"))], pa.binary())],
            names=["chunk", "n_tokens", "n_words", "end_code", "rows", "train", "ends", "codes", "words", "counts"])


def _vocabulary(row) -> list[str]:
    return zstandard.decompress(row.words).decode().split(" ")


def _ask_words(shards: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                words, counts = np.array(_vocabulary(row), object), expand(row.counts, "<i4")
                shard = np.fromiter((xxhash.xxh32_intdigest(w) % shards for w in words), np.int64, len(words))
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                yield pd.DataFrame([(row.chunk, int(shard[part[0]]), steps(part), zstandard.compress(" ".join(words[part]).encode(), 3),
                                     squeeze(counts[part])) for part in np.split(order, cuts)], columns=["chunk", "shard", "place", "words", "counts"])
    return run


def _answer_words(shards: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        lists = [zstandard.decompress(b).decode().split(" ") for b in frame["words"]]
        counts = np.concatenate([expand(b, "<i4") for b in frame["counts"]]).astype(np.int64)
        number, words = pd.factorize(np.array([w for part in lists for w in part], object))
        total = np.bincount(number, counts, len(words)).astype(np.int64)
        # Only words of training texts get an id; ids of different shards never meet.
        local = np.empty(len(total), np.int64)
        local[np.argsort(-total, kind="stable")] = np.arange(1, len(total) + 1)
        ids = np.where(total > 0, local * shards + shard, 0)
        out, at = [], 0
        for chunk, part, place in zip(frame["chunk"], lists, frame["place"]):
            own = number[at:at + len(part)]
            at += len(part)
            out.append((chunk, 0, 0, place, squeeze(ids[own].astype("<i8")), squeeze(total[own].astype("<i8"))))
        out.append((None, int((total > 0).sum()), int(total.sum()), None, None, None))
        return pd.DataFrame(out, columns=["chunk", "distinct", "total", "place", "ids", "counts"])
    return run


class Chunk:
    """A chunk with the answers of the word shards: ids and counts per word, words in order of ids, and its distinct pairs."""

    def __init__(self, row, answers: pd.DataFrame, distinct: int, total: int):
        n = int(row.n_words)
        ids, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for place, i, c in zip(answers["place"], answers["ids"], answers["counts"]):
            at = summed(place)
            ids[at], counts[at] = expand(i, "<i8"), expand(c, "<i8")
        self.rows, self.train = expand(row.rows, "<i8"), expand(row.train, bool)
        self.ends, codes = expand(row.ends, "<i4").astype(np.int64), expand(row.codes, "<i4")
        order = np.argsort(ids, kind="stable")
        code = np.empty(n, np.int32)
        code[order] = np.arange(n)
        codes, self.end = code[codes], int(code[int(row.end_code)])
        self.ids, self.counts = ids, counts = ids[order], counts[order]
        self.unigram = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[self.ends[:-1]] = self.end  # a text begins after an end
        self.now = codes
        self.v, self.w, self.pair = numbered(before, codes)

    def asks(self, shards: int) -> dict[int, np.ndarray]:
        """The places of the pairs to ask each pair shard for, sorted by the ids of context and word, as the pairs are.

        Successors of contexts with more than HOT training tokens are spread over all shards. Words that are in no training
        text need not be asked for. The answers come in this order, so places are not sent.
        """
        v, w = self.ids[self.v], self.ids[self.w]
        spread = np.where(self.counts[self.v] > HOT, w, 0).astype(np.uint64)
        self.shard = shard = (mix(v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + spread) % np.uint64(shards)).astype(np.int64)
        ask = np.flatnonzero((v > 0) & (w > 0))
        ask = ask[by_shard(shard[ask])]
        parts = np.split(ask, np.flatnonzero(np.diff(shard[ask])) + 1) if len(ask) else []
        return {int(shard[part[0]]): part for part in parts}

    def answered(self, shards: int, answers: pd.DataFrame) -> None:
        """Take the pair shards' answers: codes, places in the shard's trie, and ranks that tell the successors of a context apart in all shards."""
        self.code, self.place, self.rank = np.zeros(len(self.v), np.uint8), np.zeros(len(self.v), np.int64), np.zeros(len(self.v), np.int64)
        asks = self.asks(shards)
        for shard, codes, places, begins in zip(answers["n_words"], answers["ids"], answers["place"], answers["counts"]):  # the shard's number is there
            part = asks[int(shard)]
            self.code[part] = code = expand(codes, np.uint8)
            begin = summed(begins)[np.cumsum(np.diff(self.v[part], prepend=self.v[part[0]]) > 0)][code > 0]
            part = part[code > 0]
            self.place[part] = place = summed(places)
            self.rank[part] = place - begin
        hot = self.counts[self.v] > HOT
        self.rank[hot] = self.rank[hot] * shards + self.shard[hot]

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Number the chunk's distinct trigrams of two known pairs; their contexts and last pairs, as places of pairs.

        ``at`` are the tokens whose two words before are a known pair, ``context`` that pair, ``triple`` the trigram's number
        or -1 where the last pair is unknown, in which case the trigram is.
        """
        first = np.zeros(len(self.pair), bool)
        first[self.ends[:-1]] = True
        at = np.flatnonzero(~first)
        self.at = at[self.code[self.pair[at - 1]] > 0]
        self.context = self.pair[self.at - 1]
        last = self.pair[self.at]
        known = self.code[last] > 0
        self.triple = np.full(len(self.at), -1, np.int32)
        ctx, last, self.triple[known] = numbered(self.context[known], last[known])
        return ctx, last

    def asks_third(self, ctx: np.ndarray, last: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per shard the contexts (places of pairs), how many trigrams each has, and the trigrams, sorted by context and rank."""
        asked = np.zeros(len(self.v), bool)
        asked[self.context] = True
        contexts = np.flatnonzero(asked)
        contexts = contexts[by_shard(self.shard[contexts])]
        order = np.zeros(len(self.v), np.int64)
        order[contexts] = np.arange(len(contexts))
        triples = order_by(order[ctx], self.rank[last])
        size = np.bincount(order[ctx], minlength=len(contexts)) if len(contexts) else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff(self.shard[contexts])) + 1
        ends = np.concatenate([[0], np.cumsum(size)])
        edges = [0, *cuts.tolist(), len(contexts)] if len(contexts) else []
        return {int(self.shard[contexts[a]]): (contexts[a:b], size[a:b], triples[ends[a]:ends[b]]) for a, b in zip(edges, edges[1:])}


def _split(chunk: pd.DataFrame, answers: pd.DataFrame):
    """The chunk's own row, and the answers of the word shards, of the pair shards and of the third round."""
    kinds = answers["kind"].to_numpy()
    return next(chunk.itertuples()), answers[kinds == 1], answers[kinds == 2], answers[kinds == 3]


def _ask_pairs(shards: int, distinct: int, total: int):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row, words, _, _ = _split(chunk, answers)
        c = Chunk(row, words, distinct, total)
        seen = np.bincount(c.pair[np.repeat(c.train, np.diff(c.ends))], minlength=len(c.v))
        v, w, uni = c.ids[c.v], c.ids[c.w], quantise(c.unigram)
        out = []
        for shard, part in c.asks(shards).items():
            own = v[part]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            size = np.diff(np.append(first, len(part)))
            out.append((row.chunk, shard, steps(own[first]), squeeze(size.astype("<i4")), squeeze(c.counts[c.v[part[first]]].astype("<i8")),
                        steps(w[part], size), squeeze(seen[part].astype("<i4")), squeeze(uni[c.w[part]])))
        return pd.DataFrame(out, columns=["chunk", "shard", "ctx", "size", "ctx_count", "w", "seen", "unigram"])
    return run


def _cuts(parts: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([len(p) for p in parts])[:-1]


def _answer_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Build the shard's trie from all questions and answer them from it."""
    ctxs, sizes, ws, n, totals, uni = [], [], [], [], [], []
    for r in frame.itertuples():
        sizes.append(expand(r.size_, "<i4"))
        ctxs.append(summed(r.ctx))
        totals.append(expand(r.ctx_count, "<i8"))
        ws.append(summed(r.w, sizes[-1]))
        n.append(expand(r.seen, "<i4"))
        uni.append(expand(r.unigram, np.uint8))
    ids, number = np.unique(np.concatenate(ctxs), return_inverse=True)
    total = np.zeros(len(ids), np.int64)
    total[number] = np.concatenate(totals)
    back, w = np.repeat(number, np.concatenate(sizes)), np.concatenate(ws)
    order, first = distinct_of(back, w)
    seen = np.add.reduceat(np.concatenate(n).astype(np.int64)[order], first)
    on = seen > 0
    own = order[first][on]
    p = (seen[on] + PRIOR * 10.0 ** log10_of(np.concatenate(uni)[own])) / (total[back[own]] + PRIOR)
    trie, file = mapped(build(ids[back[own]], w[own], quantise(np.minimum(p, 1.0))))
    begin, place, found = trie.find(ids, back, w)
    codes = np.zeros(len(w), np.uint8)
    codes[found] = trie.codes[place[found]]
    del trie
    file.close()
    cuts = _cuts(ws)
    out = [(r.chunk, r.shard, squeeze(c), steps(p[f]), steps(begin[k]))
           for r, c, p, f, k in zip(frame.itertuples(), np.split(codes, cuts), np.split(place, cuts), np.split(found, cuts), np.split(number, _cuts(ctxs)))]
    return pd.DataFrame(out, columns=["chunk", "shard", "codes", "places", "begins"])


def _ask_triples(shards: int, distinct: int, total: int):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row, words, pairs, _ = _split(chunk, answers)
        c = Chunk(row, words, distinct, total)
        c.answered(shards, pairs)
        ctx, last = c.trigrams()
        train = np.repeat(c.train, np.diff(c.ends))[c.at]
        seen = np.bincount(c.triple[train & (c.triple >= 0)], minlength=len(ctx))
        out = []
        for shard, (contexts, size, part) in c.asks_third(ctx, last).items():
            out.append((row.chunk, shard, steps(c.place[contexts]), squeeze(size.astype("<i4")), steps(c.rank[last[part]], size),
                        squeeze(seen[part].astype("<i4")), squeeze(c.code[last[part]])))
        return pd.DataFrame(out, columns=["chunk", "shard", "place", "size_", "rank", "seen", "pair"])
    return run


def _answer_triples(frame: pd.DataFrame) -> pd.DataFrame:
    """Hang the shard's trigrams below its pairs and answer from there."""
    contexts, sizes, ranks, seen, uni = [], [], [], [], []
    for r in frame.itertuples():
        sizes.append(expand(r.size_, "<i4"))
        contexts.append(summed(r.place))
        ranks.append(summed(r.rank, sizes[-1]))
        seen.append(expand(r.seen, "<i4"))
        uni.append(expand(r.pair, np.uint8))
    context, rank = np.concatenate(contexts), np.concatenate(ranks)
    place, count, pair = np.repeat(context, np.concatenate(sizes)), np.concatenate(seen).astype(np.int64), np.concatenate(uni)
    # Pairs behind the last one asked for as a context have no trigrams.
    total = np.bincount(place, count, int(context.max(initial=-1)) + 1)
    order, first = distinct_of(place, rank)
    count = np.add.reduceat(count[order], first) if len(first) else count
    on = count > 0
    own = order[first][on]
    p = (count[on] + PRIOR * 10.0 ** log10_of(pair[own])) / (total[place[own]] + PRIOR)
    third, file = mapped(build_third(place[own], rank[own], quantise(np.minimum(p, 1.0)), quantise(PRIOR / (total + PRIOR))), Third)
    codes, backoffs = third.lookup(place, rank), third.backoffs[context]
    del third
    file.close()
    out = [(r.chunk, r.shard, squeeze(a), squeeze(b)) for r, a, b in zip(frame.itertuples(), np.split(codes, _cuts(ranks)), np.split(backoffs, _cuts(contexts)))]
    return pd.DataFrame(out, columns=["chunk", "shard", "codes", "backoffs"])


def _score(shards: int, distinct: int, total: int):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row, words, pairs, triples = _split(chunk, answers)
        c = Chunk(row, words, distinct, total)
        uni = np.log10(c.unigram)
        c.answered(shards, pairs)
        code = c.code
        context = c.counts[c.v]
        logp = np.where(code > 0, log10_of(code), np.log10(PRIOR / (context + PRIOR)) + uni[c.w])
        third, last = c.trigrams()
        asks, codes, backoffs = c.asks_third(third, last), np.zeros(len(third), np.uint8), np.zeros(len(c.v), np.uint8)
        for shard, got, weights in zip(triples["n_words"], triples["ids"], triples["counts"]):
            contexts, _, part = asks[int(shard)]
            codes[part], backoffs[contexts] = expand(got, np.uint8), expand(weights, np.uint8)
        sums = lambda x: np.add.reduceat(x, c.ends[:-1]) if len(c.ends) > 1 else x[:0]
        best = logp[c.pair]
        bigram = sums(best)
        found = np.append(codes, np.uint8(0))[c.triple]  # the last one is for -1
        best[c.at] = np.where(found > 0, log10_of(found), best[c.at] + log10_of(backoffs[c.context]))
        return pd.DataFrame({"row": c.rows, "n_tokens": np.diff(c.ends), "n_known": sums((c.counts > 0)[c.now].astype(np.int64)),
                             "train_tokens": np.full(len(c.rows), total), "base_score": sums(uni[c.now]), "score": sums(best),
                             "bigram_score": bigram})
    return run


def score(docs: DataFrame, train: Column, chunk_tokens: int = SHARD_TOKENS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score, bigram_score; base ten logarithms.

    The model is learnt from the rows where ``train`` holds (a null condition counts as false). Tokens are words between
    ASCII white space, lower-cased in A-Z, and one end; null texts are the end alone. base_score adds the smoothed unigram
    logarithms. bigram_score is that of the first two levels: pairs of the training texts have the quantised probability of their trie, other
    pairs the context's share of the unigram probability. score is the whole model's: trigrams interpolated with the bigrams;
    unseen trigrams have the backoff weight of their first two words times the bigram probability, and unseen pairs of words
    give no context. A text's first word has only the end before it. Repeated and null ids are scored row by row. Nothing to learn from
    leaves every token unknown; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("row"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    # A null id travels as the smallest number, which no id may be.
    src = src.withColumn("row", F.coalesce("row", F.lit(-(2 ** 63))))
    volume = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = bucketed(src.mapInArrow(_chunks, "chunk string, n_tokens long, n_words long, end_code long, rows binary, train binary, ends binary, codes binary, words binary, counts binary"),
                      "chunks", -(-volume // CHUNK_BYTES), "chunk")
    size = chunks.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    word_shards, pair_shards = (max(1, -(-(x or 0) // y)) for x, y in ((size[1], shard_words), (size[0], chunk_tokens)))

    asked = chunks.select("chunk", "words", "counts").mapInPandas(_ask_words(word_shards), "chunk string, shard int, place binary, words binary, counts binary")
    answered = materialize(asked.groupBy("shard").applyInPandas(
        _answer_words(word_shards), "chunk string, distinct long, total long, place binary, ids binary, counts binary"), "word_answers")
    stats = answered.filter("chunk is null").agg(F.sum("distinct"), F.sum("total")).first()
    distinct, total = stats[0] or 0, stats[1] or 0

    def visit(run, schema: str, *answers: DataFrame) -> DataFrame:
        """Every chunk, where it lies, with the answers to it; of kind 1 to 3, by the round."""
        sent = [a.filter("chunk is not null").select("chunk", F.lit(k + 1).alias("kind"), "n_words", "place", "ids", "counts") for k, a in enumerate(answers)]
        own = chunks.select("chunk", "n_words", "end_code", "rows", "train", "ends", "codes").groupBy("chunk")
        return own.cogroup(reduce(DataFrame.unionByName, sent).groupBy("chunk")).applyInPandas(run(pair_shards, distinct, total), schema)

    nothing = F.lit(None).cast("binary")
    one = answered.withColumn("n_words", F.lit(0).cast("long"))
    pairs = visit(_ask_pairs, "chunk string, shard int, ctx binary, size binary, ctx_count binary, w binary, seen binary, unigram binary", one).withColumnRenamed("size", "size_")
    found = materialize(pairs.groupBy("shard").applyInPandas(_answer_pairs, "chunk string, shard int, codes binary, places binary, begins binary"), "pair_answers")
    two = found.select("chunk", F.col("shard").cast("long").alias("n_words"), F.col("places").alias("place"), F.col("codes").alias("ids"), F.col("begins").alias("counts"))
    triples = visit(_ask_triples, "chunk string, shard int, place binary, size_ binary, rank binary, seen binary, pair binary", one, two)
    third = materialize(triples.groupBy("shard").applyInPandas(_answer_triples, "chunk string, shard int, codes binary, backoffs binary"), "third_answers")
    three = third.select("chunk", F.col("shard").cast("long").alias("n_words"), nothing.alias("place"), F.col("codes").alias("ids"), F.col("backoffs").alias("counts"))
    scored = visit(_score, "row long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bigram_score double", one, two, three)
    return scored.select(F.when(F.col("row") != -(2 ** 63), F.col("row")).alias("doc_id"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bigram_score")
