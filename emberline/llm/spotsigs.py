"""Document fingerprints by spot signatures: chains of content words that follow common-word anchors.

An anchor is a run of common words; the content words after it form a chain, whose hash is a signature. A fingerprint is
the set of a document's signatures. Two sets are compared by Jaccard. The search for alike sets puts them in partitions
of set length, so that only neighbouring partitions can reach the threshold, joins them by their rarest signatures, and
counts common ones only where length and order leave the threshold possible. Built-in functions only.
"""
from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.storage import materialize

# Content words of a chain.
CHAIN = 3
THRESHOLD = 0.8
# Neighbouring documents are brought together in ranges of ids of about so many rows, at most so many ranges.
RANGE_ROWS, RANGES = 500, 1 << 14
MARK = "\x01"

# Common words of English, German, French and Spanish.
ANCHORS = {
    "en": "a an and are as at be been but by can for from had has have he her his if in into is it its not of on or she that the their there they "
          "this to was we were which who will with would you",
    "de": "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht "
          "noch nur oder sich sie sind so über um und vom von vor war was wenn werden wie wird zu zum zur",
    "fr": "au aux avec ce ces comme dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses "
          "son sont sur un une vous",
    "es": "al como con de del el ella en era es esta este ha la las le lo los más me no o para pero por que se sin su sus un una y ya",
}


def _plain(text: Column) -> Column:
    """Lower-cased words between single blanks; marks of sentences go, unless nothing else is left."""
    raw = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    words = F.trim(F.regexp_replace(raw, "[\\x00-\\x20.,;:!?\"'()\\[\\]{}¡¿«»“”„’…]+", " "))
    return F.when(words != "", words).otherwise(F.trim(F.regexp_replace(raw, "[\\x00-\\x20]+", " ")))


def _anchored() -> str:
    words = sorted({w for ws in ANCHORS.values() for w in ws.split()})
    return f"(?<![^ ])((?:{'|'.join(words)})) (?=[^ ])"


def with_signatures(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the sorted distinct 64-bit signatures of ``text``.

    Every anchor starts a chain at the next content word, and so does the text's beginning; the last chains are shorter. A
    text of common words only has them as content, so only null, empty and blank texts have no signature.
    """
    items, words = f"{out}_items", f"{out}_words"
    # An anchor is glued to what follows, so an item is a content word with the anchors before it.
    glued = F.split(F.regexp_replace(_plain(F.col(text)), _anchored(), f"$1{MARK}"), " ")
    df = docs.withColumn(items, F.filter(glued, lambda w: w != ""))
    df = df.withColumn(words, F.transform(items, lambda w: F.substring_index(w, MARK, -1)))
    n = F.size(words)
    later = [F.when(n > i, F.slice(words, i + 1, F.greatest(n - i, F.lit(0)))).otherwise(F.slice(words, 1, 0)) for i in range(CHAIN)]
    chains = F.arrays_zip(F.col(items).alias("own"), *[c.alias(f"w{i}") for i, c in enumerate(later)])
    spots = F.filter(chains, lambda c, i: (i == 0) | c["own"].contains(MARK))
    hashes = F.transform(spots, lambda c: F.xxhash64(F.concat_ws(" ", *[c[f"w{i}"] for i in range(CHAIN)])))
    return df.withColumn(out, F.array_sort(F.array_distinct(hashes))).drop(items, words)


def fingerprint(signatures: Column) -> Column:
    """The set as text: hexadecimal signatures between blanks."""
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.lpad(F.hex(s), 16, "0"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets; equal sets, empty ones too, are 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def length_partition(size: Column, threshold: float) -> Column:
    """Sets of two partitions further than 1 apart differ too much in length to reach ``threshold``."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(threshold)) + 1e-9)


def _prefixes(sets: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """``(set, n, sig, place, partition)``: the rarest signatures of each set, of which alike sets must share one."""
    spread = sets.select("set", F.size("signatures").alias("n"), F.explode("signatures").alias("sig"))
    ranked = spread.join(frequency, "sig").groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("order"))
    share = F.ceil(F.col("n") * threshold - 1e-9)
    return ranked.select("set", "n", F.posexplode(F.slice("order", F.lit(1), (F.col("n") - share + 1).cast("int"))).alias("place", "s")).select(
        "set", "n", "place", F.col("s.sig").alias("sig"), length_partition(F.col("n"), threshold).alias("partition"))


def search(queries: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, query_id: str = "doc_id", doc_id: str = "doc_id") -> DataFrame:
    """Documents alike to each query: query_id, doc_id, likeness, one row per pair of at least ``threshold`` (above 0).

    Equal fingerprints are one set, so copies are compared once and joined back by their set at the end; a pair's row count
    is that of the links asked for. Empty fingerprints have no partner. Ids may be null, repeated or of any type: every
    row counts by itself, equal pairs are given once.
    """
    def sets_of(df: DataFrame, key: str) -> DataFrame:
        found = with_signatures(df.select(F.col(key).alias("id"), F.col("text").alias("_text")), "_text", "signatures")
        return materialize(found.filter(F.size("signatures") > 0).select("id", "signatures", F.sha2(fingerprint(F.col("signatures")), 256).alias("set")), "spots")
    asked, kept = sets_of(queries, query_id), sets_of(docs, doc_id)
    left, right = (x.groupBy("set").agg(F.first("signatures").alias("signatures")) for x in (asked, kept))
    frequency = materialize(right.unionByName(left).select("set", F.explode("signatures").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "frequency")
    a = _prefixes(left, frequency, threshold)
    b = _prefixes(right, frequency, threshold)
    # A query visits its own partition of lengths and the two beside it.
    a = a.withColumn("partition", F.explode(F.array(*[F.col("partition") + i for i in (-1, 0, 1)])))
    met = a.select("sig", "partition", F.col("set").alias("l"), F.col("n").alias("ln"), F.col("place").alias("lp")).join(
        b.select("sig", "partition", F.col("set").alias("r"), F.col("n").alias("rn"), F.col("place").alias("rp")), ["sig", "partition"])
    # Beyond this signature at most the rest of the shorter set can be common.
    most = F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) + F.least("lp", "rp")
    need = (F.col("ln") + F.col("rn")) * threshold / (1 + threshold) - 1e-9
    pairs = met.filter(most >= need).select("l", "r").distinct()
    sure = pairs.join(left.select(F.col("set").alias("l"), F.col("signatures").alias("ls")), "l").join(
        right.select(F.col("set").alias("r"), F.col("signatures").alias("rs")), "r").withColumn(
        "likeness", likeness(F.col("ls"), F.col("rs"))).filter(F.col("likeness") >= threshold).select("l", "r", "likeness")
    return sure.join(asked.select(F.col("set").alias("l"), F.col("id").alias("query_id")), "l").join(
        kept.select(F.col("set").alias("r"), F.col("id").alias("doc_id")), "r").select("query_id", "doc_id", "likeness").distinct()


def with_next(docs: DataFrame, extra: list[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(doc_id, text, extra...)`` of every row with ``next_text`` and ``next_`` of each extra column: those of the next row by
    descending doc_id, after the last the first.

    Ids are numbers. Null ids come last; equal ids, and null ones, by a hash of the text. Ids are cut in ranges by their quantiles (one
    array of at most ``RANGES`` values); a range's task also sees the next range's first rows, so texts move once.
    """
    cols = ["doc_id", "text", *extra]
    order = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select(*cols).withColumn("h", order)
    n, nulls = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    ranges = min(RANGES, max(1, -(-n // range_rows)))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0] if shares and n > nulls else []
    splits = [-math.inf, *sorted({float(c) for c in cuts or [0.0]}), math.inf]
    known = keyed.withColumn("_place", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    ranged = Bucketizer(splits=splits, inputCol="_place", outputCol="_range").transform(known).drop("_place")
    # Falling ids have rising ranges; rows without an id follow, in ranges of their hash.
    some = min(RANGES, max(1, -(-nulls // range_rows)))
    late = F.floor((F.col("h") / F.lit(2.0 ** 64) + 0.5) * some)
    ranged = ranged.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(splits)) + late).otherwise(F.lit(len(splits)) - F.col("_range")).cast("long")).drop("_range")
    first = ranged.groupBy("range").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("g"))).alias("m"))
    heads = sorted(first.select("range", "m.doc_id", F.bitwise_not("m.g").alias("h")).collect(), key=lambda r: r.range)
    ids = dict(docs.dtypes)["doc_id"]
    before = [(r.doc_id, r.h, heads[i - 1].range) for i, r in enumerate(heads)]
    table = F.broadcast(docs.sparkSession.createDataFrame(before, f"d {ids}, g long, ahead long"))
    visits = ranged.join(table, ranged.doc_id.eqNullSafe(table.d) & (ranged.h == table.g), "left").drop("d", "g")
    own = F.array(F.struct(F.col("range"), F.lit(0).alias("guest")))
    both = F.concat(own, F.when(F.col("ahead").isNotNull(), F.array(F.struct(F.col("ahead").alias("range"), F.lit(1).alias("guest")))).otherwise(F.slice(own, 1, 0)))
    placed = visits.withColumn("_v", F.explode(both)).select(*cols, "h", "_v.range", "_v.guest")
    w = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "h")
    return placed.select(*cols, "guest", *[F.lead(c).over(w).alias(f"next_{c}") for c in ["text", *extra]]).filter("guest = 0").drop("guest")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third comes from the next document: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    The last floor(n_chars / 3) code points are replaced by the first as many (or all) of the next document by descending doc_id;
    after the last comes the first, and a single row is its own next. Null texts are empty. Rows that repeat an id follow
    each other by a hash of the text. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(with_signatures(rows, "text", "signatures"), ["signatures"])
    cut = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), cut.cast("int")), F.substring("next_text", F.lit(1), (F.col("n_chars") - cut).cast("int"))))
    pairs = with_signatures(pairs, "edited", "edited_signatures")
    own, edited = F.col("signatures"), F.col("edited_signatures")
    return pairs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(own).alias("fingerprint"),
                        fingerprint(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"),
                        likeness(own, F.col("next_signatures")).alias("near_next"), F.size(own).cast("long").alias("n_signatures"))
