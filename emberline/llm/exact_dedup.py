"""Exact deduplication by skew-safe combining of full texts.

Rows are combined in three steps, and every step groups by the digest *and* the whole normalised text: Spark's map-side
aggregation deduplicates locally, salted digest groups are merged, and the salt winners are combined globally. Copies of
one text therefore never meet in one task: at most one row per task reaches a salt, one row per salt the global step.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.operators.joins import is_small
from emberline.storage import materialize

# A salt holds about so many rows of one group; the number of salts follows from the row count.
ROWS_PER_SALT = 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def decisions(docs: DataFrame, digest=sha256, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (the digest).

    Texts are equal when identical after replacing each run of ASCII white space by one space; null counts as empty.
    The smallest doc_id of equal texts stays; null ids sort last. Rows that repeat both the id and the text that stay
    are all marked kept (``deduplicate`` leaves one). Texts that share a digest but differ are kept apart.
    An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("_text")).withColumn("text_sha256", digest(F.col("_text")))
    members = materialize(rows.select("doc_id", "text_sha256"), "members")
    salts = max(1, -(-members.count() // rows_per_salt))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("_salt")
    winners = (rows.groupBy("text_sha256", salt, "_text")
               .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    classes = (winners.groupBy("text_sha256", "_text")
               .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    narrow = materialize(classes.drop("_text"), "classes")
    if narrow.groupBy("text_sha256").count().filter("count > 1").isEmpty():
        keys, members, found = ["text_sha256"], members.select("doc_id", "text_sha256", salt), narrow
    else:  # different texts with one digest: the text itself is part of the key
        keys, members, found = ["text_sha256", "_text"], rows.select("doc_id", "text_sha256", "_text", salt), classes
    # A group has one row per salt here, so neither of the two lookups meets a hot key.
    by_salt = members.select(*keys, "_salt").distinct().join(found, keys)
    return members.join(by_salt, [*keys, "_salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat id and text one stays."""
    found = decisions(docs)
    dropped = materialize(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(), "dropped")
    names = docs.columns
    rows = docs.withColumn("__sha", sha256(normalised(F.col("text"))))
    side = F.broadcast(dropped) if is_small(dropped) else dropped
    kept = rows.join(side, rows.doc_id.eqNullSafe(side._id) & (rows["__sha"] == side._sha), "left_anti")
    again = materialize(found.filter("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
                        .count().filter("count > 1").drop("count"), "again")
    if again.isEmpty():
        return kept.select(names)
    cond = kept.doc_id.eqNullSafe(again._id) & (kept["__sha"] == again._sha)
    once = kept.join(again, cond, "left_semi").dropDuplicates(["doc_id", "__sha"])
    return kept.join(again, cond, "left_anti").unionByName(once).select(names)
