"""Preference formatting: shared prompt, chosen and rejected completion, loss masks.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt; what follows in
either is its completion. The mask of a completion lists the character ranges that are learnt: the assistant's turns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.storage import materialize

# Conversations that exchange replies with each other.
GROUP = 1000


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, equal rows once. Null roles are ``unknown``, null texts empty."""
    one = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (turns.filter("conv_id is not null").select("conv_id", one.alias("t")).groupBy("conv_id")
            .agg(F.array_sort(F.collect_set("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """Ranges [start, end) of the assistant's words and their closing line break in the rendered turns."""
    sizes = F.transform(turns, lambda t: F.struct(F.length(_header(t)).alias("head"), (F.length(t["text"]) + 1).alias("body"), t["role"].alias("role")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, z: Column) -> Column:
        start, end = s["at"] + z["head"], s["at"] + z["head"] + z["body"]
        spans = F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(z["role"] == "assistant", spans).otherwise(s["out"]).alias("out"))

    return F.aggregate(sizes, begin, step, lambda s: s["out"])


def neighbours(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id): conversations 2p and 2p + 1 make pair p; those without a partner make none."""
    ids = turns.filter("conv_id is not null").select("conv_id").distinct()
    return (ids.groupBy(F.expr("conv_id div 2 - if(conv_id < 0 and conv_id % 2 <> 0, 1, 0)").cast("long").alias("pair_id"))
            .agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
            .select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id")))


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair whose conversations exist: pair_id, chosen_id, rejected_id, n_shared (turns of the prompt), prompt,
    chosen, rejected, chosen_mask, rejected_mask, usable (both completions hold an assistant's turn).

    Equal conversations and one that continues the other give an empty completion and are not usable. Rows without a
    conv_id belong to no conversation; pairs with a null or unknown id are not formatted; a repeated pair is formatted each
    time. A conversation is one text in the end, so its turns meet in one row. Empty tables give an empty result; other
    columns are not read.
    """
    convs = conversations(turns)
    both = (pairs.select("pair_id", "chosen_id", "rejected_id")
            .join(convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id")
            .join(convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id"))
    return _formatted(both)


def _formatted(both: DataFrame) -> DataFrame:
    """The columns of ``format_pairs`` from the turns ``a`` of the chosen and ``b`` of the rejected conversation."""
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    both = both.withColumn("split", F.array_position(same, F.lit(False)).cast("int"))
    both = both.withColumn("n", F.when(F.col("split") > 0, F.col("split") - 1).otherwise(F.size(same)))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.withColumns({"c": rest(F.col("a")), "r": rest(F.col("b"))})
    answers = lambda c: F.exists(c, lambda t: t["role"] == "assistant")
    return both.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_shared"), _render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"), (answers("c") & answers("r")).alias("usable"))


def replaced_replies(turns: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per conversation with an assistant's turn, in the columns of ``format_pairs``: chosen is the conversation, rejected
    the same turns with one of the assistant's, picked by hash, replaced by the reply of conversation rejected_id.

    Each conversation lends the reply that is replaced in it. Conversations meet in groups of about ``group`` by the hash of
    their ids; a reply is replaced by the next other text of the group in the order of hashes, or, if the group has none, by
    one of the table. If all replies of the table are equal, rejected is chosen, with a null rejected_id, and not usable.
    """
    answers = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    convs = conversations(turns).withColumn("answers", F.when(F.size("turns") > 0, answers)).filter("size(answers) > 0")
    convs = convs.withColumn("at", F.element_at("answers", (F.pmod(F.xxhash64("conv_id", F.lit("depth")), F.size("answers")) + 1).cast("int")))
    convs = materialize(convs.select(F.col("conv_id").cast("long").alias("conv_id"), "turns", "at", F.element_at("turns", F.col("at"))["text"].alias("reply")), "convs")
    groups = max(1, convs.count() // group)
    convs = convs.withColumns({"g": F.pmod(F.xxhash64("conv_id"), F.lit(groups)), "h": F.sha2(F.col("reply").cast("binary"), 256)})
    lent = convs.groupBy("g", "h").agg(F.min(F.struct("conv_id", "reply")).alias("own"))
    ring = Window.partitionBy("g").orderBy("h")
    # The last text of a group is followed by its first, which is its own if it is the only one.
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lent = lent.select("g", "h", F.when(F.count(F.lit(1)).over(whole) > 1, F.coalesce(F.lead("own").over(ring), F.first("own").over(whole))).alias("other"))
    # Two different texts of the table are enough to have another one for any reply.
    spare = F.lit(None).cast("struct<conv_id:bigint,reply:string>")
    for r in convs.groupBy("h").agg(F.min(F.struct("conv_id", "reply")).alias("own")).orderBy("h").limit(2).collect():
        spare = F.when(F.col("h") != r["h"], F.struct(F.lit(r["own"]["conv_id"]).cast("long").alias("conv_id"), F.lit(r["own"]["reply"]).alias("reply"))).otherwise(spare)
    both = convs.join(lent, ["g", "h"]).withColumn("other", F.coalesce("other", spare))
    swap = F.transform("turns", lambda t, i: F.when(i + 1 == F.col("at"), F.struct(t["role"].alias("role"), F.coalesce(F.col("other.reply"), t["text"]).alias("text"))).otherwise(t))
    return _formatted(both.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("other.conv_id").alias("rejected_id"),
                                  F.col("turns").alias("a"), swap.alias("b")))


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
