"""Formatting of preference pairs: a shared prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import missing, stage

# The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id`` and its ``turns`` in order (NULL turn numbers first).

    Turns that share a number are ordered by role and text. A task holds one conversation at a time.
    """
    missing(turns, conv_id, turn, role, text)
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    gathered = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return gathered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).cast(TURNS))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _segments(turns: Column) -> Column:
    """Lengths and flags of a completion: heads are never trained, bodies only of the trained role."""
    trained = lambda t: F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False))
    segment = lambda text, flag: F.struct(F.length(text).alias("chars"), flag.alias("train"))
    return F.flatten(F.transform(turns, lambda t: F.array(segment(_head(t), F.lit(False)), segment(_body(t), trained(t)))))


def format_pairs(pairs: DataFrame, pair_id: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Render each pair of conversations as one prompt and two completions.

    ``chosen`` and ``rejected`` are arrays of turns (``role``, ``text``). Their longest common prefix of turns is
    rendered once. Returns ``pair_id``, ``prompt_turns``, ``prompt``, ``chosen`` and ``rejected`` (the rendered rest)
    and ``chosen_mask`` and ``rejected_mask``: segments of characters (``chars``, ``train``) that cover the completion
    in order. Only bodies of assistant turns are trained on, with the mark that closes them.

    * NULL conversations are empty ones; NULL roles and texts are empty, and equal to NULL only.
    * Equal conversations give two empty completions; without a common turn the prompt is empty.
    * NULL ids and repeated rows are kept. Very long conversations are rendered whole.
    * Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    missing(pairs, pair_id, chosen, rejected)
    turns = lambda c: F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS))
    df = pairs.select(F.col(pair_id).alias("pair_id"), turns(chosen).alias("a"), turns(rejected).alias("b"))
    both = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(
        F.slice("a", 1, both), F.slice("b", 1, both),
        lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]),
    )
    df = stage(df, same=same, n=both)
    differs = F.array_position("same", F.lit(False))
    df = stage(df, common=F.when(differs > 0, differs - 1).otherwise(F.col("n")).cast("int"))
    rest = lambda c: F.slice(c, F.col("common") + 1, F.size(c))
    df = stage(df, prefix=F.slice("a", 1, F.col("common")), x=rest("a"), y=rest("b"))
    return df.select(
        "pair_id", F.col("common").cast("long").alias("prompt_turns"), _rendered(F.col("prefix")).alias("prompt"),
        _rendered(F.col("x")).alias("chosen"), _rendered(F.col("y")).alias("rejected"),
        _segments(F.col("x")).alias("chosen_mask"), _segments(F.col("y")).alias("rejected_mask"),
    )


def weakened(convs: DataFrame) -> DataFrame:
    """Pairs from plain conversations: rejected repeats the assistant's earlier answer in place of the last one.

    With a single answer the rejected one is empty; without any the two conversations are equal.
    """
    df = stage(convs, answers=F.filter("turns", lambda t: t["role"] == TRAINED_ROLE))
    back = F.array_position(F.reverse(F.transform("turns", lambda t: F.coalesce(t["role"], F.lit("")))), TRAINED_ROLE)
    earlier = F.coalesce(F.get("answers", F.size("answers") - 2)["text"], F.lit(""))
    df = stage(df, at=F.when(back > 0, F.size("turns") - back), earlier=earlier)
    worse = F.transform(
        "turns",
        lambda t, i: F.struct(
            t["role"].alias("role"), F.when(i == F.col("at"), F.col("earlier")).otherwise(t["text"]).alias("text")
        ),
    )
    return df.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), worse.alias("rejected"))
