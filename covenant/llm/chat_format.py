"""Preference formatting: a shared prompt and two masked completions.

For each pair the longest common prefix of turns of the chosen and the rejected
conversation is found and rendered once, as the prompt; what follows on each side
is rendered as that side's completion, with a mask that tells which characters are
trained on: the text and end mark of assistant turns. Everything is DataFrame
functions; turns meet by one exchange on the pair, and a pair's turns are one row,
as its rendered text is.

Defined results: turns go by number, then role, then text; repeated rows count
once; a null text is empty, a null role is the empty role, which is never trained
on; a pair that lacks a side has an empty completion and a prompt of no turns; a
pair of equal conversations is all prompt and ``identical``; rows without a pair id
make one pair without an id; template marks inside texts are defused by a
zero-width space; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: head of a turn, its end.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
MARK, DEFUSED = "<|im_", "<|\u200bim_"
TRAINED = "assistant"


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(BREAK))


def _body(t: Column) -> Column:
    return F.concat(t["text"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    """An array of turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Runs of characters of the rendered turns: how long, and whether trained on."""
    run = lambda n, on: F.struct(n.cast("int").alias("length"), on.alias("train"))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(run(F.char_length(_head(t)), F.lit(False)), run(F.char_length(_body(t)), t["role"] == TRAINED)),
        )
    )


def preference_examples(turns: DataFrame, pair_column: str = "pair_id") -> DataFrame:
    """``(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, identical)``.

    ``turns`` has a pair id, ``side`` (``chosen`` or ``rejected``), ``turn``,
    ``role`` and ``text``.
    """
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(DEFUSED)).alias("text"),
    )
    of = lambda side: F.sort_array(F.collect_set(F.when(F.col("side") == side, turn)))
    both = (
        turns.select(F.col(pair_column).alias("pair_id"), "side", "turn", "role", "text")
        .groupBy("pair_id")
        .agg(of("chosen").alias("c"), of("rejected").alias("r"))
    )
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    cut = both.withColumn("n", F.when(first == 0, F.size("c")).otherwise(first - 1).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    parts = cut.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select(
        "pair_id",
        F.col("n").alias("n_common"),
        rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"),
        rendered(F.col("r")).alias("rejected"),
        mask(F.col("c")).alias("chosen_mask"),
        mask(F.col("r")).alias("rejected_mask"),
        ((F.size("c") == 0) & (F.size("r") == 0)).alias("identical"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pair turns of every conversation against a negative of itself.

    Chosen is the conversation; in rejected, its last assistant turn gives the last
    answer of the neighbouring conversation (ids 0 and 1, 2 and 3, ...), an empty
    one if there is none. Without an assistant turn both sides are equal.
    """
    own = conversations.select("conv_id", "turn", "role", "text")
    said = F.coalesce("text", F.lit(""))
    last = own.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(F.struct("turn", said.alias("text"))).alias("a"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("a.text").alias("_other"))
    plan = last.join(other, "conv_id", "left").select("conv_id", F.col("a.turn").alias("_last"), F.coalesce("_other", F.lit("")).alias("_other"))
    replaced = (F.col("turn") == F.col("_last")) & (F.col("role") == TRAINED)
    sides = own.join(plan, "conv_id", "left").withColumn(
        "side", F.explode(F.array(F.lit("chosen"), F.lit("rejected")))
    )
    text = F.when((F.col("side") == "rejected") & replaced, F.col("_other")).otherwise(F.col("text"))
    return sides.select(F.col("conv_id").alias("pair_id"), "side", "turn", "role", text.alias("text"))


def mask_text(runs: Column) -> Column:
    """A mask as text: ``length:1`` for trained runs and ``length:0`` for others."""
    return F.array_join(
        F.transform(runs, lambda x: F.concat(x["length"].cast("string"), F.when(x["train"], ":1").otherwise(":0"))), ","
    )
