"""Preference formatting of chosen and rejected conversations.

The two conversations of a pair are compared turn by turn, by place, whatever their turns are numbered.
The longest prefix that they share is rendered once as the prompt; what follows it is rendered for each
side as a completion, with a loss mask over the assistant's words and the end mark after them.

No conversation is gathered in one task: turns get their places from counts of blocks of turn numbers,
the prefix ends at a minimum that merges before the shuffle, and a pair longer than BLOCK turns is
written in blocks of so many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versionlog.llm.common import stored

#: How a turn is written: role mark, text, end mark.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"
#: Turns of a row, and turn numbers that are ordered together.
BLOCK = 1024


def places(turns: DataFrame, pair: Column, is_chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(pair_id, chosen, pos, role, text)``: turns with their places from 0 in their conversation.

    Turns stand in the order of turn number (null last), role and text; nulls of these two are empty.
    """
    rows = turns.select(
        pair.alias("pair_id"), is_chosen.alias("chosen"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("pair_id is not null and chosen is not null")
    rows = stored(rows.withColumn("part", F.floor(F.col("turn") / BLOCK)), "turns")
    side = ["pair_id", "chosen"]
    parts = rows.groupBy(*side, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*side).orderBy(F.asc_nulls_last("part")).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).select(*side, F.col("part").alias("p"), "before")
    # The place within a part is a number, then what stands before the part is added.
    own = F.row_number().over(Window.partitionBy(*side, "part").orderBy("turn", "role", "text")) - 1
    return rows.withColumn("own", own).alias("r").join(
        parts.alias("q"), (F.col("r.pair_id") == F.col("q.pair_id")) & (F.col("r.chosen") == F.col("q.chosen")) & F.col("r.part").eqNullSafe(F.col("q.p"))
    ).select("r.pair_id", "r.chosen", (F.col("before") + F.col("own")).alias("pos"), "r.role", "r.text")


def preference_pairs(turns: DataFrame, pair: Column, is_chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(pair_id, block, prompt, chosen, rejected, chosen_loss, rejected_loss)``: a training row per pair.

    The losses are arrays of (start, end), character ranges of the completions of the row.  A pair of
    more than BLOCK turns has a row for each BLOCK places, whose prompts and completions follow each
    other in the order of ``block``; others have block 0 alone.  Null roles and texts are written as
    empty; a null turn number stands last; rows with one turn number are turns in the order of role and
    text, repeated rows too.  Conversations that are alike give a prompt and two empty completions; a pair
    with one side gives that side's completion, an empty prompt and an empty other one.  Rows whose
    pair or side is null take no part.  Empty tables give no rows; other columns are not read.
    """
    turn = F.struct("role", "text")
    both = places(turns, pair, is_chosen, turn_col, role_col, text_col).groupBy("pair_id", "pos").agg(F.max(F.when(F.col("chosen"), turn)).alias("c"), F.max(F.when(~F.col("chosen"), turn)).alias("r"))
    both = stored(both.withColumn("block", F.floor(F.col("pos") / BLOCK)), "pair-turns")
    ends = both.groupBy("pair_id").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("pos"))).alias("end"), F.max("block").alias("last"))
    ends = ends.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    met = both.join(ends, ["pair_id", "block"])
    shared = F.col("end").isNull() | (F.col("pos") < F.col("end"))
    place = lambda side, which: F.when(which & F.col(side).isNotNull(), F.struct("pos", f"{side}.role", f"{side}.text"))
    listed = [("p", place("c", shared)), ("c", place("c", ~shared)), ("r", place("r", ~shared))]
    got = met.groupBy("pair_id", "block").agg(*(F.sort_array(F.collect_list(x)).alias(n) for n, x in listed))
    return got.select("pair_id", "block", _text("p").alias("prompt"), _text("c").alias("chosen"), _text("r").alias("rejected"), _loss("c").alias("chosen_loss"), _loss("r").alias("rejected_loss"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def _text(turns: str) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), x["text"], F.lit(CLOSE))), "")


def _loss(turns: str) -> Column:
    """Where the assistant's words and end marks stand in the text of ``turns``."""
    span = "struct<start:bigint,end:bigint>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(_head(x))
        end = start + F.length(x["text"]) + F.lit(len(CLOSE))
        own = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(x["role"] == ASSISTANT, F.concat(a["out"], own)).otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, zero, step, lambda a: a["out"])
