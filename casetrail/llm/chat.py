"""Preference formatting of conversations, with DataFrame operations only.

A preference pair is two conversations, a chosen and a rejected one. Their longest common prefix of turns (equal role
and text) is rendered once as the prompt; what follows on either side is its completion. A completion comes with the
spans that count for the loss: the texts of its assistant turns and their end marks, in code points of the completion.

``pairs_of_replies`` makes pairs of a table of turns: the two conversations of a pair of ids (2k, 2k + 1) lend each
other their last assistant reply as the rejected one. That takes a single shuffle, on the pair of ids.

Turns order by (turn, role, text), nulls first; repeated rows are turns of their own; null roles and texts are empty; rows
without a conversation id belong to no conversation. A conversation without an assistant turn, or without a partner that
has one, makes no pair; equal replies give two empty completions. Markers inside texts are broken up, so that a text
cannot close its turn. A conversation is one row in memory, like a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
MARKER, BROKEN = "<|", "< |"
TRAINED_ROLE = "assistant"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARKER), F.lit(BROKEN))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _safe(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(END))


def rendered(turns: Column) -> Column:
    """Turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def loss_spans(turns: Column) -> Column:
    """[(start, end)] of the assistant texts, with their end marks, in the rendered turns."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(t["role"] == TRAINED_ROLE, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, first, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns agree."""
    least = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: ~(
        F.element_at(a, i).eqNullSafe(F.element_at(b, i))))
    return F.when(least == 0, 0).otherwise(F.coalesce(F.array_min(differs) - 1, least))


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Pairs of turn arrays (role, text) as prompt, completions and loss spans; other columns stay."""
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    p = pairs.select(*others, F.col(chosen).alias("_c"), F.col(rejected).alias("_r"))
    p = p.withColumn("_n", common_turns(F.col("_c"), F.col("_r")))
    rest = {k: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
            for k, c in (("chosen", F.col("_c")), ("rejected", F.col("_r")))}
    return p.select(
        *others, F.col("_n").alias("prompt_turns"), rendered(F.slice("_c", 1, F.col("_n"))).alias("prompt"),
        *(rendered(turns).alias(k) for k, turns in rest.items()),
        *(loss_spans(turns).alias(f"{k}_spans") for k, turns in rest.items()))


def pairs_of_replies(turns: DataFrame) -> DataFrame:
    """(conv_id, partner_id, chosen, rejected) of a table (conv_id, turn, role, text)."""
    turn = F.struct("turn", "role", "text")
    own = {side: F.sort_array(F.collect_list(F.when(F.col("conv_id").bitwiseAND(1) == side, turn))) for side in (0, 1)}
    both = (turns.where("conv_id is not null").groupBy(F.shiftright("conv_id", 1).alias("pair"))
            .agg(own[0].alias("t0"), own[1].alias("t1")))

    def with_last(both: DataFrame, side: int) -> DataFrame:
        plain = F.transform(f"t{side}", lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
        places = F.sequence(F.lit(1), F.greatest(F.size(f"t{side}"), F.lit(1)))
        last = F.array_max(F.filter(places, lambda i: F.try_element_at(F.col(f"t{side}"), i)["role"] == TRAINED_ROLE))
        return both.withColumn(f"t{side}", plain).withColumn(f"k{side}", last)

    both = with_last(with_last(both, 0), 1).where("k0 is not null and k1 is not null")

    def side_of(a: int, b: int) -> Column:
        reply = F.element_at(F.col(f"t{b}"), F.col(f"k{b}"))
        return F.struct(
            (F.shiftleft("pair", 1) + a).alias("conv_id"), (F.shiftleft("pair", 1) + b).alias("partner_id"),
            F.slice(f"t{a}", 1, F.col(f"k{a}")).alias("chosen"),
            F.concat(F.slice(f"t{a}", 1, F.col(f"k{a}") - 1), F.array(reply)).alias("rejected"))

    return both.select(F.explode(F.array(side_of(0, 1), side_of(1, 0))).alias("p")).select("p.*")
