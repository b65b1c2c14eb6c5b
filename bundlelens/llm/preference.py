"""Preference formatting: the longest common turn prefix as the prompt, and paired masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import col

OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _rendered(turn):
    return F.concat(F.lit(OPEN), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(CLOSE))


def _text(turns):
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns):
    """start:end of what is trained on in a completion: the trained role's texts with their closing mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(state, turn):
        head = state["at"] + len(OPEN) + F.length(turn["role"]) + len(AFTER_ROLE)
        end = head + F.length(turn["text"]) + len(CLOSE)
        span = F.concat(head.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.when(turn["role"] == TRAINED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, start, add, lambda s: s["spans"]), ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per pair: key, n_prompt (turns), prompt, chosen, rejected, chosen_mask, rejected_mask.

    Both inputs hold turns (``key``, turn, role, text); rows with the same key are a pair. The longest common prefix of
    equal turns (role and text) is rendered once as the prompt, what follows as the completions. A mask
    lists the start:end ranges (code points) of a completion that are trained on.

    Turns are ordered by turn (null last), then role and text; rows that repeat are turns that repeat. Null roles and texts count as
    empty. A key on one side only pairs with no turns, a null key is a key like others. Extra columns are ignored; empty tables give
    no rows. The two sides meet in one shuffle; a row holds one conversation, which is the unit of the result.
    """
    def turns(side: DataFrame, number: int) -> DataFrame:
        return side.select(
            col(key).alias(key), F.struct(
                F.lit(number).alias("side"), F.col("turn").isNull().alias("no_turn"), F.col("turn").alias("turn"),
                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_turn"))

    pairs = turns(chosen, 0).unionByName(turns(rejected, 1)).groupBy(key).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    sides = pairs.select(key, F.filter("_turns", lambda t: t["side"] == 0).alias("_a"), F.filter("_turns", lambda t: t["side"] == 1).alias("_b"))
    differs = F.zip_with("_a", "_b", lambda x, y: ~(
        x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])))
    # zip_with pads the shorter side with nulls, which differ from every turn.
    first = F.array_position(differs, True)
    prefix = sides.withColumn("n_prompt", F.when(first > 0, first - 1).otherwise(F.size("_a")).cast("int"))

    def rest(side):
        return F.slice(side, F.col("n_prompt") + 1, F.greatest(F.size(side) - F.col("n_prompt"), F.lit(0)))

    split = prefix.select(key, "n_prompt", F.slice("_a", F.lit(1), F.col("n_prompt")).alias("_prompt"),
                          rest("_a").alias("_chosen"), rest("_b").alias("_rejected"))
    return split.select(
        key, "n_prompt", _text("_prompt").alias("prompt"), _text("_chosen").alias("chosen"), _text("_rejected").alias("rejected"),
        _mask("_chosen").alias("chosen_mask"), _mask("_rejected").alias("rejected_mask"))


def swapped_endings(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rejected conversations: each one with its last turn's text taken from its neighbour's last turn.

    Neighbours are the keys 2n and 2n + 1; without a neighbour the last text is empty. Rows without a key are one conversation, which
    has no neighbour.
    """
    order = F.struct(F.col("turn").isNull().alias("no_turn"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.select(col(key).alias(key), order.alias("_turn"))
    lasts = turns.groupBy(key).agg(F.max("_turn").alias("_last"), F.count(F.lit(1)).alias("_n"))
    other = lasts.select(F.col(key).bitwiseXOR(F.lit(1)).alias("_key"), F.col("_last.text").alias("_text"))
    endings = lasts.join(other, F.col(key) == F.col("_key"), "left").select(
        key, F.col("_last.turn").alias("turn"), F.col("_last.role").alias("role"), F.coalesce("_text", F.lit("")).alias("text"))
    # All turns but one of those equal to the last.
    kept = turns.groupBy(key, "_turn").agg(F.count(F.lit(1)).alias("_times")).join(
        lasts.select(F.col(key).alias("_key"), "_last"), F.col(key).eqNullSafe(F.col("_key"))).withColumn(
        "_times", F.col("_times") - F.col("_turn").eqNullSafe(F.col("_last")).cast("int")).filter("_times > 0").select(
        key, F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")), "_turn").select(
        key, F.col("_turn.turn").alias("turn"), F.col("_turn.role").alias("role"), F.col("_turn.text").alias("text"))
    return kept.unionByName(endings)
