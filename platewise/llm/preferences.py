"""Preference formatting (DataFrame functions only).

A pair of conversations, one chosen and one rejected, is split at its longest
common turn prefix.  The prefix is rendered once as the prompt; the turns
behind it are the two completions, rendered as the same template, with one
mask per segment: only assistant texts are trained on.

The turns of a conversation are gathered into one row, the training example
that comes out.  Prefixes are compared and rendered within the row of a pair.

Two ways to make pairs from a plain table: ``pairs_by_opening`` groups the
conversations that begin with the same turn and takes the first of a group
(smallest id) as the chosen one for each other, so that a group of any size
gives one pair per conversation and never all pairs; ``pairs_by_answer``
rejects, for each conversation up to its last answer, the last answer of its
partner (ids 2k and 2k + 1) put in place of its own.

Defined results: a null role or text is the empty string; of turns repeated
under one number the smallest (role, text) counts; turns are ordered by
number, gaps are ignored; identical conversations have empty completions; a
pair with nothing in common has an empty prompt; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import checkpointed

# The markers of the chat template.
START, END = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` without nulls and repeated numbers."""
    empty = F.lit("")
    rows = conversations.select(
        "conv_id", "turn",
        F.struct(
            F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
        ).alias("said"),
    ).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    # dealt by conversation once, for this grouping and that of ``numbered``
    once = rows.repartition("conv_id").groupBy("conv_id", "turn").agg(F.min("said").alias("said"))
    return once.select("conv_id", "turn", "said.role", "said.text")


def numbered(rows: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order."""
    return rows.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
        ).alias("said")
    )


def pairs_by_opening(chats: DataFrame) -> DataFrame:
    """``(chosen_id, rejected_id, chosen, rejected)`` from ``numbered`` rows."""
    start = F.col("said")[0]
    opening = F.sha2(F.concat_ws("\x00", start["role"], start["text"]), 256)
    keyed = chats.select("conv_id", opening.alias("opening"))
    groups = keyed.groupBy("opening").agg(
        F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("members")
    )
    # pairs of ids first: conversations whose opening is their own, mostly
    # all, are not shuffled with their texts
    groups = checkpointed(groups.where("members > 1").select("opening", "chosen_id"))
    pairs = keyed.join(groups, "opening").where("conv_id > chosen_id")
    pairs = checkpointed(pairs.select("chosen_id", F.col("conv_id").alias("rejected_id")))
    rejected = chats.select(F.col("conv_id").alias("rejected_id"), F.col("said").alias("rejected"))
    chosen = chats.select(F.col("conv_id").alias("chosen_id"), F.col("said").alias("chosen"))
    return pairs.join(rejected, "rejected_id").join(chosen, "chosen_id").select(
        "chosen_id", "rejected_id", "chosen", "rejected"
    )


def pairs_by_answer(chats: DataFrame) -> DataFrame:
    """Pairs of each conversation with an answer (an assistant turn) and a
    partner that has one; both ids are the conversation's."""
    at = F.array_max(
        F.transform("said", lambda t, i: F.when(t["role"] == "assistant", i))
    )
    rows = chats.withColumn("at", at).where("at IS NOT NULL")
    answers = rows.select(
        F.col("conv_id").cast("bigint").bitwiseXOR(F.lit(1)).alias("id"),
        F.get("said", F.col("at")).alias("answer"),
    )
    rows = rows.withColumn("id", F.col("conv_id").cast("bigint"))
    before = F.slice("said", 1, F.col("at"))
    return rows.join(answers, "id").select(
        F.col("conv_id").alias("chosen_id"),
        F.col("conv_id").alias("rejected_id"),
        F.slice("said", 1, F.col("at") + 1).alias("chosen"),
        F.concat(before, F.array("answer")).alias("rejected"),
    )


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns that both begin with."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    differ = F.filter(
        F.sequence(F.lit(0), shorter), lambda i: ~F.get(chosen, i).eqNullSafe(F.get(rejected, i))
    )
    return F.least(F.coalesce(F.get(differ, F.lit(0)), shorter), shorter)


def segments(said: Column) -> Column:
    """Template segments ``(text, trained)`` of an array of turns: a header
    and an untrained body, or, for the assistant, a trained body."""
    return F.flatten(
        F.transform(
            said,
            lambda t: F.array(
                F.struct(
                    F.concat(F.lit(START), t["role"], F.lit("\n")).alias("text"),
                    F.lit(False).alias("trained"),
                ),
                F.struct(
                    F.concat(t["text"], F.lit(END + "\n")).alias("text"),
                    (t["role"] == "assistant").alias("trained"),
                ),
            ),
        )
    )


def render(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def spans(parts: Column) -> Column:
    """Character spans ``[start, end)`` of the trained segments."""
    ends = F.aggregate(
        parts,
        F.struct(
            F.lit(0).cast("bigint").alias("at"),
            F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        ),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s["text"])).alias("at"),
            F.when(
                s["trained"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            acc["at"].alias("start"),
                            (acc["at"] + F.length(s["text"])).alias("end"),
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return ends["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``(chosen_id, rejected_id, n_common, prompt, chosen, rejected,
    chosen_spans, rejected_spans)`` of rows of pairs; the spans
    index the completions."""
    df = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    df = df.withColumn("p", F.slice("chosen", 1, F.col("n_common")))
    for side in ("chosen", "rejected"):
        rest = F.slice(F.col(side), F.col("n_common") + 1, F.size(side))
        df = df.withColumn(f"{side}_parts", segments(rest))
    return df.select(
        "chosen_id", "rejected_id", F.col("n_common").cast("bigint").alias("n_common"),
        render(segments(F.col("p"))).alias("prompt"),
        render(F.col("chosen_parts")).alias("chosen"),
        render(F.col("rejected_parts")).alias("rejected"),
        spans(F.col("chosen_parts")).alias("chosen_spans"),
        spans(F.col("rejected_parts")).alias("rejected_spans"),
    )
