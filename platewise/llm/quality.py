"""Quality rules as a short-circuit cascade (DataFrame functions only).

Every rule is an expression over a few text signals.  ``plan_cascade`` times
each rule on a bounded sample and counts what it rejects there, then orders
the rules by rejection per cost; ``verdict`` chains them in that order in one
CASE, so a document that a cheap, selective rule rejects never pays for the
dear ones.  The order has no effect on which documents are kept, only on the
work done, so the sample may be any rows.

There is no shuffle: each document is judged in its own row.  Repeated word
windows are found by one sort of packed (hash prefix, position) longs.

Defined results: a null or empty text has no words and zero signals, so it
fails the length rule; repeated rows are judged one by one; an empty table
gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import packed, space_words

# Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 400

NON_SPACE = r"[^ \t\n\x0B\f\r]"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an SQL condition over the signals that it names."""

    name: str
    rejects: str

    def signals(self) -> list[str]:
        return [s for s in SIGNALS if s in self.rejects]


BASE_RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
# Far from what ordinary prose shows: a symbol on every second word, half of
# the words on repeated lines, words of one letter or of a whole line.
EXTRA_RULES = (
    Rule("symbols", "2 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 5 AND 10 * n_dup_lines > n_words"),
)
RULES = BASE_RULES + EXTRA_RULES


def _window_hashes(words: Column, width: int) -> Column:
    last = F.size(words) - width
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _with_repeats(df: DataFrame, width: int = 3) -> DataFrame:
    """Adds ``n_repeat_words``: words inside a window of ``width`` words that
    the text holds twice or more.

    The window hashes lose their low bits to the position and are sorted as
    plain longs; neighbours with equal prefixes are candidates.  If two
    different windows of a text share a prefix, the full hashes decide.
    """
    df = df.withColumn("q_hash", _window_hashes(F.col("q_words"), width))
    df = df.withColumn("q_bits", F.length(F.bin(F.size("q_hash"))))

    def prefix(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col("q_bits"))

    keyed = F.transform(
        "q_hash",
        lambda h, i: F.call_function("shiftleft", prefix(h), F.col("q_bits")).bitwiseOR(
            i.cast("bigint")
        ),
    )
    none = F.array().cast("array<bigint>")
    some = F.size(F.array_distinct("q_hash")) < F.size("q_hash")
    df = df.withColumn("q_sorted", F.when(some, F.sort_array(keyed)).otherwise(none))

    # each sorted value beside the next: equal prefixes mark both
    pairs = F.filter(
        F.arrays_zip(
            F.slice("q_sorted", 1, F.greatest(F.size("q_sorted") - 1, F.lit(0))).alias("x"),
            F.slice("q_sorted", 2, F.greatest(F.size("q_sorted") - 1, F.lit(0))).alias("y"),
        ),
        lambda p: prefix(p["x"]) == prefix(p["y"]),
    )
    df = df.withColumn("q_pairs", F.when(F.size("q_sorted") > 0, pairs))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("q_bits")) - 1
    df = df.withColumn(
        "q_at",
        F.when(
            F.size("q_pairs") > 0,
            F.array_union(
                F.transform("q_pairs", lambda p: p["x"].bitwiseAND(mask).cast("int")),
                F.transform("q_pairs", lambda p: p["y"].bitwiseAND(mask).cast("int")),
            ),
        ).otherwise(F.array().cast("array<int>")),
    )
    full = F.transform("q_at", lambda i: F.get("q_hash", i))
    df = df.withColumn("q_full", full)
    collides = F.size(F.array_distinct("q_full")) != F.size(
        F.array_distinct(F.transform("q_full", prefix))
    )
    exact = F.filter(
        "q_at",
        lambda i: F.size(F.filter("q_full", lambda h: h == F.get("q_hash", i))) > 1,
    )
    df = df.withColumn("q_at", F.when(collides, exact).otherwise(F.col("q_at")))
    covered = F.col("q_at")
    for step in range(1, width):
        later = F.transform("q_at", lambda i: i + step)  # noqa: B023
        covered = F.array_union(covered, later)
    return df.withColumn("n_repeat_words", F.size(covered).cast("bigint"))


def _add_signals(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the named signals to rows that have ``q_text`` and ``q_words``."""
    text = F.coalesce(F.col("q_text"), F.lit(""))
    df = df.withColumn("n_words", F.size("q_words").cast("bigint"))
    if "word_chars" in names:
        df = df.withColumn("word_chars", F.length(F.array_join("q_words", "")).cast("bigint"))
    if "n_symbols" in names:
        symbols = F.regexp_replace(text, r"[^#*$%&|<>]+", "")
        df = df.withColumn("n_symbols", F.length(symbols).cast("bigint"))
    if "n_dup_lines" in names:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NON_SPACE))
        df = df.withColumn("q_lines", lines)
        repeats = F.size("q_lines") - F.size(F.array_distinct("q_lines"))
        df = df.withColumn("n_dup_lines", repeats.cast("bigint"))
    return _with_repeats(df) if "n_repeat_words" in names else df


def with_signals(
    docs: DataFrame, names: Sequence[str], text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``id_col``, ``n_words`` and the named signals of every row (``bigint``)."""
    df = docs.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text"))
    df = _add_signals(df.withColumn("q_words", space_words(F.col("q_text"))), names)
    keep = [n for n in SIGNALS if n in names or n == "n_words"]
    return df.select(F.col("q_id").alias(id_col), *keep)


def plan_cascade(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """The rules ordered by rejections per second on at most ``sample_rows``
    rows."""
    sample = docs.select(F.lit(0).alias("q_key"), F.col(text_col).alias("q_text"))
    sample = sample.limit(sample_rows).persist(StorageLevel.MEMORY_AND_DISK)
    rows = max(1, sample.count())
    ranked = []
    for position, rule in enumerate(rules):
        judged = with_signals(sample, rule.signals(), "q_text", "q_key")
        began = time.perf_counter()
        rejected = judged.select(F.count_if(F.expr(rule.rejects))).first()[0]
        cost = max(time.perf_counter() - began, 1e-6)
        # one rejection is assumed, so that rules that reject nothing in the
        # sample are still ordered by cost
        ranked.append((-(rejected + 1) / (rows * cost), position, rule))
    sample.unpersist()
    return [rule for *_, rule in sorted(ranked, key=lambda r: r[:2])]


def verdict(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects the row, null if none does."""
    chain = F.when(F.expr(rules[0].rejects), F.lit(rules[0].name))
    for rule in rules[1:]:
        chain = chain.when(F.expr(rule.rejects), F.lit(rule.name))
    return chain


def quality_report(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Signals and verdict of every row: the signals, ``base_failed``,
    ``kept`` and ``failed_rule`` (the first rejecting rule in cascade order)."""
    ordered = plan_cascade(docs, rules, text_col)
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | F.expr(rule.rejects)
    out = with_signals(docs, SIGNALS, text_col, id_col)
    return out.withColumns({"base_failed": base, "failed_rule": verdict(ordered)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("failed_rule").isNull()
    )


def quality_filter(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they are.

    One filter per rule in cascade order: a rule's signals are computed only
    for rows that passed the filters before it.  Each judgement passes
    through ``explode`` of a one-element array, which keeps the optimizer
    from copying the signal expressions into the filters.
    """
    ordered = plan_cascade(docs, rules, text_col)
    left = packed(docs, F.col(text_col).alias("q_text"))
    left = left.withColumn("q_words", space_words(F.col("q_text")))
    for rule in ordered:
        judged = _add_signals(left, rule.signals())
        bad = F.explode(F.array(F.expr(rule.rejects)))
        left = judged.select("row", "q_text", "q_words", bad.alias("q_bad")).where("NOT q_bad")
    return left.select("row.*")
