"""C2 for tables of patterns: an n-gram index over the distinct texts.

A regular expression that matches a text needs some literal part of it there.
``needed`` reads from the parsed pattern a set of literals, one of which is in
every text that matches.  The index lists those 1-, 2- and 3-grams of every
distinct text that the literals have; a literal looks up its rarest gram only, and a literal with a
gram that no text has is out.  The texts found are candidates, which the
regular expression then decides; the join is on the gram, so patterns and texts
are tables of any size and never meet in one array.

Grams are folded: A-Z and the four other letters that match an ASCII letter when
case is ignored become that letter.  Literals use ASCII characters only, so folding
can add candidates, but not lose any.  A pattern without a needed literal
(like ``.*``) is tried on every distinct text; one that is no regular expression
matches nothing.
"""

from __future__ import annotations

import re
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3
# Literals followed side by side while a pattern is read.
ALTERNATIVES = 16
# Asked grams are broadcast up to so many, counted.
SENT_GRAMS = 200_000
# Letters that Python takes as equal to ASCII letters when case is ignored.
FOLDED = ("ſıİK", "siik")


def _joined(heads: list[str], tails: list[str]) -> list[str] | None:
    out = [h + t for h in heads for t in tails]
    return out if len(out) <= ALTERNATIVES else None


def _literals(items) -> list[str] | None:
    """All strings that ``items`` can match, if they are few and fixed."""
    runs = [""]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            runs = [r + chr(arg).lower() for r in runs]
        elif name == "AT":
            continue
        elif name == "IN" and all(str(o) == "LITERAL" and a < 128 for o, a in arg):
            runs = _joined(runs, [chr(a).lower() for _, a in arg])
        elif name == "SUBPATTERN":
            inner = _literals(arg[3])
            runs = inner and _joined(runs, inner)
        elif name == "BRANCH":
            parts = [_literals(p) for p in arg[1]]
            runs = None if None in parts else _joined(runs, [s for p in parts for s in p])
        else:
            return None
        if runs is None:
            return None
    return runs


def _best(covers: list[list[str]]) -> list[str] | None:
    """The cover whose shortest literal is longest; then the smaller one."""
    usable = [c for c in covers if c and all(c)]
    return max(usable, key=lambda c: (min(GRAM, min(map(len, c))), -len(c)), default=None)


def _cover(items) -> list[str] | None:
    """Literals one of which is in every match of ``items``; None if there
    need not be any."""
    covers, run = [], [""]
    for item in items:
        name, arg = str(item[0]), item[1]
        if name in ("AT", "ASSERT", "ASSERT_NOT"):  # no characters of its own
            continue
        fixed = _literals([item])
        longer = fixed and _joined(run, fixed)
        if longer:
            run = longer
            continue
        covers.append(run)
        run = fixed or [""]
        if fixed:
            continue
        if name == "SUBPATTERN":
            covers.append(_cover(arg[3]) or [])
        elif name == "ATOMIC_GROUP":
            covers.append(_cover(arg) or [])
        elif name == "BRANCH":
            parts = [_cover(p) for p in arg[1]]
            covers.append([] if None in parts else sorted({s for p in parts for s in p}))
        elif name.endswith("REPEAT") and arg[0] > 0:
            covers.append(_cover(arg[2]) or [])
    return _best([*covers, run])


def needed(pattern: str) -> list[str] | None:
    """Folded literals one of which is in every text that matches; [] if there
    need not be any, None if the pattern is no regular expression."""
    try:
        re.compile(pattern, re.IGNORECASE)
        tree = parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None
    return _cover(tree) or []


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, *FOLDED))


def _begins(grams: Column, size: int) -> Column:
    return F.transform(grams, lambda gram: F.substring(gram, 1, size))


def _grams(text: Column) -> Column:
    """The grams of a text: at every place the next ``GRAM`` characters (fewer
    at the end) and what they begin with."""
    whole = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{GRAM}}}))."), F.lit(1))
    whole = F.array_distinct(whole)
    return F.array_distinct(F.concat(whole, *[_begins(whole, n) for n in range(1, GRAM)]))


def text_grams(texts: DataFrame, text: str) -> DataFrame:
    """``(text, gram)``: the distinct grams of every text; the empty gram is
    in all of them."""
    grams = F.concat(F.array(F.lit("")), _grams(folded(F.col(text))))
    return texts.select(text, F.explode(grams).alias("gram"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _needed(patterns):
    import pandas as pd

    return pd.Series([needed(p) for p in patterns], dtype=object)


@F.pandas_udf(T.BooleanType())
def _matches(patterns, texts):
    import pandas as pd

    known: dict[str, re.Pattern] = {}

    def found(pattern: str, text: str) -> bool:
        if pattern not in known:
            if len(known) >= 4096:
                known.clear()
            known[pattern] = re.compile(pattern, re.IGNORECASE)
        return known[pattern].search(text) is not None

    return pd.Series([found(p, t) for p, t in zip(patterns, texts)], dtype=bool)


def candidates(patterns: DataFrame, pattern: str, texts: DataFrame, text: str) -> DataFrame:
    """``(pattern, text)`` pairs that the index cannot rule out, of distinct
    non-null patterns and texts."""
    asked = patterns.withColumn("literals", _needed(F.col(pattern))).where("literals IS NOT NULL")
    whole = F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit("")))
    asked = asked.select(pattern, F.explode(whole).alias("literal"))
    low = F.col("literal")
    longest = F.filter(_grams(low), lambda g: F.length(g) == GRAM)
    own = F.when(F.length(low) > GRAM, longest).otherwise(F.array(low))
    asked = asked.select(pattern, "literal", F.explode(own).alias("gram"))
    # the index has the grams that are asked for; they are sent to the texts if
    # they are few, so that the others are dropped where they are made
    wanted = asked.select("gram").distinct()
    if wanted.count() <= SENT_GRAMS:
        wanted = F.broadcast(wanted)
    grams = text_grams(texts, text).join(wanted, "gram", "left_semi")
    sizes = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # the rarest gram of each literal, if all of them occur
    rarest = (
        asked.join(sizes, "gram", "left")
        .groupBy(pattern, "literal")
        .agg(
            F.min_by("gram", F.struct("df", "gram")).alias("gram"),
            F.count_if(F.col("df").isNull()).alias("absent"),
        )
        .where("absent = 0")
    )
    return rarest.join(grams, "gram").select(pattern, text).distinct()


def matching_texts(patterns: DataFrame, pattern: str, texts: DataFrame, text: str) -> DataFrame:
    """``(pattern, text)`` for every pattern that occurs in a text, case
    ignored; patterns and texts are distinct and not null."""
    return candidates(patterns, pattern, texts, text).where(_matches(F.col(pattern), F.col(text)))
