"""Keyword classification of web pages.

Both operators are single projections over the page table: no join and no
shuffle, so they scale with the number of pages and keep each page's whole
text.  The keyword dictionary is a small parameter; every keyword becomes
one ``instr`` test in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.schema import CUISINE_KEYWORDS, UNKNOWN

# Regular expressions valid in both Java and RE2 (no back-references).
HIDDEN_ELEMENTS = (
    r"(?is)<script\b[^>]*>.*?</script\s*>"
    r"|<style\b[^>]*>.*?</style\s*>"
    r"|<template\b[^>]*>.*?</template\s*>"
)
COMMENTS = r"(?s)<!--.*?-->"
DOCTYPE = r"(?i)<!doctype[^>]*>"
TAGS = r"</?[A-Za-z!?][^>]*>"
SPACES = r"[ \t\n\r\f\x0B\u00A0]+"
# An entity reference behind its ampersand.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# Named entities of HTML 4, from the standard library's table.
NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
MAX_CONFIDENCE = 95.0


def _decoded(part: Column) -> Column:
    """Text that follows an ampersand, with its entity reference replaced;
    what is no known reference keeps the ampersand."""
    name = F.regexp_extract(part, REFERENCE, 1)
    digits = F.when(name.rlike("^#[0-9]"), F.substr(name, F.lit(2)).cast("bigint")).when(
        name.startswith("#"), F.conv(F.substr(name, F.lit(3)), 16, 10).cast("bigint")
    )
    valid = ((digits > 0) & (digits < 0xD800)) | ((digits > 0xDFFF) & (digits < 0x110000))
    number = F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32")
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    char = F.when(name.startswith("#"), F.when(valid, number)).otherwise(
        F.try_element_at(names, name)
    )
    kept = F.concat(F.lit("&"), part)
    return F.when(name == "", kept).otherwise(
        F.coalesce(F.concat(char, F.substr(part, F.length(name) + 2)), kept)
    )


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, each decoded once."""
    decoded = F.transform(F.split(text, "&"), lambda part, i: F.when(i == 0, part).otherwise(_decoded(part)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def visible_text(html: Column) -> Column:
    """The visible text of an HTML document: scripts, styles,
    templates, comments and the doctype removed, every tag a blank, entities
    decoded, runs of white space (also no-break spaces) one blank, trimmed."""
    text = F.regexp_replace(html, HIDDEN_ELEMENTS, " ")
    text = F.regexp_replace(text, COMMENTS, " ")
    text = F.regexp_replace(text, DOCTYPE, " ")
    text = decode_entities(F.regexp_replace(text, TAGS, " "))
    return F.trim(F.regexp_replace(text, SPACES, " "))


def page_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """N1 over a page table: (page id, visible text)."""
    return pages.select(id_col, visible_text(F.col(html_col)).alias("text"))


def classify_text(
    lowered: Column,
    dictionary: Sequence[tuple[str, Sequence[str]]] = CUISINE_KEYWORDS,
) -> Column:
    """N2 as one expression: a struct with cuisine, confidence and hits.

    Hits of a category = number of its keywords found in the text, which
    is given lower-cased.  The best category has the most hits, the first in dictionary
    order on ties; confidence = hits / keywords × 100, at most 95.  No hit
    gives 'Unknown' with confidence 0.
    """
    candidates = []
    for order, (category, words) in enumerate(dictionary):
        keywords = F.array(*[F.lit(w.lower()) for w in words])
        hits = F.size(F.filter(keywords, lambda w: F.contains(lowered, w)))
        candidates.append(
            F.struct(
                hits.alias("hits"),
                F.lit(-order).alias("neg_order"),
                F.lit(category).alias("cuisine"),
                F.least(hits / F.lit(len(words)) * 100, F.lit(MAX_CONFIDENCE)).alias("confidence"),
            )
        )
    # 'Unknown' wins only when every category has 0 hits (its order key is
    # above every category's); no CASE branches around the shared result,
    # so Spark evaluates the text and the comparison once per row
    candidates.append(
        F.struct(
            F.lit(0).alias("hits"),
            F.lit(1).alias("neg_order"),
            F.lit(UNKNOWN).alias("cuisine"),
            F.lit(0.0).alias("confidence"),
        )
    )
    return F.greatest(*candidates)


def page_keywords(
    pages: DataFrame,
    dictionary: Sequence[tuple[str, Sequence[str]]] = CUISINE_KEYWORDS,
    html_col: str = "html",
    id_col: str = "page_id",
) -> DataFrame:
    """N1 + N2: best keyword category of each page's visible text.  The text
    and the best category are projections of their own, so each is made once
    per page."""
    text = pages.select(id_col, F.lower(visible_text(F.col(html_col))).alias("_text"))
    best = text.select(id_col, classify_text(F.col("_text"), dictionary).alias("r"))
    return best.select(id_col, "r.cuisine", "r.confidence", F.col("r.hits").cast("int").alias("hits"))
