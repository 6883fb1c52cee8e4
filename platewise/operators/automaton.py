"""N2 for large dictionaries: all keywords in one pass over a page's text.

The keywords are one Aho-Corasick automaton: a trie whose failure links lead
to the longest suffix that is also a prefix of a keyword, so a text is read once
however many keywords there are, and overlapping keywords are all found.

The dictionary is a table ``(position, category, keyword)``.  It is numbered and cut
into parts of at most ``PART_KEYWORDS`` keywords and ``PART_BYTES`` bytes; a part is
what one Python worker holds.  Pages pass through the parts one after the other without a
shuffle, adding up the hits of each category.

The result is that of ``keywords.page_keywords``: the category with the most
different keywords in the text, the first position on ties.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.keywords import MAX_CONFIDENCE, visible_text
from platewise.schema import UNKNOWN

PART_KEYWORDS = 200_000
PART_BYTES = 8 << 20
HITS = "array<struct<position:int,hits:int>>"


def distinct_keywords(dictionary: DataFrame) -> DataFrame:
    """``(position, keyword)``: lower-cased, each once per category; empty
    and null keywords are out."""
    words = dictionary.select(F.col("position").cast("int"), F.lower("keyword").alias("keyword"))
    return words.where("position IS NOT NULL AND length(keyword) > 0").distinct()


def parts(dictionary: DataFrame) -> list[list[tuple[str, list[int]]]]:
    """The dictionary as lists of (keyword, positions of its categories), read
    by the driver keyword by keyword; a keyword is in one part only."""
    grouped = distinct_keywords(dictionary).groupBy("keyword").agg(
        F.sort_array(F.collect_set("position")).alias("positions")
    )
    out, size = [[]], 0
    for row in grouped.orderBy("keyword").toLocalIterator():
        n = len(row.keyword.encode()) + 8 * len(row.positions)
        if out[-1] and (len(out[-1]) == PART_KEYWORDS or size + n > PART_BYTES):
            out.append([])
            size = 0
        out[-1].append((row.keyword, list(row.positions)))
        size += n
    return out


def _adds_hits(part):
    """Adds a part's hits to the column ``hits`` of batches (id, text, hits)."""

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, (word, _) in enumerate(part.value):
            automaton.add_word(word, number)
        automaton.make_automaton()
        positions = [p for _, p in part.value]

        def counted(text, before):
            hits = Counter({h["position"]: h["hits"] for h in before or ()})
            if text:
                for number in {n for _, n in automaton.iter(text)}:
                    hits.update(positions[number])
            return [{"position": p, "hits": n} for p, n in hits.items()]

        for batch in batches:
            texts, before = batch.column("text").to_pylist(), batch.column("hits").to_pylist()
            kind = pa.list_(pa.struct([("position", pa.int32()), ("hits", pa.int32())]))
            hits = pa.array([counted(t, b) for t, b in zip(texts, before)], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), hits], names=["id", "text", "hits"]
            )

    return run


def keyword_hits(pages: DataFrame, dictionary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, hits)``: per page the number of different keywords of every
    category that occur in the lower-cased text."""
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.array().cast(HITS).alias("hits"),
    )
    for part in parts(dictionary):
        if part:
            shared = spark.sparkContext.broadcast(part)
            rows = rows.mapInArrow(_adds_hits(shared), f"id {id_type}, text string, hits {HITS}")
    return rows.select("id", "hits")


def page_keywords_table(
    pages: DataFrame, dictionary: DataFrame, html_col: str = "html", id_col: str = "page_id"
) -> DataFrame:
    """N1 + N2 with a dictionary table ``(position, category, keyword)``: best
    category of each page, confidence = found / keywords of the category x
    100, at most 95; no hit gives 'Unknown' with confidence 0."""
    text = pages.select(id_col, F.lower(visible_text(F.col(html_col))).alias("text"))
    # ties: the first position
    best = F.array_max(
        F.transform("hits", lambda h: F.struct(h["hits"].alias("hits"), (-h["position"]).alias("last")))
    )
    found = keyword_hits(text, dictionary, id_col, "text").select("id", best.alias("b"))
    names = dictionary.groupBy(F.col("position").cast("int").alias("position")).agg(
        F.min("category").alias("category")
    )
    sizes = distinct_keywords(dictionary).groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.join(names, "position")
    share = F.least(F.col("b.hits") / F.col("n") * 100, F.lit(MAX_CONFIDENCE))
    joined = found.join(sizes, F.col("position") == -F.col("b.last"), "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("category", F.lit(UNKNOWN)).alias("cuisine"),
        F.when(F.col("n").isNull(), 0.0).otherwise(share).alias("confidence"),
        F.coalesce(F.col("b.hits"), F.lit(0)).alias("hits"),
    )
