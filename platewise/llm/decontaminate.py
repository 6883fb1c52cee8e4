"""Benchmark decontamination as a prefix-filtered set join (DataFrame
functions only).

Every benchmark item gives windows of ``size`` consecutive words (one window
if it has fewer).  A window is a sequence of word shingles; all shingles have
to occur, so the necessary prefix, under any global order, is one shingle.
The order is rarity in the corpus: a first pass counts how often each
benchmark shingle occurs in all documents, and the rarest of a window becomes
its key.  The second pass joins document shingles with the keys, applies the
positional bound (the window must start inside the text) and the length bound
(and end inside it), and verifies the words of the window exactly.

Windows are joined once per text, whatever number of items holds them.  Hits
are spread to word positions and counted distinct, so overlapping windows
count each word once.

If the windows measure under ``BROADCAST_BYTES`` they are broadcast and the
documents are neither shuffled nor read twice in that pass; beyond that the
keys are joined by shuffle on the shingle hash alone, and the words are
fetched by document only for the candidates.

Defined results: a null text or item has no words; items without words never
match; a text repeated under one id is judged once and returned for each row;
rows of one id with different texts are judged one by one; other columns are
not read; empty tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import BROADCAST_BYTES, ascii_lower, checkpointed, without

# Everything in ASCII that is neither a digit nor a letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def lower_words(text: Column) -> Column:
    split = F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")
    return F.coalesce(split, F.array().cast("array<string>"))


def _shingle(words: Column, at: Column, width: int) -> Column:
    """Hash of the ``width`` words from ``at`` (0-based); the width is hashed
    too, so that short items have keys of their own."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)])


def item_windows(items: DataFrame, size: int, text_col: str, item_col: str) -> DataFrame:
    """``(item_id, words)``: the windows of every item that has words."""
    df = items.select(F.col(item_col).alias("item_id"), lower_words(F.col(text_col)).alias("w"))
    df = df.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    df = df.select("item_id", "w", F.explode(starts).alias("s"))
    return df.select("item_id", F.slice("w", F.col("s"), size).alias("words")).distinct()


def _window_shingles(windows: DataFrame) -> DataFrame:
    """``(words, width, off, key)`` for each distinct window."""
    df = windows.select("words").distinct()
    df = df.withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    df = df.select(
        "words", "width", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))).alias("off")
    )
    key = F.when(F.col("width") == 1, _shingle(F.col("words"), F.col("off"), 1))
    for width in range(2, SHINGLE + 1):
        key = key.when(F.col("width") == width, _shingle(F.col("words"), F.col("off"), width))
    return df.withColumn("key", key)


def _texts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``(id, h, w)``: h tells apart the texts of one id."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), lower_words(text).alias("w")
    )


def _positions(texts: DataFrame, widths: list[int], marker: bool) -> DataFrame:
    """One row per word position and shingle width, ``key`` null where the
    text ends before; with ``marker`` also one row at position -1."""
    at = F.sequence(F.lit(-1), F.size("w") - 1)
    if not marker:
        at = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))
    df = texts.select("id", "h", "w", F.explode(at).alias("p"))
    keys = []
    for width in widths:
        inside = (F.col("p") >= 0) & (F.col("p") + width <= F.size("w"))
        keys.append(F.when(inside, _shingle(F.col("w"), F.col("p"), width)))
    if len(keys) == 1:
        return df.withColumn("key", keys[0])
    none = F.array(F.lit(None).cast("bigint"))
    return df.withColumn("key", F.explode(F.when(F.col("p") < 0, none).otherwise(F.array(*keys))))


def find_windows(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_text_col: str = "text",
    item_col: str = "item_id",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``(found, windows)``.  ``found(id, h, n_words, p, words)`` has a row
    with null ``p`` for every input row and one for each occurrence of a
    window, starting at word ``p``; ``windows(item_id, words)``."""
    windows = checkpointed(item_windows(items, size, item_text_col, item_col))
    shingles = checkpointed(_window_shingles(windows))
    measured = shingles.select(
        F.sum(F.length(F.array_join("words", " ")) + 100).alias("bytes"),
        F.sort_array(F.collect_set("width")).alias("widths"),
    ).first()
    widths = measured["widths"] or [SHINGLE]
    small = (measured["bytes"] or 0) <= broadcast_bytes
    texts = _texts(docs, text_col, id_col)

    known = shingles.select("key").distinct()
    known = F.broadcast(known) if small else known
    seen = _positions(texts, widths, marker=False).select("key")
    counts = seen.join(known, "key").groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    ranked = shingles.join(counts, "key", "left").select(
        "words", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "off").alias("rank")
    )
    # a window one of whose shingles never occurs cannot occur
    prefix = ranked.groupBy("words").agg(F.min("rank").alias("rank")).where("rank.df > 0")
    prefix = checkpointed(
        prefix.select(F.col("words"), F.col("rank.key").alias("key"), F.col("rank.off").alias("off"))
    )

    start = F.col("p") - F.col("off")
    bounds = (start >= 0) & (start + F.size("words") <= F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words")
    if small:
        probe = _positions(texts, widths, marker=True).alias("t")
        right = F.broadcast(prefix).withColumnRenamed("key", "key2")
        rows = probe.join(right, (F.col("key") == F.col("key2")) & bounds & same, "left")
        rows = rows.where("p = -1 OR key2 IS NOT NULL")
    else:
        probe = _positions(texts, widths, marker=False)
        probe = probe.select("id", "h", "key", "p", F.size("w").alias("n"))
        near = probe.join(prefix, "key").where((start >= 0) & (start + F.size("words") <= F.col("n")))
        once = texts.dropDuplicates(["id", "h"]).withColumnsRenamed({"id": "id2", "h": "h2"})
        hits = near.join(once, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")))
        hits = hits.where(same).select("id", "h", "w", "p", "off", "words")
        marks = texts.select(
            "id", "h", "w", F.lit(-1).alias("p"), F.lit(None).cast("int").alias("off"),
            F.lit(None).cast("array<string>").alias("words"),
        )
        rows = hits.unionByName(marks)
    found = rows.select(
        "id", "h", F.size("w").cast("bigint").alias("n_words"),
        F.when(F.col("p") >= 0, start).alias("p"), "words",
    )
    return checkpointed(found), windows


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_text_col: str = "text",
    item_col: str = "item_id",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per input row: ``id``, ``h`` (the text's hash), ``n_words``, ``n_hit``
    (words inside an occurrence of a window) and ``items`` (sorted strings of
    the items with occurring windows, an array bounded by the items)."""
    found, windows = find_windows(
        docs, items, size, text_col, id_col, item_text_col, item_col, broadcast_bytes
    )
    found = found.withColumn("k", F.struct("id", "h"))  # nulls are equal inside a struct
    rows = found.where("p IS NULL").groupBy("k").agg(
        F.max("n_words").alias("n_words"), F.count(F.lit(1)).cast("int").alias("copies")
    )
    hits = found.where("p IS NOT NULL").select("k", "p", "words")
    inside = F.explode(F.sequence(F.col("p"), F.col("p") + F.size("words") - 1))
    n_hit = hits.select("k", inside.alias("at")).distinct().groupBy("k").agg(
        F.count(F.lit(1)).alias("n_hit")
    )
    held = hits.select("k", "words").distinct().join(windows, "words")
    held = held.select("k", F.col("item_id").cast("string").alias("item")).distinct()
    held = held.groupBy("k").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = rows.join(n_hit, "k", "left").join(held, "k", "left")
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return out.select(
        F.col("k.id").alias("id"), F.col("k.h").alias("h"), "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` whose text holds no window, all columns as they are."""
    found, _ = find_windows(docs, items, size, text_col, id_col)
    gone = found.where("p IS NOT NULL").select(
        F.col("id").alias(id_col), F.col("h").alias("decon_h")
    )
    return without(docs, gone.distinct(), id_col, "decon_h", F.xxhash64(F.col(text_col)))
