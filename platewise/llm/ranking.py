"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

Every document has a vector of text signals (shares of characters and words,
lengths, repetition), made by SQL functions from its whole text.  A pair is a
document labelled 1, the preferred one, and one labelled 0; the chance that
the first is preferred is the logistic function of the difference of their
scores, so the weights are a logistic regression without intercept on the
differences of their signals.  Every second pair is turned round, with label 0.

The cut is a quantile of the scores of the labelled rows: the share of label
0 among them.  A document's ``score`` is the logistic function of its distance from the
cut, moved so that the cut is ``at``.

The signals of all documents are measured once and kept.  The fit uses every
labelled row, each paired with ``partners`` documents of the other label; pairs and
cut come from places in a sort by range, so no task sees more than its range.  Scoring
is a projection of the kept signals: no text is shuffled, but for those of ids that
several documents have.

Defined results: null and empty texts have all signals 0 and a score like
any other; only rows with label 0 or 1 are learnt from; an id labelled both ways is not learnt
from; without documents of both labels all scores are 0.5; a null id is not held out;
rows that repeat an id are scored one by one; an empty table gives an empty
result; a text of any length is read whole; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import BROADCAST_BYTES, checkpointed, space_words

PARTNERS = 3
# Ridge penalty of the regression: the labels can be separable.
PENALTY = 1e-3
MAX_ITERATIONS = 50

SIGNALS = (
    "log_words", "word_length", "distinct_words", "repeated_next", "upper", "digit", "symbol",
    "exclaim", "comma_stop", "bar", "letter", "lines_per_word", "capital_words", "short_words",
)


def signals(text: Column) -> Column:
    """The signals of a text as an array of doubles, in the order of ``SIGNALS``."""
    text = F.coalesce(text, F.lit(""))

    def measured(words: Column) -> Column:
        n = F.size(words)
        per_word = lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))
        chars = F.length(F.array_join(words, ""))
        per_char = lambda x: F.coalesce(F.try_divide(x.cast("double"), chars), F.lit(0.0))
        count = lambda pattern: F.length(F.regexp_replace(text, f"[^{pattern}]", ""))
        # a word that equals the one before it
        again = F.size(
            F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda x: x)
        )
        return F.array(
            F.log1p(n.cast("double")),
            per_word(chars),
            per_word(F.size(F.array_distinct(words))),
            per_word(again),
            per_char(count(r"\p{Lu}")),
            per_char(count("0-9")),
            F.log1p(per_word(count("#*$%&<>{}=~^@")) * 10),
            F.log1p(per_word(count("!?")) * 10),
            per_word(count(".,;:")),
            per_word(count("|")),
            per_char(count(r"\p{L}")),
            per_word(count("\n")),
            per_word(F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))),
            per_word(F.size(F.filter(words, lambda w: F.length(w) <= 2))),
        )

    # a one-element array binds the words once
    return F.transform(F.array(space_words(text)), measured)[0]


def held_out(doc_id: Column) -> Column:
    """CRC-32 of the id's text modulo 4 is 2."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def measured(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, x)``: the signals of every document, kept."""
    text = F.col(f"`{text_col}`").cast("string")
    return checkpointed(docs.select(F.col(f"`{id_col}`").alias("id"), signals(text).alias("x")))


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(id, good)`` of all ids that are learnt from."""
    known = labels.where(F.col(f"`{label_col}`").isin(0, 1)).groupBy(F.col(f"`{id_col}`").alias("id"))
    known = known.agg(F.min(f"`{label_col}`").alias("good"), F.max(f"`{label_col}`").alias("most"))
    known = known.where((F.col("good") == F.col("most")) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    return known.select("id", "good")


def _texts(docs: DataFrame, known: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``(id, good, text)``; rows that repeat an id are learnt from once."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if known.count() * 64 <= BROADCAST_BYTES:
        known = F.broadcast(known)
    return rows.join(known, "id").groupBy("id", "good").agg(F.min("text").alias("text"))


def training_rows(
    docs: DataFrame, labels: DataFrame, sample_rows: int | None, text_col: str, id_col: str, label_col: str
) -> DataFrame:
    """``(id, good, text)`` of the labelled rows that are not held out; with
    ``sample_rows`` about so many, those whose hash is below the fraction wanted."""
    known = labelled(labels, id_col, label_col)
    if sample_rows is not None:
        share = min(1.0, sample_rows / max(known.count(), 1))
        h = F.xxhash64(F.col("id").cast("string"))
        known = known.where(F.shiftrightunsigned(h, 11) < int(share * (1 << 53)))
    return _texts(docs, known, text_col, id_col)


def training_signals(
    docs: DataFrame, found: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str
) -> DataFrame:
    """``(id, good, x)`` of all labelled rows that are not held out, from
    ``found``, the measured documents."""
    rows = found.join(labelled(labels, id_col, label_col), "id").groupBy("id", "good")
    rows = checkpointed(rows.agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x")))
    once = rows.where("n = 1").select("id", "good", "x")
    again = rows.where("n > 1").select("id", "good")
    if again.isEmpty():
        return once
    texts = _texts(docs, again, text_col, id_col)
    return once.unionByName(texts.select("id", "good", signals(F.col("text")).alias("x")))


def placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """Adds ``place``, 0 and up by ``order`` within the group: rows are sorted
    by range and numbered from the sizes of the sorted partitions."""
    ordered = checkpointed(
        rows.orderBy(group, *order).withColumns(
            {"part": F.spark_partition_id(), "mark": F.monotonically_increasing_id()}
        )
    )
    sizes = ordered.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("first"))
    # a row per partition and group
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    offsets = sizes.select("part", group, offset.alias("offset"))
    return ordered.join(F.broadcast(offsets), ["part", group]).select(
        *rows.columns, (F.col("mark") + F.col("offset")).alias("place")
    )


def quantile(rows: DataFrame, value: Column, share: float) -> float:
    """The exact percentile over ``rows(id, ...)``, between the two values
    next to it; equal values are spread by a hash of the id."""
    scored = rows.select(F.lit(0).alias("group"), value.alias("value"), F.xxhash64("id").alias("h"))
    scored = placed(scored, "group", F.col("value"), F.col("h"))
    at = share * (scored.count() - 1)
    low, high = math.floor(at), math.ceil(at)
    found = {r.place: r.value for r in scored.where(F.col("place").isin(low, high)).collect()}
    if found[low] == found[high]:
        return found[low]
    return (high - at) * found[low] + (at - low) * found[high]


def preference_pairs(rows: DataFrame, partners: int) -> DataFrame:
    """``(features, label)``: differences of the signals of documents of both
    labels.  ``rows(id, good, x)`` are the labelled documents; each meets
    ``partners`` of the other label, by their places in hash order."""
    numbered = placed(rows, "good", F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.col("id"))
    sizes = {r.good: r.n for r in numbered.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    sides = []
    for mine, other in ((1, 0), (0, 1)):
        asked = numbered.where(F.col("good") == mine).select(
            "x", F.explode(F.sequence(F.lit(0), F.lit(partners - 1))).alias("k"), "place"
        )
        nth = F.col("place") * partners + F.col("k")
        asked = asked.select("x", (nth % sizes[other]).alias("at"), (nth % 2 == 0).alias("turned"))
        met = numbered.where(F.col("good") == other).select(F.col("x").alias("y"), F.col("place").alias("at"))
        better, worse = ("x", "y") if mine else ("y", "x")
        sides.append(asked.join(met, "at").select(F.col(better).alias("p"), F.col(worse).alias("q"), "turned"))
    pairs = sides[0].unionByName(sides[1])
    turned = F.col("turned")
    first, second = F.when(turned, F.col("q")).otherwise(F.col("p")), F.when(turned, F.col("p")).otherwise(F.col("q"))
    gap = F.zip_with(first, second, lambda a, b: a - b)
    return pairs.select(
        array_to_vector(gap).alias("features"), F.when(turned, 0.0).otherwise(1.0).alias("label")
    )


def raw_score(x: Column, weights: list[float]) -> Column:
    """Sum of weighted signals."""
    return sum((x[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))


def fit(
    docs: DataFrame, labels: DataFrame, partners: int = PARTNERS,
    text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", found: DataFrame | None = None,
) -> tuple[list[float], float] | None:
    """``(weights, cut)``; None without documents of both labels.  ``found``
    are the documents' signals, if they are ``measured`` already."""
    found = measured(docs, text_col, id_col) if found is None else found
    rows = training_signals(docs, found, labels, text_col, id_col, label_col)
    pairs = preference_pairs(rows, partners)
    if pairs is None:
        return None
    pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK)
    model = LogisticRegression(
        fitIntercept=False, regParam=PENALTY, maxIter=MAX_ITERATIONS, standardization=True
    ).fit(pairs)
    pairs.unpersist()
    weights = [float(w) for w in model.coefficients]
    share = rows.agg(F.avg(1.0 - F.col("good"))).first()[0]
    return weights, float(quantile(rows, raw_score(F.col("x"), weights), float(share)))


def score_documents(
    docs: DataFrame, model: tuple[list[float], float] | None, at: float = 0.7,
    text_col: str = "text", id_col: str = "doc_id", found: DataFrame | None = None,
) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every document; ``found`` as
    in ``fit``."""
    if model is None:
        rows, score = docs.select(F.col(f"`{id_col}`").alias("id")), F.lit(0.5)
    else:
        weights, cut = model
        rows = found
        if rows is None:
            text = F.col(f"`{text_col}`").cast("string")
            rows = docs.select(F.col(f"`{id_col}`").alias("id"), signals(text).alias("x"))
        above = raw_score(F.col("x"), weights) - cut
        # exactly ``at`` on the cut
        score = 1 / (1 + F.exp(-above) * ((1 - at) / at))
    scored = rows.select("id", held_out(F.col("id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= at, 1).otherwise(0))
