"""The k most similar documents of each query without multiplying
documents that cannot be among them.

The index is the table of postings ``(document, token, weight, block, layer)`` of the
tokens that the queries have, numbered.  A
document's block is the order of magnitude of its distinct tokens, since the
weights of a unit vector shrink with their number; a posting's layer is the
order of magnitude of its weight, in half octaves.  Per token, block and layer it
knows the largest weight and the number of postings.

1. Seeds: a query's rarest postings, ``SEED_POSTINGS`` for each wanted result,
   name documents; the k best by those are scored in full.  The smallest of
   these k scores is a floor: the query's k-th best score is not below it.
2. Bounds: a posting adds at most query weight x largest weight of its layer.
   In each block, layers are made optional, a token's lower ones first and those with
   the most postings per bound first, while the bounds add up to less than the floor:
   a document all of whose shared postings are optional stays below the floor.
3. Candidates come from the other postings only.  The k with the best partial
   scores are scored in full, which raises the floor; candidates whose partial score
   and all optional bounds stay below it go.
4. The optional tokens of the remaining candidates are looked up by
   (document, token).

A token that most documents share is mostly optional, so it is looked up for candidates
and not multiplied with all of its postings.  Every step is an equi join or a partial
aggregate; windows are over the tokens of one query.  The floor only decides how
much is skipped; the results are those of the full product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.session import checkpoint_dir

# Postings of seed tokens for each wanted result.
SEED_POSTINGS = 50
# Scores are ranked by six places: what is this far below the floor is out.
MARGIN = 2e-6
PLACE = ["token", "block", "layer"]
# Tables of the queries are sent to the index, instead of dealing the index anew for each
# step, if they are counted and have no more rows.
SENT_ROWS = 1_000_000


def kept(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def numbered(queries: DataFrame) -> DataFrame:
    """``(token, number)`` of the distinct tokens of the queries."""
    number = F.monotonically_increasing_id().alias("number")
    return kept(queries.select("token").distinct().select("token", number))


def postings(weights: DataFrame, item: str, asked: DataFrame) -> DataFrame:
    """``(item, token, weight, block, layer)`` of unit rows ``(item, token,
    weight)``; of these, those with a token of ``asked(token, number)``, which is
    replaced by its number."""
    tokens = F.count(F.lit(1)).over(Window.partitionBy(item))
    rows = weights.select(
        item, "token", "weight",
        F.floor(F.log2(tokens.cast("double"))).cast("int").alias("block"),
        F.floor(2 * F.log2("weight")).cast("int").alias("layer"),
    )
    found = rows.join(sent(asked, asked.count()), "token")
    return kept(found.select(item, F.col("number").alias("token"), "weight", "block", "layer"))


class Pruned:
    """The steps of one search; ``queries(query, token, qw)`` are unit rows."""

    def __init__(self, queries: DataFrame, index: DataFrame, query: str, item: str, k: int):
        self.query, self.item, self.k, self.index = query, item, k, index
        tops = index.groupBy(*PLACE).agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("df"))
        self.terms = kept(queries.join(tops, "token").select(query, "qw", "df", "top", *PLACE))
        self.n_terms = self.terms.count()
        # what k pairs of each query look up
        self.n_asked = k * self.terms.select(query, "token").distinct().count()

    def _score(self, asked: DataFrame) -> DataFrame:
        """Sums of the products of ``asked(query, token, block, layer, qw)``."""
        asked = asked.select(self.query, "qw", *PLACE)
        products = self.index.join(sent(asked, self.n_terms), PLACE)
        return products.groupBy(self.query, self.item, "block").agg(
            F.sum(F.col("qw") * F.col("weight")).alias("part")
        )

    def _looked_up(self, pairs: DataFrame, terms: DataFrame, few: bool = False) -> DataFrame:
        """``(query, item, found)``: the products of ``pairs(query, item, block, ...)`` with the
        tokens of ``terms`` in their block that the item has in one of the layers of
        ``terms``.  ``few``: the pairs are k of each query at most."""
        upto = terms.groupBy(self.query, "block", "token").agg(
            F.first("qw").alias("qw"), F.max("layer").alias("highest")
        )
        upto = sent(upto, self.n_terms)
        place = [self.query, "block", "token"]
        wanted = pairs.select(self.query, self.item, "block").join(
            upto.select(*place), [self.query, "block"]
        )
        wanted = sent(wanted, self.n_asked) if few else wanted
        held = self.index.select(self.item, "token", "weight", "layer").join(wanted, [self.item, "token"])
        low = held.join(upto, place).where(F.col("layer") <= F.col("highest"))
        return low.select(self.query, self.item, (F.col("qw") * F.col("weight")).alias("found"))

    def seed_terms(self) -> DataFrame:
        # over the tokens of one query
        order = Window.partitionBy(self.query).orderBy("df", F.desc("top"), *PLACE)
        upto = F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rarest = self.terms.withColumns({"upto": upto, "nth": F.row_number().over(order)})
        return rarest.where((F.col("upto") <= SEED_POSTINGS * self.k) | (F.col("nth") == 1))

    def _best(self, scored: DataFrame) -> DataFrame:
        """Each query's k best pairs by partial score."""
        best = Window.partitionBy(self.query).orderBy(F.desc("part"), self.item)
        named = scored.withColumn("nth", F.row_number().over(best))
        return named.where(F.col("nth") <= self.k).select(self.query, self.item, "block")

    def seeds(self) -> DataFrame:
        return self._best(self._score(self.seed_terms()))

    def floors(self, pairs: DataFrame) -> DataFrame:
        """``(query, floor)``: the smallest full score of k pairs of each
        query; queries with fewer have none."""
        whole = self._looked_up(pairs, self.terms, few=True).groupBy(self.query, self.item).agg(
            F.sum("found").alias("score")
        )
        floors = whole.groupBy(self.query).agg(
            F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")
        )
        return floors.where(F.col("n") == self.k).select(self.query, "floor")

    def bounded_terms(self) -> DataFrame:
        """The terms with ``needed``, false for optional ones, and ``adds``,
        what making the layer optional adds to the bound of its block."""
        token = Window.partitionBy(self.query, "block", "token").orderBy("layer")
        lower = F.coalesce(F.lag("top").over(token), F.lit(0.0))
        terms = self.terms.withColumn("adds", F.col("qw") * (F.col("top") - lower))
        # a layer is not dearer than those below it, which go first
        price = F.max(F.col("adds") / F.col("df")).over(
            token.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        terms = terms.withColumn("price", price)
        cheapest = Window.partitionBy(self.query, "block").orderBy("price", "token", "layer")
        upto = F.sum("adds").over(cheapest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        floor = F.coalesce(F.col("floor"), F.lit(0.0)) - MARGIN
        both = terms.join(sent(self.floors(self.seeds()), self.n_asked), self.query, "left")
        return both.withColumn("needed", upto >= floor)

    def candidates(self, terms: DataFrame) -> DataFrame:
        """``(query, item, block, part, reach)`` of the pairs with a needed
        posting; no score is above ``reach``."""
        optional = terms.where(~F.col("needed")).groupBy(self.query, "block").agg(
            F.sum("adds").alias("rest")
        )
        some = self._score(terms.where("needed")).join(
            sent(optional, self.n_terms), [self.query, "block"], "left"
        )
        reach = F.col("part") + F.coalesce("rest", F.lit(0.0))
        return some.withColumn("reach", reach).drop("rest")

    def _steps(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The terms, the k best candidates, all pairs that can still reach the
        floor which those give, and these looked up."""
        terms = kept(self.bounded_terms())
        some = kept(self.candidates(terms))
        best = self._best(some)
        left = some.join(sent(self.floors(best), self.n_asked), self.query, "left")
        left = left.where(F.col("reach") >= F.coalesce("floor", F.lit(0.0)) - MARGIN)
        return terms, best, left, self._looked_up(left, terms.where(~F.col("needed")))

    def scores(self) -> DataFrame:
        """``(query, item, score)`` of a set that holds each query's k best
        documents with a shared token."""
        _, _, left, looked = self._steps()
        parts = left.select(self.query, self.item, F.col("part").alias("found")).unionByName(looked)
        return parts.groupBy(self.query, self.item).agg(F.sum("found").alias("score"))

    def work(self) -> DataFrame:
        """``(query, products_all, products_formed)``: products of the full
        sums, and those of the seeds, the needed postings and the lookups."""
        terms, best, _, looked = self._steps()
        looked = [looked, *(self._looked_up(x, self.terms, few=True) for x in (self.seeds(), best))]
        counts = [x.groupBy(self.query).agg(F.count("found").alias("n")) for x in looked]
        sums = lambda rows: rows.groupBy(self.query).agg(F.sum("df").alias("n"))
        formed = reduce(DataFrame.unionByName, [sums(terms.where("needed")), sums(self.seed_terms()), *counts])
        whole = sums(terms).withColumnRenamed("n", "products_all")
        return whole.join(formed.groupBy(self.query).agg(F.sum("n").alias("products_formed")), self.query)
