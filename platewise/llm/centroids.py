"""Centroid clustering: exact k-means whose nearest centroid is found by
Orchard's search.

For every centroid the other centroids are sorted by their distance from it.
A vector walks the list of its best centroid so far.  An unvisited centroid on
it is measured and marked; if it is closer (or as close, with a smaller
number), the walk goes on at the start of that centroid's list.  By the
triangle inequality no centroid strictly farther from the best one than twice
the vector's distance can be as close, so the walk stops at the first of
those.  All vectors of an Arrow batch walk side by side, one list entry a step.

Arithmetic is exact: components are integers, distances are compared squared.
A round is one scan.  A task adds up its vectors by cluster and sends the sums
(clusters x components numbers, in limbs of ``LIMB`` bits); Spark adds those, and the
driver divides them: only centroids pass through it, whose number and length
are parameters.  A vector that a third of all rows share is summed in place like
any other, and nothing is shuffled by vector or by cluster.

Defined results: a vector that is null, of another length, or holds a null or
non-finite component is left out; of vectors with equal hashes (rows that repeat an id)
those with smaller components start first; a null id hashes as the empty
text; with fewer kept vectors than clusters each starts one; repeated rows are all
assigned; an empty table gives an empty result.  A vector with a component
beyond ``small`` is worked on with Python's integers; a distance or inertia beyond a
long is null.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import checkpointed

MAX_LONG = (1 << 63) - 1
LIMB = 32
# Vectors that walk side by side.
SLICE = 8192


def small(size: int) -> int:
    """Components up to this have distances, four times over, and sums of
    2^36 of them within a long."""
    return math.isqrt((1 << 60) // max(size, 1)) // 2


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite doubles as integers: 64-bit ones where every
    component is small, else Python's."""
    if not values.size or np.abs(values).max() * 256 < small(values.shape[-1]):
        return np.floor(values * 256).astype(np.int64)
    exact = [int(x) * 256 if abs(x) >= 1 << 53 else int(np.floor(x * 256)) for x in values.ravel()]
    return np.array(exact, object).reshape(values.shape)


class Orchard:
    """Nearest centroid of whole batches; ``centroids`` is a list of lists of
    integers."""

    def __init__(self, centroids: list[list[int]]):
        exact = np.array(centroids, object)
        most = max(abs(x) for c in centroids for x in c)
        self.centroids = exact.astype(np.int64) if most <= small(len(centroids[0])) else exact
        gaps = ((self.centroids[:, None] - self.centroids[None]) ** 2).sum(axis=2)
        number = np.arange(len(centroids))
        # others first by distance, then by number; the centroid itself leads
        self.order = np.array([sorted(number, key=lambda j: (gaps[i, j], j != i, j)) for i in number])
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        # where to start: nearest on the component on which centroids spread most
        spread = self.centroids.max(axis=0) - self.centroids.min(axis=0)
        self.axis = int(np.argmax(spread))
        self.by_axis = np.argsort(self.centroids[:, self.axis].astype(float), kind="stable")

    def _start(self, vectors: np.ndarray) -> np.ndarray:
        marks = self.centroids[self.by_axis, self.axis].astype(float)
        x = vectors[:, self.axis].astype(float)
        right = np.searchsorted(marks, x).clip(1, max(len(marks) - 1, 1))
        left = right - 1
        right = right.clip(max=len(marks) - 1)
        return self.by_axis[np.where(x - marks[left] <= marks[right] - x, left, right)]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(cluster, squared distance)`` of each row of ``vectors``."""
        if self.centroids.dtype == object:
            vectors = vectors.astype(object)
        k = len(self.centroids)
        best = self._start(vectors)
        far = ((vectors - self.centroids[best]) ** 2).sum(axis=1)
        seen = np.zeros((len(vectors), k), bool)
        seen[np.arange(len(vectors)), best] = True
        place = np.ones(len(vectors), np.int64)
        going = np.arange(len(vectors)) if k > 1 else np.empty(0, np.int64)
        while len(going):
            list_of, at = best[going], place[going]
            within = (self.gaps[list_of, at] <= 4 * far[going]).astype(bool)
            going, other = going[within], self.order[list_of, at][within]
            place[going] += 1
            fresh = ~seen[going, other]
            ask, other = going[fresh], other[fresh]
            seen[ask, other] = True
            found = ((vectors[ask] - self.centroids[other]) ** 2).sum(axis=1)
            closer = ((found < far[ask]) | ((found == far[ask]) & (other < best[ask]))).astype(bool)
            jump = ask[closer]
            best[jump], far[jump], place[jump] = other[closer], found[closer], 1
            going = going[place[going] < k]
        return best, far


def kept_vectors(table: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the vectors that count, as doubles."""
    rows = table.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    unfit = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where((F.size("v") == size) & ~unfit)


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """The kept vectors with the smallest hashes, in that order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = vectors.select("v", F.sha2(text, 256).alias("hash")).orderBy("hash", "v").limit(clusters)
    return [[int(x) for x in scaled(np.array(r.v, float))] for r in first.collect()]


def _slices(batch):
    """``(ids, integer vectors)``: small and large components never in one slice."""
    for i in range(0, batch.num_rows, SLICE):
        part = batch.slice(i, SLICE)
        rows = part.column(1)
        values = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        large = np.abs(values).max(axis=1) * 256 >= small(values.shape[1])
        for some in (~large, large):
            if some.any():
                yield part.column(0).filter(pa.array(some)), scaled(values[some])


def _limbs(number: int) -> list[int]:
    """The number as digits to the base 2^LIMB, all with its sign."""
    sign, rest, out = (-1 if number < 0 else 1), abs(number), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def _sums(orchard: Orchard):
    """One task's sums by cluster: rows (cluster, component, limb, value);
    component -1 counts the vectors."""

    def run(batches):
        k, d = orchard.centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, d), object)
        for batch in batches:
            for _, vectors in _slices(batch):
                cluster, _ = orchard.nearest(vectors)
                count += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    total[c] += vectors[cluster == c].sum(axis=0).astype(object)
        out = [(int(c), -1, 0, int(count[c])) for c in range(k) if count[c]]
        out += [
            (c, j, limb, value)
            for c in range(k) for j in range(d) for limb, value in enumerate(_limbs(int(total[c, j])))
        ]
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["cluster", "component", "limb", "value"],
        )

    return run


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: the floored means of the vectors assigned to each centroid;
    one without vectors stays."""
    parts = vectors.mapInArrow(
        _sums(Orchard(centroids)), "cluster int, component int, limb int, value long"
    )
    # clusters x components x limbs rows
    summed = parts.groupBy("cluster", "component", "limb").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    )
    total: dict = {}
    for r in summed.collect():
        key = (r.cluster, r.component)
        total[key] = total.get(key, 0) + (int(r.value) << (LIMB * r.limb))
    return [
        [total.get((c, j), 0) // total[c, -1] for j in range(len(old))] if (c, -1) in total else old
        for c, old in enumerate(centroids)
    ]


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``(id, cluster, distance)`` of every vector."""
    orchard = Orchard(centroids)

    def run(batches):
        for batch in batches:
            for ids, rows in _slices(batch):
                cluster, far = orchard.nearest(rows)
                far = [int(x) if x <= MAX_LONG else None for x in far]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cluster, pa.int32()), pa.array(far, pa.int64())],
                    names=["id", "cluster", "distance"],
                )

    id_type = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id {id_type}, cluster int, distance long")


def fit(vectors: DataFrame, clusters: int, rounds: int, seed: str) -> list[list[int]]:
    """The centroids after ``rounds`` rounds."""
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(vectors, centroids)
    return centroids


def cluster(
    table: DataFrame,
    clusters: int = 40,
    rounds: int = 5,
    size: int = 64,
    seed: str = "2",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid)`` of every
    kept vector; ``centroid`` lists the final components as text."""
    vectors = kept_vectors(table, size, id_col, vector_col)
    centroids = fit(vectors, clusters, rounds, seed)
    if not centroids:
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid string"
        id_type = vectors.schema["id"].dataType.simpleString()
        return table.sparkSession.createDataFrame([], f"id {id_type}, {empty}")
    found = checkpointed(assigned(vectors, centroids))
    # one row per cluster; a null distance makes the sums that hold it null
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    summed = found.groupBy("cluster").agg(
        F.when(F.count_if(F.col("distance").isNull()) == 0, whole).alias("s")
    )
    sums = {r.cluster: None if r.s is None else int(r.s) for r in summed.collect()}
    total = None if None in sums.values() else sum(sums.values())
    as_long = lambda x: None if x is None or x > MAX_LONG else x
    facts = [
        (c, as_long(s), as_long(total), ",".join(map(str, centroids[c]))) for c, s in sums.items()
    ]
    names = "c int, cluster_inertia long, inertia long, centroid string"
    facts = table.sparkSession.createDataFrame(facts, names)
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("c")).drop("c")
