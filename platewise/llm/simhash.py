"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments.
Flipping a bit moves one coordinate by one, so the Manhattan distance of two
embeddings never exceeds the Hamming distance.  The counts (0, 1, 2) are kept
in unary, which makes the whole embedding one long and its Manhattan distance
the popcount of an XOR.

Grid range join: the 32 coordinates are cut into ``d + 3`` blocks.  Points
within Manhattan distance ``d`` differ in at most ``d`` blocks, so they agree
on three whole blocks: those blocks' coordinates are the grid cell, in one
grid for each choice of three.  In a cell, pairs within the Manhattan bound
are verified by exact bit distance.

Distinct fingerprints are joined, never documents, so a group of exact copies
is one row.  A cell of more than ``CELL`` distinct fingerprints is not joined
with itself: its members meet at common neighbours instead (two values are
within ``2 f`` bits exactly if some value is within ``f`` bits of both), which
yields a star per neighbour and is linear in the members, with the same
components.

Fingerprints are computed in Arrow batches with numpy; everything else is
DataFrame code.  Defined results: null and empty texts have fingerprint zero
and are linked like others; rows with a null id get the component of their
fingerprint and never name one; repeated rows are kept; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import checkpointed, without
from platewise.llm.components import connected_components

# Distinct fingerprints of a cell up to which pairs are looked at.
CELL = 64
SEGMENTS = 32
LOW_BITS = 0x5555555555555555


def _hashes(raw: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``width``-word shingle, repeats included."""
    words = raw.lower().split() if raw else []  # both ASCII only on bytes
    n = len(words) - width + 1
    if n < 1:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64)


def fingerprint(raw: bytes | None, width: int = 3) -> int:
    """SimHash as an unsigned integer; a bit is 1 if set in over half of the
    shingle hashes.  Works through long texts in slices."""
    h = _hashes(raw, width)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, width: int = 3, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` is the signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            values = [fingerprint(raw.as_py(), width) for raw in batch.column(1)]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"id {id_type}, fp long")


def embedding(fp: Column) -> Column:
    """Unary bit counts of the two-bit segments, packed in one long."""
    low = F.lit(LOW_BITS)
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    some = fp.bitwiseAND(low).bitwiseOR(high)
    both = fp.bitwiseAND(low).bitwiseAND(high)
    return some.bitwiseOR(F.shiftleft(both, 1))


def grid_masks(distance: int) -> list[int]:
    """One mask over the embedding per choice of three of ``distance + 3``
    blocks of segments, as signed longs."""
    blocks = [0] * (distance + 3)
    for s in range(SEGMENTS):
        blocks[s * len(blocks) // SEGMENTS] |= 3 << (2 * s)
    masks = [a | b | c for a, b, c in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Verified links ``(a, b)`` between the distinct values of ``fps(fp)``:
    every pair within ``distance`` bits is connected by them."""
    masks = F.array(*[F.lit(m) for m in grid_masks(distance)])
    keyed = fps.select("fp", embedding(F.col("fp")).alias("e")).select(
        "fp", "e", F.posexplode(masks).alias("grid", "mask")
    )
    keyed = keyed.select("fp", "e", "grid", F.col("e").bitwiseAND(F.col("mask")).alias("cell"))
    shared = keyed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpointed(keyed.join(shared, ["grid", "cell"]))

    small = members.where(F.col("n") <= CELL).select("grid", "cell", "fp", "e")
    other = small.select("grid", "cell", F.col("fp").alias("fp2"), F.col("e").alias("e2"))
    manhattan = F.bit_count(F.col("e").bitwiseXOR(F.col("e2")))
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    near = (F.col("fp") < F.col("fp2")) & (manhattan <= distance) & (hamming <= distance)
    joined = small.join(other, ["grid", "cell"]).where(near)
    pairs = joined.select(F.col("fp").alias("a"), F.col("fp2").alias("b"))

    hot = members.where(F.col("n") > CELL).select("fp").distinct()
    return pairs.unionByName(_by_neighbours(hot, distance)).distinct()


def _by_neighbours(fps: DataFrame, distance: int) -> DataFrame:
    """Links between values that have a common value within ``distance / 2``
    bits."""
    around = [
        sum(1 << b for b in bits)
        for r in range(distance // 2 + 1)
        for bits in combinations(range(64), r)
    ]
    signed = [m - (1 << 64) if m >> 63 else m for m in around]
    flips = F.explode(F.array(*[F.lit(m) for m in signed])).alias("flip")
    spread = fps.select("fp", flips).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("c")
    )
    # at most one value per flip can meet at c
    meet = spread.groupBy("c").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    stars = meet.where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    return stars.where("a <> b")


def near_duplicates(
    docs: DataFrame,
    width: int = 3,
    distance: int = 2,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """``(id, fp, component_id)`` of every row; the component is the smallest
    id that can be reached over links of at most ``distance`` bits."""
    if distance % 2:
        raise ValueError("an even bit distance is needed")
    rows = checkpointed(fingerprints(docs, width, text_col, id_col))
    values = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(links(values.select("fp"), distance))
    roots = roots.select(F.col("node").alias("fp"), "root")
    linked = roots.join(values, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    component = roots.join(smallest, "root").select("fp", "component_id")
    # every value has its component: its own first id if nothing is linked
    known = values.join(component, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")
    )
    # both sides are then plain exchanges, of which Spark can split a hot one
    return rows.join(checkpointed(known), "fp").select("id", "fp", "component_id")


def keep_one(
    docs: DataFrame,
    width: int = 3,
    distance: int = 2,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` whose id names its component (rows with a null id
    stay), all columns as they are."""
    found = near_duplicates(docs, width, distance, text_col, id_col)
    gone = found.where("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return without(docs, gone, id_col)
