"""Importance resampling towards a target: hashed n-gram features, log ratios
of their bucket counts and a Gumbel top-k draw.

The bucket of a feature is the CRC-32 of its UTF-8 bytes modulo ``buckets``.  The
distinct features of a slice of texts are grouped by length; the bytes of a group
are one two-dimensional ``uint8`` array, whose CRCs are updated together, column by
column, and the buckets are scattered back to all places of the features.  Features
longer than ``PIECE`` are cut into pieces of that length, which are one group; a
CRC being linear, the pieces' registers are moved over the bytes behind them and
added.

Two scans of the corpus: bucket counts (a task adds its slices up and sends at
most ``buckets`` rows, Spark adds those), then the documents' weights.  Only the
table of gains, one number per bucket, passes through the driver.  The draw sorts
(score, id) by range and numbers the rows from the sizes of the sorted
partitions; no task sees more than its range, and equal rows are spread by a
row number.

Defined results: a null text has no features and weight 0; a null id hashes as the
empty text and comes after other ids on ties; rows that repeat an id are drawn one
by one; a corpus or target without features has gains by the smoothed counts; an
empty corpus gives an empty result; a feature of any length is hashed whole, a text of
any length is one slice of its own; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import checkpointed

# What stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes of text that are worked on at once; a longer text is alone.
SLICE_BYTES = 1 << 19
# Longer features are hashed in pieces of this many bytes.
PIECE = 64


def _crc_table() -> np.ndarray:
    """What each byte adds to a reflected CRC-32 (polynomial 0xEDB88320)."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


CRC_TABLE = _crc_table()


def crc32_columns(matrix: np.ndarray, start: int = 0xFFFFFFFF) -> np.ndarray:
    """CRC registers after every row of a ``uint8`` matrix, column by column."""
    crc = np.full(len(matrix), start, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = CRC_TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc


class _Zeros:
    """What PIECE x 2^j zero bytes make of a CRC register: a linear map, kept
    as one table per byte of the register."""

    def __init__(self):
        images = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(PIECE):
            images = CRC_TABLE[images & 0xFF] ^ (images >> np.uint32(8))
        self.images, self.tables = images, []

    def _table(self, j: int) -> np.ndarray:
        while len(self.tables) <= j:
            value, table = np.arange(256), np.zeros((4, 256), np.uint32)
            for bit in range(32):
                table[bit // 8] ^= np.where(value >> bit % 8 & 1, self.images[bit], 0).astype(np.uint32)
            self.tables.append(table)
            self.images = self._mapped(table, self.images)  # twice the bytes
        return self.tables[j]

    @staticmethod
    def _mapped(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        out = table[0][crc & 0xFF]
        for byte in (1, 2, 3):
            out = out ^ table[byte][crc >> np.uint32(8 * byte) & 0xFF]
        return out

    def after(self, crc: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """The registers ``crc`` after PIECE x ``pieces`` zero bytes each."""
        for j in range(int(pieces.max(initial=0)).bit_length()):
            some = pieces >> j & 1 == 1
            crc[some] = self._mapped(self._table(j), crc[some])
        return crc


ZEROS = _Zeros()


def _crc32_long(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of texts longer than PIECE: a matrix of pieces of equal length,
    whose registers are moved to the end of their text and added up.

    Zero bytes in front leave a zero register as it is, and a register that starts with
    all bits set is one that starts with zero on a text whose first four bytes are inverted."""
    count = -(-lengths // PIECE)
    first = np.cumsum(count) - count
    padded = np.zeros(int(count.sum()) * PIECE, np.uint8)
    for start, size, end in zip(starts, lengths, (first + count) * PIECE):
        padded[end - size : end] = data[start : start + size]
        padded[end - size : end - size + 4] ^= 0xFF
    crc = crc32_columns(padded.reshape(-1, PIECE), 0)
    behind = np.repeat(first + count, count) - np.arange(len(crc)) - 1
    return np.bitwise_xor.reduceat(ZEROS.after(crc, behind), first)


def crc32_all(texts: pa.Array) -> np.ndarray:
    """CRC-32 of the UTF-8 bytes of every text (none null), by length; texts
    longer than PIECE bytes are cut into pieces of that length."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    out = np.full(len(texts), 0xFFFFFFFF, np.uint32)
    if data is None:  # nothing but empty texts
        return ~out
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)
    lengths = np.diff(starts)
    by_length = np.argsort(lengths, kind="stable")
    by_length, long = np.split(by_length, [np.searchsorted(lengths[by_length], PIECE, "right")])
    for group in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1):
        if len(group) and lengths[group[0]]:
            out[group] = crc32_columns(data[starts[group][:, None] + np.arange(lengths[group[0]])])
    if len(long):
        out[long] = _crc32_long(data, starts[long], lengths[long])
    return ~out


def _slices(batch):
    """Parts of a batch of at most ``SLICE_BYTES`` of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if len(sizes):
        yield batch.slice(start)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts and the number of the text that each is in."""
    # a copy of its own: ``ascii_lower`` shifts a slice that was cast
    whole = pc.take(pc.fill_null(texts, ""), pa.array(np.arange(len(texts))))
    lowered = pc.ascii_lower(whole.cast(pa.large_string()))
    parts = pc.split_pattern_regex(lowered, BETWEEN)
    found, owner = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    real = pc.not_equal(found, "")
    return found.filter(real), owner[real.to_numpy(zero_copy_only=False)]


def features(texts: pa.Array, longest: int) -> tuple[pa.Array, np.ndarray]:
    """All runs of 1 to ``longest`` consecutive words, joined by a space, and
    their texts' numbers."""
    single, owner = words(texts)
    found, owners = [single], [owner]
    for n in range(2, longest + 1):
        m = max(len(single) - n + 1, 0)
        whole = owner[:m] == owner[n - 1 : n - 1 + m]
        runs = [single.slice(k, m).filter(pa.array(whole)) for k in range(n)]
        space = pa.scalar(" ", pa.large_string())
        found.append(pc.binary_join_element_wise(*runs, space))
        owners.append(owner[:m][whole])
    return pa.concat_arrays(found), np.concatenate(owners)


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, text number)`` of every feature, repeats included."""
    found, owner = features(texts, longest)
    coded = found.dictionary_encode()
    distinct = (crc32_all(coded.dictionary) % np.uint32(buckets)).astype(np.int64)
    return distinct[coded.indices.to_numpy()], owner


def _texts(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def bucket_counts(docs: DataFrame, longest: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _slices(batch):
                bucket, _ = feature_buckets(part.column("text"), longest, buckets)
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"]
        )

    counted = _texts(docs, text_col).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) per bucket, one added to
    every count."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        np.int64,
    )


def weights(
    docs: DataFrame, gain: np.ndarray, longest: int, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``(id, n_words, n_features, weight)`` of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                rows = part.num_rows
                bucket, owner = feature_buckets(part.column("text"), longest, len(gain))
                total = np.zeros(rows, np.int64)
                np.add.at(total, owner, gain[bucket])
                n_features = np.bincount(owner, minlength=rows)
                # runs of n words: as many as words, less n - 1, in each text
                n_words = n_features if longest == 1 else _word_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, total))],
                    names=["id", "n_words", "n_features", "weight"],
                )

    rows = _texts(docs, text_col, F.col(f"`{id_col}`").alias("id"))
    return rows.mapInArrow(run, f"id {id_type}, n_words long, n_features long, weight long")


def _word_counts(texts: pa.Array) -> np.ndarray:
    _, owner = words(texts)
    return np.bincount(owner, minlength=len(texts))


def gumbel(id_col: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of the id's SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds ``rank``, 1 and up by score (ties: smaller id) for the best
    ``percent`` of the rows with at least ``least_words`` words, else null."""
    kept = scored.withColumn("able", F.col("n_words") >= least_words)
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)  # narrow; lost blocks are computed again
    wanted = percent * kept.where("able").count() // 100
    ordered = kept.withColumn("row", F.monotonically_increasing_id()).orderBy(
        F.desc("able"), F.desc("score"), F.asc_nulls_last("id"), "row"
    )
    # sorted once: numbers and sizes come from the same written partitions
    placed = checkpointed(
        ordered.drop("row").withColumns(
            {"part": F.spark_partition_id(), "mark": F.monotonically_increasing_id()}
        )
    )
    kept.unpersist()
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.col("mark") - F.shiftleft(F.col("part").cast("bigint"), 33) + F.col("offset") + 1
    drawn = F.col("able") & (place <= wanted)
    return placed.join(F.broadcast(offsets), "part").select(
        *scored.columns, F.when(drawn, place).alias("rank")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    longest: int = 1,
    buckets: int = 10000,
    least_words: int = 20,
    seed: str = "2024",
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)`` of every document."""
    gain = gains(
        bucket_counts(docs, longest, buckets, text_col),
        bucket_counts(target, longest, buckets, text_col),
    )
    weighted = weights(docs, gain, longest, text_col, id_col)
    return draw(
        weighted.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), percent, least_words
    )
