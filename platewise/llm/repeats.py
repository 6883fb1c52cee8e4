"""Removal of byte strings that repeat across documents, by suffix arrays.

Every byte is removed that a string of ``LENGTH`` bytes covers which also
starts in a document with a smaller id.  All start positions of all texts
("windows") are decided, on the input bytes:

1. *Deal out.*  A window's anchor is its smallest ``GRAM``-byte gram by hash,
   the leftmost of equals: equal windows have equal anchors at equal offsets.
   Consecutive windows with one anchor make a segment.  Segments are dealt by
   anchor hash as packed numpy columns (hash, string hash, text, offset,
   length), without their bytes.
2. *Classes.*  The segments of an anchor form a class.  A class seen in one
   document only is done.  If all its segments are the same string, its
   suffix order is that string's, and each window repeats the smallest
   document's.  Otherwise one occurrence of each different string is asked
   for.
3. *Suffix arrays.*  The strings asked for are cut from the texts, whole
   classes are concatenated, and ``suffixes.suffix_array`` orders them;
   neighbours that agree on ``LENGTH`` bytes (compared byte by byte) are one
   window, and the smallest document of each run of neighbours is its first.
   A class of more than ``HOT_CLASS`` strings, such as the end of a line that
   a third of the documents share, is spread window by window and grouped by
   content instead.
4. *Removal.*  Covered spans meet their text by one join, where they are
   merged and cut out.

Sizes: a bucket of segments and a batch of classes are bounded, whatever the
number of documents; a text's own spans are bounded by its length.  A class
key is the hash of the anchor: different anchors that collide only make a
class of different strings, which the suffix array separates.  Equal string
hashes (64 bits) in a class are taken as equal strings.

Defined results: a null or empty text has zero bytes; texts shorter than
``LENGTH`` keep everything; a null id counts as larger than all others; rows
that repeat an id do not count as smaller than each other, so both lose the
same; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import checkpointed, packed
from platewise.llm.suffixes import suffix_array

LENGTH = 50
GRAM = 20
# Bytes of text whose segments a bucket holds on average.
BUCKET_BYTES = 4 << 20
# Different strings of a class that are ordered together.
HOT_CLASS = 10_000
# Bytes of strings per suffix array; a class is never cut.
BATCH_BYTES = 1 << 16
# Bytes of text handled at once in a task.
BLOCK_BYTES = 1 << 18
# Segments that a task gathers before it deals them out.
GATHERED = 1 << 19

NO_ID = (1 << 63) - 1
_PLACE_BITS = np.uint64(23)
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
# A segment in the shuffle: 32 bits of the anchor hash beside the bucket's, 48
# of the string hash, the first window in two halves (the upper ones compress
# to nothing), further windows, the anchor's offset.
SEGMENT = np.dtype(
    [
        ("gram", "<u4"), ("string", "<u4"), ("string2", "<u2"), ("at", "<u2"), ("at2", "<u2"),
        ("more", "u1"), ("anchor", "u1"),
    ]
)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX[6]
    return x ^ (x >> np.uint64(32))


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers, inverse):
    """Segments of the texts ``data[starts:ends]`` of one block: anchor hash,
    string hash, text number, first window, number of further windows and the
    anchor's offset from the first window."""
    n = len(data)
    h = _BYTES[data]
    width, rest, made = 1, 0, {}
    level = 0
    while width * 2 <= GRAM:
        made[width] = h
        h = h[: len(h) - width] * _MIX[level] + h[width:]
        width *= 2
        level += 1
    rest = GRAM - width
    while rest:  # the remaining bytes by the powers of two already hashed
        step = 1 << (rest.bit_length() - 1)
        tail = made[step][width:]
        m = min(len(h), len(tail))
        h = h[:m] * _MIX[5] + tail[:m]
        width += step
        rest -= step
    h = _mixed(h)  # one per gram
    span = LENGTH - GRAM + 1
    place = np.arange(len(h), dtype=np.uint64)
    low = ((h >> _PLACE_BITS) << _PLACE_BITS) | place
    wide = 1
    while wide * 2 <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < span:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    chosen = (low & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)

    inside = np.ones(len(chosen) + 1, bool)  # windows that end in their text
    for end in ends:
        inside[max(0, end - LENGTH + 1) : min(end, len(chosen))] = False
    inside[len(chosen)] = False
    ok = inside[:-1]
    same = chosen[1:] == chosen[:-1]
    first = ok.copy()
    first[1:] &= ~(ok[:-1] & same)
    last = ok.copy()
    last[:-1] &= ~(ok[1:] & same)
    a, b = np.flatnonzero(first), np.flatnonzero(last)

    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers[:n], dtype=np.uint64, out=total[1:])
    string = _mixed((total[b + LENGTH] - total[a]) * inverse[a])
    text = np.searchsorted(starts, a, "right") - 1
    # The smallest of many hashes is small: mixed again, anchors are spread over all buckets.
    return _mixed(h[chosen[a]]), string, text, a - starts[text], b - a, chosen[a] - a


def deal(batches, buckets: int):
    """Packed segments, a row per bucket for every ``GATHERED`` segments."""
    powers = inverse = None
    known = np.uint64(buckets.bit_length() - 1)  # bits that the bucket tells
    gathered, texts, count = [], [], 0  # texts: (id, text hash) of each block row

    def pack(block):
        """Segments of a block of (id, text hash, offset in the text, bytes)."""
        nonlocal powers, inverse, count
        lengths = np.array([len(x[3]) for x in block], np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        if powers is None or len(powers) < n:
            powers = _powers(_BASE, n)
            inverse = _powers(pow(_BASE, -1, 1 << 64), n)
        data = np.frombuffer(b"".join(x[3] for x in block), np.uint8)
        gram, string, text, at, more, anchor = segments(data, ends - lengths, ends, powers, inverse)
        at = at + np.array([x[2] for x in block], np.int64)[text]
        rows = np.empty(len(gram), SEGMENT)
        rows["gram"] = (gram << known) >> np.uint64(32)
        rows["string"], rows["string2"] = string & np.uint64(0xFFFFFFFF), string >> np.uint64(48)
        rows["at"], rows["at2"] = at & 0xFFFF, at >> 16
        rows["more"], rows["anchor"] = more, anchor
        key = gram >> (np.uint64(64) - known) if buckets > 1 else np.zeros(len(gram), np.uint64)
        gathered.append((key.astype(np.int32), rows, (text + len(texts)).astype(np.int32)))
        texts.extend((x[0], x[1]) for x in block)
        count += len(gram)

    def hand_out():
        nonlocal count
        key, rows, text = (np.concatenate(x) for x in zip(*gathered))
        ids, marks = (np.array(x, np.int64) for x in zip(*texts))
        gathered.clear()
        texts.clear()
        count = 0
        order = np.argsort(key, kind="stable")  # texts stay in order in a bucket
        key, rows, text = key[order], rows[order], text[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        for i, j in zip(cuts, [*cuts[1:], len(key)]):
            used, number = np.unique(text[i:j], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(key[i])], pa.int64()),
                    *[
                        pa.array([x], pa.binary())
                        for x in (
                            b"".join(rows[i:j][c].tobytes() for c in SEGMENT.names),
                            ids[used].tobytes(),
                            marks[used].tobytes(),
                            number.astype(np.uint32).tobytes(),
                        )
                    ],
                ],
                names=["bucket", "rows", "ids", "marks", "counts"],
            )

    block, size = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(3)]
        for i in range(batch.num_rows):
            raw = columns[2][i].as_buffer()
            if raw is None or raw.size < LENGTH:
                continue
            raw = memoryview(raw)
            key, mark = columns[0][i].as_py(), columns[1][i].as_py()
            for s in range(0, len(raw) - LENGTH + 1, BLOCK_BYTES):
                # pieces of a long text share LENGTH - 1 bytes
                piece = bytes(raw[s : s + BLOCK_BYTES + LENGTH - 1])
                block.append((key, mark, s, piece))
                size += len(piece)
                if size >= BLOCK_BYTES:
                    pack(block)
                    block, size = [], 0
                    if count >= GATHERED:
                        yield from hand_out()
    if block:
        pack(block)
    if gathered:
        yield from hand_out()


# ``info`` packs first window, further windows, anchor offset, kind and flags.
CLASS_ROWS = "string long, class long, id long, mark long, info long"
MORE, ANCHOR, KIND, HOT, SEVERAL = 32, 40, 48, 50, 51


def _field(shift: int, mask: int):
    return F.shiftright("info", shift).bitwiseAND(F.lit(mask)).cast("int")


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.select(
        "string", "class", "id", "mark",
        F.col("info").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"),
        _field(MORE, 255).alias("more"), _field(ANCHOR, 255).alias("anchor"),
        _field(KIND, 3).alias("kind"), (_field(HOT, 1) == 1).alias("hot"),
        (_field(SEVERAL, 1) == 1).alias("several"),
    )


def classes(batches, hot_class: int = HOT_CLASS):
    """Decide the classes of each bucket (kind 0: a covered run of windows) or
    ask for their strings (kind 1: where a string occurs, kind 2: one
    occurrence of each string).  The rows of a partition come by bucket."""

    def decide(bucket, parts):
        fields = {}
        sizes = [sum(np.frombuffer(p[3], np.uint32)) for p in parts]
        at = [0] * len(parts)
        for name in SEGMENT.names:
            kind = SEGMENT[name]
            pieces = []
            for k, p in enumerate(parts):
                pieces.append(np.frombuffer(p[0], kind, int(sizes[k]), at[k]))
                at[k] += int(sizes[k]) * kind.itemsize
            fields[name] = np.concatenate(pieces)
        ids = np.concatenate(
            [np.repeat(*(np.frombuffer(p[k], t) for k, t in ((1, np.int64), (3, np.uint32)))) for p in parts]
        )
        marks = np.concatenate(
            [np.repeat(*(np.frombuffer(p[k], t) for k, t in ((2, np.int64), (3, np.uint32)))) for p in parts]
        )
        gram = fields["gram"]
        order = np.argsort(gram, kind="stable")
        sorted_gram = gram[order]
        cut = np.flatnonzero(np.r_[True, sorted_gram[1:] != sorted_gram[:-1]])
        who = ids[order]
        least, most = np.minimum.reduceat(who, cut), np.maximum.reduceat(who, cut)
        size = np.diff(np.r_[cut, len(order)])
        keep = np.repeat(least != most, size)
        if not keep.any():
            return
        number = np.repeat(np.arange(len(cut)), size)[keep]
        first = np.repeat(least, size)[keep]
        order = order[keep]
        more, anchor = fields["more"][order].astype(np.int32), fields["anchor"][order]
        # the length belongs to the string
        string = fields["string"][order].astype(np.uint64) | (
            fields["string2"][order].astype(np.uint64) << np.uint64(32)
        )
        string = string | (more.astype(np.uint64) << np.uint64(48))
        who, mark = ids[order], marks[order]
        spot = fields["at"][order].astype(np.int64) | (fields["at2"][order].astype(np.int64) << 16)
        key = gram[order].astype(np.uint64) | np.uint64(bucket << 32)

        cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        size = np.diff(np.r_[cut, len(number)])
        one = np.minimum.reduceat(string, cut) == np.maximum.reduceat(string, cut)
        one = np.repeat(one, size)
        sure = one & (who > first)
        zero = np.zeros(int(sure.sum()), np.int64)
        yield _class_batch(
            0, zero, zero, False, False, who[sure], mark[sure], spot[sure], more[sure], anchor[sure]
        )

        mixed = np.flatnonzero(~one)
        if not len(mixed):
            return
        # strings of a class side by side, the smallest document first
        mixed = mixed[np.lexsort((who[mixed], string[mixed], number[mixed]))]
        number, string, who, first = number[mixed], string[mixed], who[mixed], first[mixed]
        mark, spot, more, key = mark[mixed], spot[mixed], more[mixed], key[mixed]
        anchor = anchor[mixed]
        name = (_mixed(key) * _MIX[7] + string).view(np.int64)
        new = np.r_[True, (number[1:] != number[:-1]) | (string[1:] != string[:-1])]
        heads = np.flatnonzero(new)
        several = np.maximum.reduceat(who, heads) > who[heads]
        _, back, strings = np.unique(number[heads], return_inverse=True, return_counts=True)
        hot = strings[back] > hot_class
        later = who > first  # the smallest document of a class never loses
        zero = np.zeros(int(later.sum()), np.int64)
        yield _class_batch(
            1, name[later], zero, False, False, who[later], mark[later], spot[later], more[later],
            anchor[later],
        )
        yield _class_batch(
            2, name[heads], key[heads].view(np.int64), hot, several,
            who[heads], mark[heads], spot[heads], more[heads], anchor[heads],
        )

    held, bucket = [], None
    for batch in batches:
        number = batch.column(0).to_pylist()
        for i, n in enumerate(number):
            if n != bucket and held:
                yield from decide(bucket, held)
                held = []
            bucket = n
            held.append([batch.column(k)[i].as_buffer() for k in range(1, 5)])
    if held:
        yield from decide(bucket, held)


def _class_batch(kind, string, key, hot, several, ids, marks, at, more, anchor):
    info = at.astype(np.int64) | (more.astype(np.int64) << MORE)
    info |= anchor.astype(np.int64) << ANCHOR
    info |= kind << KIND | np.asarray(hot, np.int64) << HOT | np.asarray(several, np.int64) << SEVERAL
    return pa.RecordBatch.from_arrays(
        [pa.array(string), pa.array(key), pa.array(ids), pa.array(marks), pa.array(info)],
        names=["string", "class", "id", "mark", "info"],
    )


RUNS = "string long, low int, high int, first long"


def order_strings(batches):
    """Suffix arrays over whole classes; rows come by class.  Per string, the
    runs of windows with the smallest document that has them."""

    def decide(rows):
        """``rows``: (string, smallest id, several, text, anchor, class)."""
        names, owners, several, texts, anchors, numbers = zip(*rows)
        # The gram is the same throughout a class and no window starts behind
        # its first byte, so one symbol per class stands for it.
        data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        values = data.astype(np.int64) + 2
        values[begins + lengths] = 1  # below every byte, between strings
        gram = begins + np.array(anchors, np.int64)
        values[gram] = np.array(numbers, np.int64) + 300
        keep = np.ones(len(data), bool)
        keep[(gram[:, None] + np.arange(1, GRAM)).ravel()] = False
        source = np.flatnonzero(keep)
        order = suffix_array([*values[source].tolist(), 0])
        order = source[np.array(order[1:], np.int64)]

        string = np.repeat(np.arange(len(texts)), lengths + 1)
        window = order <= (begins + lengths - LENGTH)[string[order]]
        order = order[window]
        seen = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        differ = np.ones(len(order), bool)
        differ[1:] = (seen[order[1:]] != seen[order[:-1]]).any(axis=1)
        cut = np.flatnonzero(differ)
        ids = np.array(owners, np.int64)[string[order]]
        least = np.repeat(np.minimum.reduceat(ids, cut), np.diff(np.r_[cut, len(order)]))

        back = np.argsort(order)
        place, least = order[back], least[back]  # by text position again
        string = string[place]
        own = np.array(owners, np.int64)[string]
        useful = (least < own) | np.array(several, bool)[string]
        place, least, string = place[useful], least[useful], string[useful]
        if not len(place):
            return
        new = np.r_[
            True,
            (string[1:] != string[:-1]) | (least[1:] != least[:-1]) | (place[1:] != place[:-1] + 1),
        ]
        low = np.flatnonzero(new)
        high = np.r_[low[1:], len(place)] - 1
        base = begins[string[low]]
        yield _runs(
            np.array(names, np.int64)[string[low]], place[low] - base, place[high] - base, least[low]
        )

    batch_rows, alone, size, number = [], [], 0, 0
    members, last = [], None

    def close():
        """Sort out a whole class."""
        nonlocal size, number
        shared = _may_share(members)
        for row, ok in zip(members, shared):
            if ok:
                batch_rows.append((*row, number))
                size += len(row[3]) - GRAM + 2
            elif row[2]:  # its windows repeat only in equal strings
                alone.append((row[0], len(row[3]) - LENGTH, row[1]))
        number += 1

    def flush():
        nonlocal batch_rows, alone, size, number
        if alone:
            names, high, ids = (np.array(x, np.int64) for x in zip(*alone))
            yield _runs(names, np.zeros(len(names)), high, ids)
        if batch_rows:
            yield from decide(batch_rows)
        batch_rows, alone, size, number = [], [], 0, 0

    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last and members:
                close()
                members.clear()
                if size >= BATCH_BYTES or len(alone) >= 50_000:
                    yield from flush()
            last = key
            members.append(tuple(row))
    if members:
        close()
    yield from flush()


def _may_share(members) -> list[bool]:
    """Which strings of a class can have a window in common with another.

    A common window reaches ``LENGTH - GRAM`` bytes beyond the gram in all, so
    half of them on one side at least: a string whose halves on both sides
    are its own shares nothing."""
    half = (LENGTH - GRAM) // 2
    left, right = {}, {}
    sides = []
    for _, _, _, text, anchor in members:
        a = text[anchor - half : anchor] if anchor >= half else None
        b = text[anchor + GRAM : anchor + GRAM + half]
        b = b if len(b) == half else None
        sides.append((a, b))
        left[a] = left.get(a, 0) + 1
        right[b] = right.get(b, 0) + 1
    left[None] = right[None] = 0
    return [left[a] > 1 or right[b] > 1 for a, b in sides]


def _runs(names, low, high, first):
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
            pa.array(first),
        ],
        names=["string", "low", "high", "first"],
    )


def _texts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``(id, mark, raw)``: the mark tells apart the texts of one id."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    return docs.select(key.alias("id"), F.xxhash64(raw).alias("mark"), raw.alias("raw"))


def _buckets(docs: DataFrame, text_col: str) -> int:
    """A power of two that grows with the bytes of the table."""
    size = docs.select(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << (max(least, size // BUCKET_BYTES) - 1).bit_length()


def covered_spans(
    texts: DataFrame, buckets: int, hot_class: int = HOT_CLASS, rows: DataFrame | None = None, text_col: str = ""
) -> DataFrame:
    """``(id, mark, start, end)``: byte spans to remove from the rows of
    ``texts(id, mark, raw)``, not yet merged.  With ``rows(row, id, mark)`` the strings are cut
    from ``text_col`` of ``row``: a later join of the same rows by the same keys shares the exchange."""
    dealt = texts.mapInArrow(
        lambda batches: deal(batches, buckets),
        "bucket long, rows binary, ids binary, marks binary, counts binary",
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from classes(batches, hot_class)

    # as many tasks as the session sets: each takes its buckets one by one, and
    # neither the JVM nor the worker holds more than one as Arrow data
    found = _unpacked(checkpointed(dealt.groupBy("bucket").applyInArrow(decide, CLASS_ROWS)))

    wanted = found.where("kind = 2").groupBy("id", "mark").agg(
        F.collect_list(
            F.struct("string", "class", "hot", "several", "at", "more", "anchor")
        ).alias("asked")
    )

    def cut(raw):
        return F.transform(
            "asked",
            lambda a: F.struct(
                a["string"].alias("string"), a["class"].alias("class"), a["hot"].alias("hot"),
                a["several"].alias("several"), a["anchor"].alias("anchor"),
                F.substring(raw, a["at"] + 1, a["more"] + LENGTH).alias("body"),
            ),
        )

    # rows that repeat a text ask twice: the same strings with the same owner
    if rows is None:
        strings = texts.join(wanted, ["id", "mark"]).select("id", F.inline(cut(F.col("raw"))))
    else:
        # a lambda over the whole row, as a plain field would be cut out before the exchange
        body = F.transform(F.array("row"), lambda r: cut(r[text_col].cast("binary")))[0]
        strings = rows.join(wanted, ["id", "mark"]).select("id", F.inline(body))

    plain = strings.where("NOT hot").select("class", "string", "id", "several", "body", "anchor")
    plain = plain.repartition("class").sortWithinPartitions("class")
    runs = plain.mapInArrow(order_strings, RUNS)
    runs = runs.unionByName(_hot_runs(strings.where("hot")))

    at = found.where("kind = 1").select("string", "id", "mark", "at")
    mixed = at.join(runs, "string").where("id > first").select(
        "id", "mark", (F.col("at") + F.col("low")).alias("start"),
        (F.col("at") + F.col("high") + LENGTH).alias("end"),
    )
    sure = found.where("kind = 0").select(
        "id", "mark", F.col("at").alias("start"), (F.col("at") + F.col("more") + LENGTH).alias("end")
    )
    return sure.unionByName(mixed)


def _hot_runs(strings: DataFrame) -> DataFrame:
    """The same for classes of very many strings: windows grouped by content."""
    windows = strings.select(
        "id", "string", "body",
        F.explode(F.sequence(F.lit(0), F.length("body") - LENGTH)).alias("low"),
    )
    windows = windows.select(
        "id", "string", "low", F.substring(F.col("body"), F.col("low") + 1, F.lit(LENGTH)).alias("window")
    )
    first = windows.groupBy("window").agg(F.min("id").alias("first"))
    return windows.join(first, "window").select(
        "string", "low", F.col("low").alias("high"), "first"
    )


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def _kept(raw: bytes, spans) -> bytes:
    parts, at = [], 0
    for start, end in spans:
        parts.append(raw[at:start])
        at = end
    parts.append(raw[at:])
    return b"".join(parts)


def _spans_by_text(
    texts: DataFrame, buckets: int, hot_class: int = HOT_CLASS, rows: DataFrame | None = None, text_col: str = ""
) -> DataFrame:
    return covered_spans(texts, buckets, hot_class, rows, text_col).groupBy("id", "mark").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )


def removals(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    hot_class: int = HOT_CLASS,
) -> DataFrame:
    """Per row: ``id``, ``n_bytes``, ``spans`` (maximal removed runs, as
    ``[start, end)``) and ``kept_sha256``.  The texts meet the strings asked
    for and the spans by the same keys, so one exchange serves both."""
    texts = _texts(docs, text_col, id_col)
    spans = _spans_by_text(texts, _buckets(docs, text_col), hot_class)
    rows = texts.join(spans, ["id", "mark"], "left")
    own = F.when(F.col("id") != NO_ID, F.col("id"))

    def run(batches):
        for batch in batches:
            found = batch.column(2)
            at = found.offsets.to_pylist()
            low = found.values.field("start").to_numpy()
            high = found.values.field("end").to_numpy()
            flat, ends, hashes, sizes = [], [0], [], []
            for i, raw in enumerate(batch.column(1)):
                raw = raw.as_py()
                part = slice(at[i], at[i + 1])
                cut = _merged(zip(low[part].tolist(), high[part].tolist()))
                flat += cut
                ends.append(len(flat))
                hashes.append(hashlib.sha256(_kept(raw, cut)).hexdigest())
                sizes.append(len(raw))
            pairs = np.array(flat, np.int32).reshape(-1, 2)
            spans = pa.StructArray.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["start", "end"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans),
                    pa.array(hashes, pa.string()),
                ],
                names=["id", "n_bytes", "spans", "kept_sha256"],
            )

    return rows.select(own, "raw", "spans").mapInArrow(
        run, "id long, n_bytes long, spans array<struct<start:int,end:int>>, kept_sha256 string"
    )


def without_repeats(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str = "n_chars"
) -> DataFrame:
    """``docs`` with the covered bytes cut out of the text, all other columns
    as they are but for ``length_col``, if there, which follows the new text.
    A character of which only some bytes remain is dropped."""
    raw = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID))
    rows = packed(docs, key.alias("id"), F.xxhash64(raw).alias("mark"))
    spans = _spans_by_text(
        _texts(docs, text_col, id_col), _buckets(docs, text_col), rows=rows, text_col=text_col
    )
    spans = spans.withColumnRenamed("spans", "repeat_spans")
    fields = docs.schema.fields

    @F.pandas_udf("string")
    def edited(text, found):
        import pandas as pd

        kept = []
        for t, spans in zip(text, found):
            if t is None:  # nothing to cut
                kept.append(None)
                continue
            cut = _merged((s["start"], s["end"]) for s in spans)
            kept.append(_kept(t.encode(), cut).decode("utf-8", "ignore"))
        return pd.Series(kept, dtype=object)

    # one branch for all rows, or their texts would be dealt once more
    hit = F.col("repeat_spans").isNotNull()
    rows = rows.join(spans, ["id", "mark"], "left").select(
        "row", hit.alias("hit"), edited(F.when(hit, F.col(f"row.`{text_col}`")), F.col("repeat_spans")).alias("text")
    )
    columns = [F.col(f"row.`{f.name}`") for f in fields]
    for i, f in enumerate(fields):
        if f.name == text_col:
            columns[i] = F.when(F.col("hit"), F.col("text")).otherwise(columns[i]).alias(f.name)
        elif f.name == length_col:
            length = F.length("text").cast(f.dataType)
            columns[i] = F.when(F.col("hit"), length).otherwise(columns[i]).alias(f.name)
    return rows.select(*columns)
