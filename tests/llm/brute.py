"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def signals(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    twice = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(twice),
    )


def fingerprint(text):
    words = SPACE_WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, distance=2):
    """value -> smallest value of its component."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def repeats(rows, length=50):
    """``rows``: (id or None, text).  (n_bytes, spans, kept sha256) per row."""
    last = 1 << 62
    raws = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raws:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, last), i)
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(text, items, size=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for key, item in items:
        w = WORD.findall(lower(item))
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(key)
    names = sorted(str(k) for k in found if k is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return lower(m[1]), m[2]


def url_rule(host, path, rules):
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def clusters(rows, k, rounds, size, seed):
    """``rows``: (vec_id or None, list or None).  (vec_id, cluster, distance,
    cluster inertia, inertia, centroid) per kept row, by plain search."""
    kept = [
        (i, [math.floor(x * 256) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    means = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        means = [
            [sum(col) // len(groups[c]) for col in zip(*groups[c])] if c in groups else m
            for c, m in enumerate(means)
        ]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found]


def resample(docs, target, percent, longest, buckets, least, seed):
    """(id, n_features, weight, score, rank) per row of ``docs``."""

    def found(text):
        w = WORD.findall(lower(text))
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    held = [(i, *found(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in found(x)[1])
    top, low = sum(t.values()) + buckets, sum(s.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * low / ((s[b] + 1.0) * top)))
    out = []
    for i, n, f in held:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, n, len(f), weight, score))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    rows = [(r[0], *r[2:], k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return rows + [(r[0], *r[2:], None) for r in out if r[1] < least]
