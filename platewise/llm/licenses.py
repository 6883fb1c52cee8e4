"""License scan by conditional compression.

A passage of text is compressed alone and once with each license template as a
raw zstandard dictionary.  The template that saves the largest share of the
passage ranks first.  In this order the templates are confirmed by their exact
wording: the passage's words are aligned with the template's, and the words
missing from a place and those put between them are reported.  A notice is
confirmed if nothing is missing or added inside it, or so few words that it is
a variant.  Every confirmed place is reported, of overlapping ones that of the
template ranked first; a passage is what overlapping places cover, without
line breaks and comment signs.

Candidate blocks are overlapping groups of consecutive lines, cut by Spark
and filtered for a word of license language before Python sees them; whole
texts are read.  A group has three times as many lines with words as the
longest confirmed notice has words and reports what starts in its middle part,
so a notice is whole in one group, however it is wrapped, and is reported once,
and what is left of one that starts before is not taken for another.
Line breaks and comment signs between words are no words.  Nothing is shuffled.

Defined results: null and empty texts have no blocks and give no rows;
repeated rows and notices are reported each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# License notices, as their licensors word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

# Words of license language, one of which a candidate block holds.
MARKERS = (
    r"(?i)licen[sc]e|copyright|all[\W_]+rights[\W_]+reserved|public[\W_]+domain|redistribut|"
    r"permission[\W_]+(is|to)|\bCC0\b|\bCC[\W_]+BY"
)
# Share of the template's words that may be missing or added in a variant.
VARIANT = 0.1
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
# A line with a word, for Spark.
WORDED = r"[\p{L}\p{N}]"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def wording(block: list[str], template: list[str]) -> tuple[list[str], list[str], int, int]:
    """Template words missing from the block, block words between the matched
    ones, and the matched span of block words, where these are fewest."""
    # least number of wrong words of template[:i] at a place that ends before j
    above = [0] * (len(block) + 1)
    table = [above]
    for i, word in enumerate(template, 1):
        row = [i]
        for j, other in enumerate(block):
            least = min(above[j + 1], row[j]) + 1
            row.append(above[j] if word == other and above[j] < least else least)
        table.append(row)
        above = row
    j = end = min(range(len(above)), key=above.__getitem__)
    i, missing, added = len(template), [], []
    while i:
        if j and template[i - 1] == block[j - 1] and table[i][j] == table[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif j and table[i][j] == table[i][j - 1] + 1:
            j -= 1
            added.append(block[j])
        else:
            i -= 1
            missing.append(template[i])
    return missing[::-1], added[::-1], j, end


def places(block: list[str], spots: dict[str, list[int]], template: list[str]):
    """``(missing, added, start, end)`` of the template's places in the block
    that do not overlap, the best first; ``spots`` has where each word is."""
    wrong = int(VARIANT * len(template))
    # of one piece more than wrong words one is whole, and tells the place
    cuts = [len(template) * k // (wrong + 1) for k in range(wrong + 2)]
    around = set()
    for a, b in zip(cuts, cuts[1:]):
        piece = template[a:b]
        for spot in spots.get(piece[0], ()):
            if block[spot : spot + b - a] == piece:
                around.add(spot - a)
    found = {}
    for spot in around:
        low = max(0, spot - wrong)
        missing, added, start, end = wording(block[low : spot + len(template) + wrong], template)
        if len(missing) + len(added) <= wrong:
            found[low + start, low + end] = missing, added
    out = []
    for (start, end), (missing, added) in sorted(
        found.items(), key=lambda x: (sum(map(len, x[1])), x[0])
    ):
        if all(end <= o[2] or start >= o[3] for o in out):
            out.append((missing, added, start, end))
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES, level: int = 3):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=level)
        self.templates = [(name, text, words(text)) for name, text in templates]
        self.primed = [
            zstandard.ZstdCompressor(
                level=level,
                dict_data=zstandard.ZstdCompressionDict(
                    text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
            )
            for _, text, _ in self.templates
        ]

    def saved(self, block: str, which=None) -> list[float]:
        """Share of the compressed block that each template saves."""
        raw = block.lower().encode()
        alone = len(self.plain.compress(raw))
        primed = self.primed if which is None else [self.primed[which]]
        return [(alone - len(c.compress(raw))) / alone for c in primed]

    def notices(self, lines: list[str], low: int = 0, high: int | None = None):
        """``(first line, last line, license, template, saving, missing, added,
        exact)`` of every confirmed notice that starts in ``lines[low:high]``,
        by place; the saving is that of the notice's own lines."""
        found, at = [], []
        for k, line in enumerate(lines):
            here = words(line)
            found += here
            at += [k] * len(here)
        spots = defaultdict(list)
        for k, word in enumerate(found):
            spots[word].append(k)
        options = [
            (start, end, i, missing, added)
            for i, (_, _, template) in enumerate(self.templates)
            for missing, added, start, end in places(found, spots, template)
        ]
        passages, behind = [], 0
        for option in sorted(options):
            if option[0] >= behind:
                passages.append([])
            passages[-1].append(option)
            behind = max(behind, option[1])
        taken = []
        for passage in passages:
            if len(passage) > 1:
                last = max(o[1] for o in passage) - 1
                text = "\n".join(lines[at[passage[0][0]] : at[last] + 1])
                share = self.saved(re.sub(r"[\s_]*\n[\W_]*", " ", text))
                passage.sort(key=lambda o: (-share[o[2]], len(o[3]) + len(o[4]), o[:3]))
            for option in passage:
                if all(option[1] <= o[0] or option[0] >= o[1] for o in taken[-len(passage):]):
                    taken.append(option)
        out = []
        for start, end, i, missing, added in sorted(taken):
            first, last = at[start], at[end - 1]
            if low <= first and (high is None or first < high):
                (saving,) = self.saved("\n".join(lines[first : last + 1]), i)
                exact = not missing and not added
                out.append((first, last, self.templates[i][0], i, saving, missing, added, exact))
        return out

    def judge(self, block: str):
        """``(license, template, saving, missing, added, exact)`` of the first
        notice in the block, or None."""
        return next((n[2:] for n in self.notices(block.split("\n"))), None)


# No confirmed notice has more words, hence none is on more lines with words.
LONGEST = max(len(t) + int(VARIANT * len(t)) for t in (words(text) for _, text in TEMPLATES))


@functools.lru_cache(maxsize=1)
def scanner():
    return Scanner()


SCHEMA = (
    "line bigint, license string, template int, saving double, "
    "missing array<string>, added array<string>, exact boolean, block string"
)


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per confirmed notice: ``id``, ``line`` (0-based, where it
    starts), ``license``, ``template`` (its index), ``saving`` (share of the
    compressed block saved), the exact wording differences and the block, which
    is the lines with words that the notice is on."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        notices = scanner().notices
        for batch in batches:
            ids, out = [], []
            for key, low, numbers, lines in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for first, last, *verdict in notices(lines, low, low + LONGEST):
                    ids.append(key)
                    out.append((numbers[first], *verdict, "\n".join(lines[first : last + 1])))
            columns = list(zip(*out)) or [()] * 8
            kinds = [
                pa.int64(), pa.string(), pa.int32(), pa.float64(),
                pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.string(),
            ]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), *arrays], names=["id", *names]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numbered = F.transform(
        F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("line"), line.alias("block"))
    )
    lines = rows.where(F.col("text").rlike(MARKERS)).select(
        "id", F.filter(numbered, lambda x: x["block"].rlike(WORDED)).alias("lines")
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0)), F.lit(LONGEST))
    groups = lines.select("id", "lines", F.explode(starts).alias("start"))
    low = F.least("start", F.lit(LONGEST))  # lines before the middle part
    group = F.slice("lines", F.col("start") - low + 1, low + 2 * LONGEST)
    groups = groups.select("id", low.alias("low"), group.alias("lines"))
    groups = groups.select("id", "low", F.col("lines.line").alias("line"), F.col("lines.block").alias("block"))
    groups = groups.where(F.array_join("block", "\n").rlike(MARKERS))
    return groups.mapInArrow(run, f"id {id_type}, {SCHEMA}")
