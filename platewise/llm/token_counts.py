"""Token counts by a compiled deterministic transducer.

The byte-pair tokenizer is compiled, state by state as texts need it, into a
transducer over word characters whose transitions carry the number of tokens
that they add (it may be negative: a longer token can replace several).  A
state holds what the future can still see of a word: for every suffix that
begins some vocabulary token, the last token and the count of the prefix
before it (see ``bpe``), counts relative to the whole.  Words with equal
states share all that follows, so there are finitely many states.  Each state
also has the tokens added if the word ends there.

A long text is cut at fixed offsets into chunks, which are composed by text at
white space, not by states: a chunk gives the text up to its first white space,
the tokens between, and the text behind its last white space (or itself, if it
has none).  Neighbours join tail and head, whose words are counted then.  This
composition is associative, and a balanced scan over the chunks of a text,
inside its row, gives the text's count.

Normalisation, splitting and special strings follow the tokenizer file: NFC,
white space to spaces, lower case, then the split pattern; special strings in
the raw text count as one token each.

Work runs in Arrow batches without a shuffle; the compiled tables of a worker
are bounded and are rebuilt on demand.  Defined results: a null or empty text
has zero bytes and tokens; repeated rows are counted one by one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.bpe import MergeTable

CHUNK_CHARS = 1 << 16
MAX_STATES = 300_000
CACHED_WORDS = 600_000


def byte_characters() -> list[str]:
    """The printable character of each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Suffixed(MergeTable):
    """Merges of a vocabulary whose word-final symbols carry a suffix."""

    def __init__(self, merges: dict[tuple[str, str], int], suffix: str):
        super().__init__(lambda left, right: merges.get((left, right)))
        self.suffix = suffix

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1:] + self.suffix]
        return list(token)


class Transducer:
    """States are numbers; 0 is the start of a word."""

    def __init__(self, vocab, merges: dict[tuple[str, str], int], suffix: str):
        self.table = Suffixed(merges, suffix)
        self.suffix = suffix
        self.tokens = {t for t in vocab if self.table.solid(t)}
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self.reset()

    def reset(self) -> None:
        # a state: (characters still visible, ((length, last token, count), ...))
        start = ("", ((0, None, 0),))
        self.states = [start]
        self.numbers = {start: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.final: list[int | None] = [None]

    def _last(self, entries, text: str, suffix: str):
        """The last token of ``text`` and the count before it."""
        for length, last, count in entries:
            token = text[len(text) - length :] + suffix if length else suffix
            if token in self.tokens and (last is None or self.table.fits(last, token)):
                return token, count
        raise ValueError(f"the vocabulary does not cover {text!r}")

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        tail, entries = self.states[state]
        text = tail + char
        ahead = [(k + 1, last, count) for k, last, count in entries]
        last, before = self._last(ahead, text, "")
        added = before + 1
        seen = [(0, last, 0)]
        seen += [(k, t, c - added) for k, t, c in ahead if text[len(text) - k :] in self.prefixes]
        keep = max([k for k, _, _ in seen])
        new = (text[len(text) - keep :] if keep else "", tuple(seen))
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
            self.next.append({})
            self.final.append(None)
        self.next[state][char] = (number, added)
        return number, added

    def _end(self, state: int) -> int:
        """Tokens added if the word ends in ``state``: its last character was
        read as an inner one, the final one takes the suffix instead."""
        tail, entries = self.states[state]
        inner = [e for e in entries if e[0]]
        self.final[state] = self._last(inner, tail, self.suffix)[1] + 1
        return self.final[state]

    def walk(self, state: int, chars: str) -> tuple[int, int]:
        """State and tokens after ``chars``."""
        total, steps = 0, self.next
        for char in chars:
            step = steps[state].get(char)
            if step is None:
                step = self._compile(state, char)
            state = step[0]
            total += step[1]
        return state, total

    def count(self, chars: str) -> int:
        """Tokens of one whole word."""
        if not chars:
            return 0
        if len(self.states) > MAX_STATES:
            self.reset()
        state, total = self.walk(0, chars)
        end = self.final[state]
        return total + (self._end(state) if end is None else end)


class Counter:
    """Counts of a tokenizer file of the ``tokenizers`` library (BPE)."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(
            model["vocab"], {m: i for i, m in enumerate(merges)}, model["end_of_word_suffix"] or ""
        )
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.characters = byte_characters()
        self.words: dict[str, int] = {}

    def _learn(self, words) -> None:
        to = self.characters
        for word in sorted(words):
            chars = "".join([to[b] for b in word.encode()])
            self.words[word] = self.transducer.count(chars)

    def _tally(self, text: str) -> int:
        words = self.split(normalised(text))
        try:
            return sum(map(self.words.__getitem__, words))
        except KeyError:
            new = set(words)
            if len(self.words) + len(new) > CACHED_WORDS:
                self.words.clear()
            self._learn([w for w in new if w not in self.words])
            return sum(map(self.words.__getitem__, words))

    # ---- chunk maps ------------------------------------------------------

    def chunk_map(self, chunk: str) -> tuple[str, int, str] | str:
        """``(head, count, tail)``, or the chunk itself if it has no white
        space and only moves the entry state on.  Head, middle and tail
        meet at white space, where every state is the start of a word."""
        first = BLANK.search(chunk)
        if first is None:
            return chunk
        end = first.end()
        last = max(LAST_BLANK.search(chunk).start(), end)
        return chunk[:end], self._tally(chunk[end:last]) if end < last else 0, chunk[last:]

    def compose(self, a, b):
        """The map of a chunk followed by another."""
        if isinstance(a, str):
            return a + b if isinstance(b, str) else (a + b[0], b[1], b[2])
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + self._tally(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list):
        """Balanced composition of the chunk maps, left to right."""
        while len(maps) > 1:
            paired = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = paired + maps[len(paired) * 2 :]
        return maps[0]

    def _plain(self, text: str) -> int:
        if len(text) <= CHUNK_CHARS:
            return self._tally(text)
        cuts = range(0, len(text), CHUNK_CHARS)
        whole = self.scan([self.chunk_map(text[i : i + CHUNK_CHARS]) for i in cuts])
        if isinstance(whole, str):
            return self._tally(whole)
        return self._tally(whole[0]) + whole[1] + self._tally(whole[2])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


# Only plain spaces, tabs and line breaks: no character composes across them.
BLANK = regex.compile(r"[ \n\t]")
LAST_BLANK = regex.compile(r"(?r)[ \n\t]")


# Capitals whose small letter Python takes otherwise (the final
# sigma) or does not know yet.
LOWER = {0x03A3: 0x03C3, 0xA7CB: 0x0264, 0xA7DC: 0x019B}


def normalised(text: str) -> str:
    """NFC and lower case character by character (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).translate(LOWER)
    return text.lower()


@functools.lru_cache(maxsize=2)
def counter(file: str) -> Counter:
    return Counter(file)


def count_tokens(
    docs: DataFrame, tokenizer_file: str, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        count = counter(tokenizer_file).count
        for batch in batches:
            n = np.array([count(t.as_py()) for t in batch.column(2)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n)], names=["id", "n_bytes", "n_tokens"]
            )

    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint")
    rows = docs.select(
        F.col(id_col).alias("id"), size.alias("n_bytes"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
