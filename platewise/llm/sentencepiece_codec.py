"""SentencePiece encoding and decoding over a shared-prefix word trie.

Texts are cut into marked words (a space is the mark U+2581, one is put before
every text).  The distinct words of a block are sorted, which lays them out as
a depth-first walk of their trie: neighbours share a prefix, and the forward
scores of that prefix are kept on a stack, so every trie node is scored once.
The pieces that end at a node come from an automaton over the suffixes that begin
a piece, whose states and compatible pairs are worked out when first met.

The forward score of a prefix is its best segmentation, held as its last
piece.  The public models here are BPE models, whose segmentation is not the
one of the largest score sum; the score compared at a node is therefore the
merge order itself (see ``bpe``), which gives the pieces of the library
exactly.  Words that begin with a run of marks are merged directly, since the
run pieces share one score.

Characters outside the vocabulary become their UTF-8 bytes.  Work runs in
Arrow batches, block by block of whole texts; nothing is shuffled, and the
word cache of a worker is bounded.

Defined results: a null or empty text has no pieces and decodes to the empty
text; U+2581 in a text decodes to a space, as in the library; repeated rows
are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.bpe import MergeTable

MARK = "▁"
# Marked words: marks with what follows them, up to the next mark or line
# break.  No piece has a mark behind another character or holds a line break.
WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

BLOCK_CHARS = 2_000_000
CACHED_WORDS = 500_000
CACHED_PAIRS = 400_000


class _Follows(dict):
    """Whether a piece may stand behind another one; filled as asked."""

    def __init__(self, coder: "Codec", piece: str):
        self.coder, self.piece = coder, piece

    def __missing__(self, left: str) -> bool:
        self.coder.known_pairs += 1
        known = self[left] = self.coder.merges.border_stays(left, self.piece)
        return known


class _Suffix(dict):
    """What a piece can end with: the longest suffix of the characters read that
    begins a piece, with the solid pieces that end there (the longest first)
    and the states behind the next character, filled as asked."""

    def __init__(self, coder: "Codec", text: str):
        self.coder, self.text = coder, text
        ends = (text[start:] for start in range(len(text)))
        self.pieces = [
            (p, len(p), coder._pack([p]), coder.follows(p))
            for p in ends
            if p in coder.ids and coder.merges.solid(p)
        ]

    def __missing__(self, character: str) -> "_Suffix":
        text = self.text + character
        while not self.coder.begins_piece(text):
            text = text[1:]
        state = self[character] = self.coder.state(text)
        return state


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.unk = model.unk_id()
        self.byte = {}
        self.ids = {}
        self.texts = [b""] * size
        scores = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                self.texts[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[name] = i
                scores[name] = -model.get_score(i)
                self.texts[i] = name.replace(MARK, " ").encode()
        self.sorted_pieces = sorted(self.ids)
        self.merges = MergeTable(lambda left, right: scores.get(left + right))
        self.words: dict[str, bytes] = {}
        self.forget_pairs()

    def _pack(self, pieces) -> bytes:
        """Ids of the pieces as packed int32; unknown ones by their bytes."""
        out = []
        for piece in pieces:
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[b] for b in piece.encode())
            else:
                out.append(self.unk)
        return np.array(out, np.int32).tobytes()

    def learn(self, words) -> None:
        """Encode new words: a depth-first walk over their sorted trie."""
        pack = self._pack
        # of each prefix on the path: its state, last piece (None: nothing, or a
        # character outside the vocabulary) and packed ids
        states, last, packed = [self.root], [None], [b""]
        before = ""
        for word in sorted(words):
            if word[:2] == MARK * 2:
                self.words[word] = pack(self.merges.merge_long(word))
                continue
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :], last[shared + 1 :], packed[shared + 1 :]
            state = states[shared]
            for end in range(shared + 1, len(word) + 1):
                state = state[word[end - 1]]
                for piece, size, ids, follows in state.pieces:
                    left = last[end - size]
                    if left is None or follows[left]:
                        last.append(piece)
                        packed.append(packed[end - size] + ids)
                        break
                else:
                    piece = word[end - 1]
                    last.append(piece if piece in self.ids else None)
                    packed.append(packed[end - 1] + pack([piece]))
                states.append(state)
            before = word
            self.words[word] = packed[-1]
        if self.known_pairs > CACHED_PAIRS:
            self.forget_pairs()

    def forget_pairs(self) -> None:
        self.known_pairs = 0
        self._states: dict[str, _Suffix] = {}
        self._follows: dict[str, _Follows] = {}
        self.root = self.state("")

    def begins_piece(self, text: str) -> bool:
        at = bisect.bisect_left(self.sorted_pieces, text)
        return at < len(self.sorted_pieces) and self.sorted_pieces[at].startswith(text)

    def state(self, text: str) -> _Suffix:
        if text not in self._states:
            self._states[text] = _Suffix(self, text)
        return self._states[text]

    def follows(self, piece: str) -> _Follows:
        if piece not in self._follows:
            self._follows[piece] = _Follows(self, piece)
        return self._follows[piece]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text."""
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set()
        for words in split:
            new.update(words)
        missing = {w for w in new if w not in self.words}
        if len(self.words) + len(missing) > CACHED_WORDS:
            self.words.clear()
            missing = new
        self.learn(missing)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, packed: bytes) -> str:
        raw = b"".join(map(self.texts.__getitem__, np.frombuffer(packed, np.int32).tolist()))
        return raw.decode("utf-8", "replace")[1:]  # without the first mark


@functools.lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode(
    docs: DataFrame, model_file: str, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``(id, n_pieces, piece_ids, restored)`` of every row; ``restored`` tells
    whether decoding the ids gives the text back (marks in it as spaces)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def blocks(texts):
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
        if block:
            yield block

    def run(batches):
        coder = codec(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            packed, same = [], []
            for block in blocks(texts):
                ids = coder.encode_all(block)
                same += [coder.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, block)]
                packed += ids
            ends = np.cumsum([0] + [len(i) // 4 for i in packed]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), values),
                    pa.array(same, pa.bool_()),
                ],
                names=["id", "n_pieces", "piece_ids", "restored"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run, f"id {id_type}, n_pieces long, piece_ids array<int>, restored boolean"
    )


def decode(
    encoded: DataFrame, model_file: str, ids_col: str = "piece_ids", id_col: str = "id"
) -> DataFrame:
    """``(id, text)``: the texts of piece id arrays."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = codec(model_file)
        for batch in batches:
            texts = [
                coder.decode(np.array(i or [], np.int32).tobytes())
                for i in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["id", "text"]
            )

    rows = encoded.select(
        F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("piece_ids")
    )
    return rows.mapInArrow(run, f"id {id_type}, text string")
