"""Findings of the third round's report on training-data operators."""

from __future__ import annotations

import random

import sentencepiece

from platewise.llm.registry import PIECES, tokenizer_file
from platewise.llm.sentencepiece_codec import Codec


class Counted(dict):
    """A dictionary that counts what is asked of it."""

    asked = 0

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


def invented_words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["ba", "ton", "é", "ing", "str", "ου", "q", "x9", "der", "ação", "中", "😀", "the"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(n)]


def test_new_words_are_walked_by_states_not_by_every_suffix():
    coder = Codec(tokenizer_file(PIECES))
    coder.encode_all([" ".join(invented_words(20_000, 1))])
    coder.ids = Counted(coder.ids)
    new = [w for w in invented_words(20_000, 2) if "▁" + w not in coder.words]
    coder.encode_all([" ".join(new)])
    # every suffix of every prefix was looked up before, several a character
    assert coder.ids.asked < sum(map(len, new)) / 2


def test_states_give_the_ids_of_the_library_also_behind_a_full_cache(monkeypatch):
    from platewise.llm import sentencepiece_codec as module

    monkeypatch.setattr(module, "CACHED_PAIRS", 50)
    monkeypatch.setattr(module, "CACHED_WORDS", 200)
    coder = Codec(tokenizer_file(PIECES))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECES))
    rng = random.Random(3)
    texts = ["", " ", "  a  b", "▁x ▁▁y", "line\nbreak\n", "\x00\t", "naïve   cafés", "a" * 300]
    for seed in range(40):
        words = invented_words(50, seed)
        texts.append("".join(w + rng.choice([" ", "  ", "\n", " "]) for w in words))
    for text in texts:
        ids = memoryview(coder.encode_all([text])[0]).cast("i").tolist()
        assert ids == library.encode(text), text
