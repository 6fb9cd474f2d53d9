"""The encoder's pieces and tables against the library."""

import random

import public_tokenizers
import pytest

from noteweave.llm import encoding

PATHS = [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")]
PARTS = ["The", "the", "THE", "élan", "Àß", "ÿ", "×", "÷", "a×b", " ", "  ", "\n", "\n ", " \n", "\t", "\r\n", ".", ", ", "!?", "12", "3rd", "it's", "'", "don't ", "İ", "K", "Å", "ẞ", "Ÿ", "é", "́", "\xa0", "\x85", "\x1c", "\x00", "日本", "ж", "😀", "<|endoftext|>", "<|", "w" * 80, "$$$", "a\x0bb", "Ã", "ã"]


@pytest.mark.parametrize("path", PATHS)
def test_batches_of_texts(path, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(encoding, "MEMO_PIECES", 60)
    monkeypatch.setattr(encoding, "GROUP_CHARS", 300)
    encoder = encoding.PieceEncoder(path, 4)
    for few in (PARTS, PARTS[:20], PARTS[:6] + [" ", " ", ", "]):
        for _ in range(40):
            texts = ["".join(rng.choice(few) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30))] + ["end ", "a", "", " b", " "]
            assert encoder.encode(texts) == encoder.whole(texts)
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


@pytest.mark.parametrize("path", PATHS)
def test_new_words_go_to_the_library_together(path, monkeypatch):
    calls = []
    encoder = encoding.PieceEncoder(path, 4)
    whole = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda texts, *more: calls.extend(texts) or whole(texts, *more))
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdeéñü", k=rng.randrange(1, 12))) for _ in range(100)) for _ in range(20)]
    assert encoder.encode(texts) == whole(texts)
    assert len(calls) <= 40  # they were as many as different words
    calls.clear()
    assert encoder.encode(texts) == whole(texts) and not calls
