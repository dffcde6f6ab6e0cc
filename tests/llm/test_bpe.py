"""Byte-level BPE without Spark: its caches, and odd texts against the tokenizers library."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vellum.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", " \n", "\t", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "﻿", "᠎", "a", "word", "Straße", "été", "ÿ×÷ª", "слово", "字", "é", "ẞ", "ɏɐ", "'s", "'ll", "'", "don't", "x.", "...", "12", "3½", "²", "_", "\x00", "😀", "<|endoftext|>", "<|endof"]


def test_odd_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(1, 12))) for _ in range(20_000)]
    texts += [" " + x + y for x in PARTS for y in PARTS] + ["ab" * 9000, "é" * 9000, " " * 20_000 + "a", "x" + " " * 20_000]
    library = Tokenizer.from_file(PATH)
    for own in (bpe.ByteBPE(PATH), bpe.ByteBPE(PATH, 12)):  # the second one's caches are full again and again
        for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            ids = own.encode(text)
            assert np.frombuffer(ids, "<u4").tolist() == expected.ids, text
            assert own.decode(ids) == library.decode(expected.ids, skip_special_tokens=False) == text


@pytest.fixture
def merged(monkeypatch):
    """How often each piece was merged."""
    count, merge = Counter(), bpe.ByteBPE._piece
    monkeypatch.setattr(bpe.ByteBPE, "_piece", lambda self, piece: (count.update([piece]), merge(self, piece))[1])
    return count


def test_words_in_use_stay_when_the_cache_is_full(merged):
    common = [f"often{chr(97 + k)}" for k in range(20)]
    rare = [f"rare{chr(97 + i)}{chr(97 + j)}{chr(97 + k)}" for i in range(10) for j in range(20) for k in range(20)]
    own = bpe.ByteBPE(PATH, 400)
    for k in range(0, len(rare), 100):
        own.encode(" ".join(["x", *common, *rare[k : k + 100]]))
    assert {w: merged[" " + w] for w in common} == dict.fromkeys(common, 1)
    assert len(own.of_stretch) <= 400 and len(own.of_stretch.older) <= 400


def test_long_stretches_are_not_kept(merged):
    own = bpe.ByteBPE(PATH)
    for _ in range(2):
        own.encode("x " + "字、" * 100 + " " + "y" * 100 + " z")
    assert merged[" " + "y" * 100] == 2 and merged["字"] == 1
    assert max(len(k) for kept in (own.of_stretch, own.of_piece) for k in kept) <= 64
