"""The packing encoder gives the tokenizer's own ids."""

import random

import public_tokenizers
import pytest

from examlattice.llm import packing

ALPHABET = ["abcdefghij", "ABCXYZ", "éÉçÇßœŒÿŸäÖñ", "0123456789", "'", "'s'T'll", ".,;:!?-_()[]{}<>/\\\"@#$%^&*+=~`|", "\u00a0\u2003\u3000", "\u0301\u0327", "\u0130\u01c5\u1e9e\u03a3\u03c2", "русский", "中文字", "\x01\x02\x1c\x7f\x85", "١٢²½Ⅷ", "😀", "ªº×÷µ"]


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_the_tokenizers(seed):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = packing.Encoder(path)
    assert own.byte_level is not None
    r = random.Random(seed)
    texts = ["", " ", "don't I'LL they'd 'sorry' it's", "Straße, Œuvre; naïve ÿ Ÿ"]
    for _ in range(300):
        texts.append("".join(r.choice([" ", "\n", "\t", "  "]) if r.random() < 0.15 else r.choice(ALPHABET[r.choice([0, 0, 0, 1, 2, 2, r.randrange(len(ALPHABET))])]) for _ in range(r.randrange(200))))
    for text, ids in zip(texts, own.encode(texts, 2)):
        assert ids.tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_cache_is_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 1000)
    own = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for n in range(50):
        list(own.encode([f"{n}" + "x" * 300], 2))
        assert own.kept <= 2000
