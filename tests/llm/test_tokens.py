"""Pieces of plain text are merged by the library's model alone, and give the whole library's ids."""

import random

import public_tokenizers
import pytest

from scribespark.llm.tokens import PieceEncoder

NAMES = (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word"))


class Counting:
    """A tokenizer that counts the pieces it is given as texts."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.calls = tokenizer, tokenizer.model, 0

    def encode(self, *args, **kwargs):
        self.calls += 1
        return self.tokenizer.encode(*args, **kwargs)


def ids(encoder, text):
    return memoryview(encoder.encode(text)).cast("I").tolist()


@pytest.mark.parametrize("name, kind", NAMES)
def test_plain_pieces_ask_the_model(name, kind):
    encoder = PieceEncoder(public_tokenizers.path(name), kind)
    whole = encoder.tokenizer
    encoder.pieces.tokenizer = counting = Counting(whole)
    text = "The tokens, those of Éamon's 1,024 words,\nare merged (once).\n\nÀ bientôt ! " * 3
    assert ids(encoder, text) == whole.encode(text, add_special_tokens=False).ids
    assert counting.calls == 0
    assert ids(encoder, text + "漢字") == whole.encode(text + "漢字", add_special_tokens=False).ids
    assert counting.calls == 1


@pytest.mark.parametrize("name, kind", NAMES)
def test_blanks(name, kind):
    encoder, draw = PieceEncoder(public_tokenizers.path(name), kind, most=30_000), random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(" \n\t\r  a's,B.é7\0　漢") for _ in range(draw.randint(0, 16)))
        assert ids(encoder, text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
