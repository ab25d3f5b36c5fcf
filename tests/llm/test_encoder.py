"""The encoder's fast way for plain texts and its way for the others give what the public library gives."""

import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from fleetstat.llm import bpe

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(WORDS)
    found.no_truncation()
    found.no_padding()
    return found


def mixed(n=3000):
    rng = random.Random(11)
    signs = [*"abzAZ ΣσςİßǅǺéà가.,'9½Ⅷ²\x1c\x1f\x85\t\n ̸", "'s", "  ", "<|endoftext|>", "Ὀδυσσεύς", "x" * 70]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", "   ", " a", "a "]


@pytest.mark.parametrize("kept, part", [(600_000, 1 << 20), (5, 3)])
def test_plain_and_odd_texts_side_by_side(library, monkeypatch, kept, part):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", kept)
    monkeypatch.setattr(bpe, "_PART", part)
    texts, encoder = mixed(), bpe.Encoder(WORDS)
    got = [b for first in range(0, len(texts), 700) for b in encoder.encode(texts[first:first + 700])]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_each_distinct_chunk_is_looked_up_once_a_batch(monkeypatch):
    encoder, asked = bpe.Encoder(WORDS), []
    whole = encoder._found
    monkeypatch.setattr(encoder, "_found", lambda chunks: asked.extend(chunks) or whole(chunks))
    encoder.encode(["one two one", "two one", "one"] * 100)
    assert sorted(asked) == ["one", "two"]
