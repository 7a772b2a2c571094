"""Ids of many texts at once, against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm.bpe import Encoder
from folioflow.llm.hashing import text_slices
from folioflow.llm.queries import vocabulary

PARTS = ["a", "B", "É", "ß", "×", "÷", "ÿ", "Þ", "'", "'s", "'LL", "<", "</w>", "1", "٣", ".", "!?", "`", "{", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "　", "é", "́", "Å", "ſ", "日", "İ", "don't", "\x00", "😀", "Hello", "A" * 300]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary())


def all_ids(encoder, texts, limit=5000):
    out = []
    for _, _, data, offsets in text_slices(pa.array([t.encode() for t in texts], pa.binary()), limit):
        ids, bounds = encoder.flat_ids(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


@pytest.mark.parametrize("plainly", [True, False])
def test_ids_equal_the_library(encoder, monkeypatch, plainly):
    monkeypatch.setattr(encoder, "splits_plainly", plainly)
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3, 20, 400]))) for _ in range(600)] + ["x" * 5000 + "!!", "Y" * 9000 + " a", "!" * 4090 + " b" + "é" * 3000, "", " "]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert all_ids(encoder, texts) == want
    assert all_ids(encoder, []) == [] and all_ids(encoder, ["", " \n"]) == [[], []]


def test_each_piece_is_encoded_once(encoder, monkeypatch):
    asked, before = [], Encoder.piece_ids
    monkeypatch.setattr(Encoder, "piece_ids", lambda self, pieces: asked.extend(pieces) or before(self, pieces))
    ids, bounds = encoder.flat_ids(*(lambda t: (np.frombuffer(t, np.uint8), np.array([0, len(t) // 2, len(t)])))(b"Qzverx qzverx, QZVERX;; " * 4000))
    assert sorted(asked).count(b"qzverx") == 1 and b"Qzverx" not in asked and encoder.joins == 0
    assert ids[bounds[0] : bounds[1]].tolist() == ids[bounds[1] :].tolist() == encoder.tokenizer.encode("Qzverx qzverx, QZVERX;; " * 2000, add_special_tokens=False).ids
