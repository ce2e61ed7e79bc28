"""The piecewise encoder against the library on texts of odd white space, marks and contractions."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docengine.llm.token_output import Encoder

SPACES = ["\n", "\n\n", " ", "  ", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", " ", " ", " ", " ", "　", "\x1c", "​", "\r\n"]
WORDS = ["a", "b", "If", "word", "3", "12", "'s", "'ll", "é", "日本", "🙂", ".", ",", ";", "!", "::", "-", "_", "(", "é", "A.", "x:y", "</s>", "<s>", "\x01"]


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return Encoder(path), Tokenizer.from_file(path)


def compare(encoder, library, texts):
    ids, sizes = encoder.texts(pa.array(texts))
    ends = np.cumsum(sizes)
    for text, end, n in zip(texts, ends.tolist(), sizes.tolist(), strict=True):
        assert ids[end - n : end].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_known_hard_texts(both):
    compare(*both, ["a\n\n\tb", "x\n\n\tif a:", "p one\n\n　p two", "a\n\n\rb", "end\n\xa0", "a \n b", "\n", "", " ", "a\n\n\n\nb", "tab\tc\n\td"])


def test_random_texts(both):
    rng = random.Random(11)
    for _ in range(20):
        share = rng.choice([0.2, 0.4, 0.6])
        compare(*both, ["".join(rng.choice(SPACES if rng.random() < share else WORDS) for _ in range(rng.randint(0, 10))) for _ in range(2000)])
