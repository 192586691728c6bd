"""Texts with added tokens get the ids of the library's plain call."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from proofloom.llm import tokens

TEXTS = [
    "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b.\nNo <|startoftext|> here", "plain words, twice plain", "Hello <|EndOfText|> World", "", "<|endoftext|", "x \n <|endoftext|>\n\ny",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens(name):
    path = tokens.vocabulary_path(name)
    plain = Tokenizer.from_file(path)
    expected = [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(path).ids(TEXTS)] == expected
    assert max(expected[0]) == {"word_bpe_49k.json": 49407, "byte_bpe_50k.json": 50256}[name]
