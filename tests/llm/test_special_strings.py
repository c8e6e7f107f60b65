"""Special strings are matched by case and before folding."""

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import packing

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|", "|>", "<", "|", "Word", "word.", "X,", "é", "É", " ", "\n", "."]


def ids(text):
    return list(np.frombuffer(packing.encode([text], BPE)[0], "<u4"))


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "Some <|EndOfText|> here", "A<|ENDOFTEXT|>B. <|endoftext|>C, Plain.", "<|EndOfText|>., X"])
def test_special_strings_by_case(text):
    assert ids(text) == brute.token_ids(text)[:-1]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@settings(max_examples=200, deadline=None)
def test_ids_around_special_strings(text):
    assert ids(text) == brute.token_ids(text)[:-1]
