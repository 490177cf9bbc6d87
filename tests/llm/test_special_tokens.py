"""Special tokens in the text, in whatever case, get the ids the tokenizer gives them."""

import public_tokenizers
import pytest

from forumloom.llm import packing

TEXTS = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "<|EndOfText|>", "x<|startoftext|>Y Z", "PLAIN Words <| A", "É <|ENDOFTEXT|>É"]


@pytest.mark.parametrize("cached", [0, 1000, packing.CACHED_BYTES])
def test_ids_equal_the_tokenizer(cached):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(path, cached)
    for _ in range(2):
        found = [x.tolist() for x in encoder.encode([t.encode() for t in TEXTS])]
        assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert encoder.bytes <= cached
