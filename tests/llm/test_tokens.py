"""Ids of the fast path against the tokenizers library on whole texts."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scoreloom.llm.tokens import encoder

ODD = ["", None, " ", "a", " a", "a ", "a  b", "a\n b", "a \n\n b", "  x", "it's  'S <|endoftext|> don't", "é́ x", "\x1c x\x1d y", "ÀÉ İ ß", "日本 語", "1234 5", "x" * 5000, "tab\t tab", "a　 b"]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "joined"), ("word_bpe_49k.json", "dropped")])
def test_same_ids_as_library(name, kind):
    enc = encoder(public_tokenizers.path(name))
    assert enc.kind == kind
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True

    def check(texts):
        ids, bounds = enc.encode(pa.array(texts, pa.string()), 7)
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 7], t

    check(ODD)
    check([])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("ab'sdT1!.é́ß \n\t  日"), max_size=30), max_size=6))
    def many(texts):
        check(texts)

    many()
    assert np.array_equal(enc.encode(pa.array(ODD), 1)[0], enc.encode(pa.array(ODD), 1)[0])
