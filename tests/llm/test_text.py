import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwise.llm import text as X
from helpers import lower

PATTERNS = {"BLANK_WORDS": r"[^\x20\x09-\x0D]+", "PLAIN_WORDS": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def hashed(texts, kind):
    data, offsets = X.utf8(pa.array(texts, pa.string()))
    return X.hash_words(data, offsets, kind)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aB9 \t\n-_.é日\x00{")), max_size=40)), min_size=1, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for name, pattern in PATTERNS.items():
        words = [re.findall(pattern, lower(t)) for t in texts]
        hashes, counts = hashed(texts, getattr(X, name))
        assert counts.tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        by_word = dict(zip(flat, hashes.tolist()))
        assert [by_word[w] for w in flat] == hashes.tolist()
        assert len(set(by_word.values())) == len(by_word)


def test_tokens_are_runs_of_one_class():
    hashes, counts = hashed(["ab***Ab *** !!"], X.TOKENS)
    assert counts.tolist() == [5]
    assert hashes[1] == hashes[3] and hashes[0] != hashes[2]


def test_long_rows_are_cut_outside_words(monkeypatch):
    text = " ".join(f"word{k}é" for k in range(500)) + " " + "z" * 400 + " end"
    whole, _ = hashed([text], X.BLANK_WORDS)
    monkeypatch.setattr(X, "SLICE_BYTES", 64)
    parts, counts = hashed(["a", text, None, "b"], X.BLANK_WORDS)
    assert counts.tolist() == [1, len(whole), 0, 1]
    assert np.array_equal(parts[1:-1], whole)


def test_slices_of_arrow_columns():
    column = pa.array(["skip", "one two", None, "three"], pa.string()).slice(1)
    data, offsets = X.utf8(column)
    _, counts = X.hash_words(data, offsets, X.BLANK_WORDS)
    assert counts.tolist() == [2, 0, 1]
