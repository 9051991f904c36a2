import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import textvec as tv

texts = st.lists(st.one_of(st.none(), st.text("ab é\n\t!漢", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_and_lines(given_texts, limit):
    words, lines, hashes = [[] for _ in given_texts], [[] for _ in given_texts], {}
    for block in tv.blocks(pa.array(given_texts, pa.string()), limit):
        raw = block.buf.tobytes()
        start, end, text = block.runs(tv.SPACE)
        for s, e, t, h in zip(start, end, text, block.hashes(start, end), strict=True):
            words[block.first + t].append(raw[s:e].decode())
            assert hashes.setdefault(raw[s:e], int(h)) == int(h)
        for s, e, t in zip(*block.lines(), strict=True):
            lines[block.first + t].append(raw[s:e].decode())
    assert words == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in given_texts]
    assert lines == [(t or "").split("\n") for t in given_texts]
    assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.integers(1, 4))
def test_grams(words, size):
    h, at = tv.grams(tv.mix(np.array(words, np.uint64)), np.zeros(len(words), np.int64), size)
    seen = {}
    for i, x in zip(at.tolist(), h.tolist(), strict=True):
        assert seen.setdefault(tuple(words[i : i + size]), x) == x
    assert len(at) == max(0, len(words) - size + 1)
    assert len(set(seen.values())) == len(seen)


def test_repeated_and_later():
    key, group = np.array([1, 2, 1, 1], np.uint64), np.array([0, 0, 0, 1])
    assert tv.repeated(key, group).tolist() == [True, False, True, False]
    assert tv.later(key, group).tolist() == [False, False, True, False]
