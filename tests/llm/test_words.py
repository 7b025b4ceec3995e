import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from epigrain.llm.words import distinct_per_text, shingle_hashes, word_hashes

TEXTS = st.lists(st.text(alphabet="aAbé \n\t\x0b\x1c.,", max_size=40), max_size=6)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_words_and_shingles_match_a_plain_version(texts, width):
    hashes, at = word_hashes([t.encode() for t in texts])
    words = [re.findall(r"[^\x20\x09-\x0D]+", fold(t)) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for t in words for w in t]
    assert len(set(flat)) == len(set(hashes.tolist()))
    assert len({(w, h) for w, h in zip(flat, hashes.tolist())}) == len(set(flat))
    made, where = distinct_per_text(*shingle_hashes(hashes, at, width))
    seen = {}
    for i, w in enumerate(words):
        want = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
        got = made[where[i] : where[i + 1]]
        assert len(got) == len(want)
        seen.setdefault(frozenset(want), set()).add(got.tobytes())
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)
