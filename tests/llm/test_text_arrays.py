import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwell.llm.common import ALNUM, SOLID, Words, ramp, slices
from tests.llm import helpers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_equal_the_patterns(texts):
    for kind, pattern in ((ALNUM, helpers.ALNUM), (SOLID, helpers.SOLID)):
        got = Words([t.encode("utf-8", "surrogatepass") for t in texts], kind)
        want = [[w.encode("utf-8", "surrogatepass") for w in pattern.findall(helpers.lower(t))] for t in texts]
        assert got.counts().tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert got.texts(np.arange(len(flat))) == flat
        assert len(set(got.hash.tolist())) == len(set(flat))


def test_slices_and_ramp():
    assert list(slices([b"aa"] * 5, 4)) == [(0, 2), (2, 4), (4, 5)]
    assert list(slices([b"a" * 9, b""], 4)) == [(0, 1), (1, 2)] and list(slices([])) == []
    assert ramp(np.array([2, 0, 3])).tolist() == [0, 1, 0, 1, 2] and ramp(np.array([], int)).tolist() == []
