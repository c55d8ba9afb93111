import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casegraph.llm.packing import sum_of_squares
from casegraph.llm.simple8b import decode, encode


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=1500), st.sampled_from([1, 7, 512]))
def test_round_trip(values, block):
    x = np.array(values, np.uint64)
    words, offsets = encode(x, block)
    assert offsets[-1] == len(words)
    assert (decode(words, offsets, len(x), block) == x).all()


def test_runs_of_zero_take_one_word():
    words, _ = encode(np.zeros(240, np.uint64))
    assert len(words) == 1


@pytest.mark.parametrize("seed", range(4))
def test_bins_hold_their_sizes(seed):
    sizes = np.random.default_rng(seed).integers(1, 100, 500)
    bins, offsets = sum_of_squares(sizes, 100)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own[0]] == 0
        assert (offsets[own][1:] == np.cumsum(sizes[own])[:-1]).all()
        assert sizes[own].sum() <= 100
    room = []  # first fit, larger sizes first
    for size in sorted(sizes.tolist(), reverse=True):
        k = next((k for k, r in enumerate(room) if r >= size), None)
        if k is None:
            room.append(100 - size)
        else:
            room[k] -= size
    assert bins.max() + 1 <= 1.03 * len(room) + 1
