"""Parts of the operators that need no session, against plain versions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from casegraph.llm.minhash import link_sets, min_max_bands
from casegraph.llm.shingles import shingle_sets
from casegraph.llm.suffix import has_previous_factor, longest_previous_factors, smaller_neighbours, suffix_order, window_runs
from casegraph.llm.warc import merge_runs, parse_records

TEXT = st.text(alphabet="abAB \n\té", max_size=60)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_shingle_sets_are_as_large_as_the_sets_of_words(texts):
    sets, offsets = shingle_sets(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        plain = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert offsets[i + 1] - offsets[i] == len(plain)


def test_equal_shingles_have_equal_hashes_wherever_they_stand():
    sets, offsets = shingle_sets(pa.array(["x y a b c d e", "a B c\td e", "a b c d"]))
    assert set(sets[offsets[1] : offsets[2]]) < set(sets[: offsets[1]])
    assert not set(sets[offsets[2] :]) & set(sets[: offsets[2]])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", max_size=40))
def test_previous_factors(text):
    raw = text.encode()
    full = longest_previous_factors(raw)
    for i, n in enumerate(full):
        best = max((k for j in range(i) for k in range(len(raw) - i + 1) if raw[j : j + k] == raw[i : i + k]), default=0)
        assert n == best
    length = 11
    starts = np.arange(max(0, len(raw) - length + 1))
    order, equal = suffix_order(np.frombuffer(raw, np.uint8), starts, length)
    assert has_previous_factor(order, equal, starts).tolist() == [full[i] >= length for i in starts]
    assert [raw[starts[i] : starts[i] + length] for i in order] == sorted(raw[i : i + length] for i in starts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.booleans()), max_size=40))
def test_smaller_neighbours(rows):
    position = np.array([p * 64 + i for i, (p, _) in enumerate(rows)], np.int64)
    equal = np.array([e and i > 0 for i, (_, e) in enumerate(rows)], bool)
    before, after = smaller_neighbours(np.arange(len(rows)), equal, position)
    run = np.cumsum(~equal)
    for i in range(len(rows)):
        own = [j for j in range(len(rows)) if run[j] == run[i] and position[j] < position[i]]
        assert before[i] == max((j for j in own if j < i), default=-1)
        assert after[i] == min((j for j in own if j > i), default=-1)


def test_equal_windows_have_equal_names():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 101, 400, dtype=np.uint8)
    names = {}
    for lead in (b"", b"xyz" * 50, b"q"):
        text = np.concatenate([np.frombuffer(lead, np.uint8), passage, np.frombuffer(b"end" * 40, np.uint8)])
        keys, firsts, counts = window_runs(text, 100)
        for k, f, c in zip(keys, firsts, counts, strict=True):
            for p in range(f, f + c):
                assert names.setdefault(text[p : p + 100].tobytes(), k) == k
        assert counts.sum() == len(text) - 99


def test_links_join_what_all_pairs_would():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, 25)).astype(np.uint64) for _ in range(60)]
    part = list(range(60))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 50 * (len(sets[i]) + len(sets[j]) - both):
                part[find(i)] = find(j)
    found = list(range(60))
    for a, b in link_sets(sets, list(range(60)), 50):
        found[:] = [found[a] if x == found[b] else x for x in found]
    assert {frozenset(i for i in range(60) if find(i) == find(r)) for r in range(60)} == {frozenset(i for i in range(60) if found[i] == found[r]) for r in range(60)}


def test_min_max_values_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 2**63, 40).astype(np.uint64)])
    keys = min_max_bands(np.concatenate([a, b]), np.array([0, 400, 800]), 2000, 1)
    assert abs((keys[0] == keys[1]).mean() - 360 / 440) < 0.03


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree(runs):
    assert list(merge_runs([sorted(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_records_go_by_their_length():
    block = b"a\r\n\r\nWARC/1.1\r\nb"
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(x), x) for x in (block, b""))
    assert [r[1] for r in parse_records(data)] == [block, b""]
