"""Spelling variants against a plain search of near words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from casegraph.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows, slips=97, least=5, many=3):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % slips == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    words = sorted(w for w, c in n.items() if c >= many and len(w) >= least)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def corpus():
    r = np.random.default_rng(4)
    base = ["".join(r.choice(list("abcdå×"), int(r.integers(5, 9)))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aabaaa"]
    letters = "".join(r.choice(list("abcdefgh"), 3000))
    giants = [letters, letters[:1500] + "z" + letters[1501:], letters[:7] + letters[8:], letters + "q", "a" * 64, "a" * 65, "a" * 66, "a" * 67, "b" + "a" * 64]
    rows = []
    for i in range(60):
        words = [base[j] for j in r.integers(0, len(base), 200)]
        for j in r.integers(0, 200, 60):
            w, k = words[j], int(r.integers(0, len(words[j])))
            words[j] = [w[:k] + w[k + 1 :], w[:k] + "cdß"[k % 3] + w[k + 1 :], w[:k] + "e" + w[k:], w.upper()][int(r.integers(0, 4))]
        rows.append((i, " ".join(words) + " " + ", ".join(giants if i < 4 else []) + "\n ÅÉ œuvre 1a2"))
    return [*rows, (5, rows[5][1]), (None, rows[7][1]), (None, None), (70, None), (71, ""), (72, "  .,"), (73, "hot " * 4000 + "wordy " * 4000)]


@pytest.mark.parametrize("slips", [97, 3])
def test_variants_equal_plain_search(spark, slips):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "w", 1, "k") for d, t in rows], "doc_id long, text string, word string, n long, key string")
    got = [tuple(r) for r in spelling.spelling_variants(docs, slips=slips).collect()]
    expected = plain(rows, slips)
    assert len(got) == len(set(got)) and set(got) == expected
    assert slips == 3 or any(len(w[0]) > 2000 and w[4] > 1 for w in expected)


def test_all_keys_hashed_give_the_same(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert {tuple(r) for r in spelling.spelling_variants(docs, longest=5).collect()} == plain(corpus())


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "a bc")], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0 and spelling.spelling_variants(docs.where("false")).count() == 0
