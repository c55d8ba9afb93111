"""The recurrent network: gradients, windows, inputs, and scores of small and of held-out tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from casegraph.llm import toxicity as T
from casegraph.llm.queries import op12_recurrent_toxicity
from casegraph.llm.shingles import word_hashes

DATA = "/root/testdata/sf0.1"


def test_gradients_are_slopes_of_the_loss():
    r = np.random.default_rng(0)
    net = T.Network.start(np.array([5, 9], np.uint64))
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    net.weights["look"] = r.standard_normal(2 * T.UNITS)
    words, sizes, x = r.integers(0, 7, (5, 6)), np.array([6, 3, 1, 6, 4]), r.standard_normal((7, T.OWN + T.CHARS))
    y = np.array([1.0, 0, 1, 0, 1])

    def loss():
        z = net.forward(words, sizes, x).astype(np.float64)
        return float(np.sum(np.logaddexp(0, z) - y * z))

    kept = net.forward(words, sizes, x, keep=True)
    slope = 1 / (1 + np.exp(-kept[0].astype(np.float64))) - y
    g, at_x = net.backward(words, sizes, x, kept, slope)
    for array, gradient in [*((net.weights[k], g[k]) for k in g), (x, at_x)]:
        for i in r.integers(0, array.size, 5):
            old, h = array.flat[i], 1e-2
            array.flat[i] = old + h
            up = loss()
            array.flat[i] = old - h
            down = loss()
            array.flat[i] = old
            assert abs((up - down) / (2 * h) - gradient.flat[i]) < 2e-3 * max(1, abs(gradient.flat[i]))


def test_windows_hold_all_words():
    for n in [0, 1, 31, 32, 33, 48, 49, 64, 65, 1000]:
        first, sizes, row = T.windows(np.array([7, 7 + n, 7 + n]))
        seen = [w for a, s in zip(first, sizes, strict=True) for w in range(a, a + s)]
        assert set(seen) == set(range(7, 7 + n)) and set(row) <= {0} and all(s > 0 for s in sizes)
        assert n <= T.WINDOW or all(b - a == T.STRIDE for a, b in zip(first, first[1:], strict=False))


def test_word_inputs_do_not_depend_on_neighbours():
    texts = pa.array(["one two\x02 three", None, "", "TWO\x02 ü", "x" * 3000 + " two\x02"])
    hashes, grams, at, number, before = T.distinct_words(texts)
    assert before.tolist() == [0, 3, 3, 3, 5, 7] and number[1] == number[3] == number[6] and len(set(number.tolist())) == 5
    for word in ("one", "two\x02", "ü"):
        h, g, a, _, _ = T.distinct_words(pa.array([word]))
        i = int(np.flatnonzero(hashes == h[0])[0])
        assert sorted(grams[at[i] : at[i + 1]].tolist()) == sorted(g[a[0] : a[1]].tolist())


def test_pattern_words_have_hashes_of_their_own():
    # a word that the powers of any base cancel out against its mirror image, modulo 2^64
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    word, other = bytes(97 + b for b in bits), bytes(98 - b for b in bits)
    data = np.frombuffer(word + other, np.uint8)
    a, b = word_hashes(data, np.array([0, 4096]), np.array([4096, 8192]))
    assert a != b


def small(spark):
    r = np.random.default_rng(3)
    plain = ["".join(r.choice(list("abcdefghij"), 5)) for _ in range(150)]
    rows, labels = [], []
    for i in range(240):
        words = [plain[j] for j in r.integers(0, len(plain), int(r.integers(1, 120)))]
        if i % 4 == 0:
            words[int(r.integers(0, len(words)))] = ["zounds", "ZOUNDSER", "qwux!", "zoundsen"][int(r.integers(0, 4))]
        rows.append((i, " ".join(words), "x", 1.0))
        labels.append((i, int(i % 4 == 0), 1))
    rows += [(500, None, "x", 1.0), (501, "", "x", 1.0), (502, " \n", "x", 1.0), (None, "zounds " * 3, "x", 1.0), (503, " ".join(plain * 400) + " zounds", "x", 1.0), (504, " ".join(plain[:90] * 400), "x", 1.0), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0), (8, 5, 1), (9, 0, 1)], "doc_id long, toxic int, quality int")


def test_scores_of_small_tables(spark):
    docs, labels = small(spark)
    out = T.toxicity_scores(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "first_word", "n_words"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["score"] == 0 for i in (500, 501, 502)) and by[None]["held_out"] is False and by[None]["predicted"] == 1
    assert by[503]["predicted"] == 1 and by[503]["first_word"] + by[503]["n_words"] == 150 * 400 + 1 and by[504]["predicted"] == 0
    assert len({round(r["score"], 4) for r in rows if r["doc_id"] == 4}) == 1
    kept = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 240 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in kept)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in kept) >= 0.9 * len(kept)


def test_no_rows_and_no_labels(spark):
    docs, labels = small(spark)
    assert T.toxicity_scores(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in T.toxicity_scores(docs.where("doc_id < 20"), labels.where("toxic = 0")).collect()} == {0.0}


@pytest.fixture(scope="module")
def held_out(spark):
    out = op12_recurrent_toxicity(spark, DATA).where("held_out")
    return out.join(spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()


def test_held_out_accuracy(held_out):
    right = [r["predicted"] == r["toxic"] for r in held_out]
    assert len(right) > 700 and sum(right) > 0.96 * len(right)
    clean = [r["predicted"] for r in held_out if r["toxic"] == 0]
    assert sum(clean) < 0.03 * len(clean)
