"""The stored index, and text files."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from casegraph.operators import search as Q
from casegraph.plans import parts
from casegraph.sources import tables as S
from casegraph.sources.scratch import new_path

DATA = "/root/testdata/sf0.001"
ROWS = [(1, "Vägar i Kalmar", "SOU 2024:1", "kalmar har vägar. Kalmar har broar"), (2, "Broar", "SOU 2024:2", "vägar i norr"), (3, None, None, None), (4, "", "Dir. 2024:3", "har vägar har vägar har vägar"), (5, "Kalmar", None, "x" * 5000)]
TITLE, NUMBER, BODY = 1.0, 0.4, 0.2


def index(spark, parts=8):
    path = new_path(spark, "index")
    Q.store_index(spark.createDataFrame(ROWS, "doc_id long, title string, doc_number string, raw_content string").repartition(3), path, parts=parts)
    return path


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def test_scores_weigh_fields(spark):
    path = index(spark)
    for terms in (["Kalmar", "vägar"], ["sou"], ["2024", "broar", "norr"], ["absent"]):
        expected = []
        for d, *fields in ROWS:
            score = sum(w * words(f).count(t.lower()) for t in terms for f, w in zip(fields, (TITLE, NUMBER, BODY), strict=True))
            if score:
                expected.append((-sum(any(t.lower() in words(f) for f in fields) for t in terms), -round(score, 6), d))
        got = [(-r["terms"], -round(r["score"], 6), r["doc_id"]) for r in Q.search_index(spark, path, terms).collect()]
        assert got == sorted(expected)


def test_rare_words_and_phrases(spark):
    path = index(spark)
    has = Counter(t for _, *fields in ROWS for t in {w for f in fields for w in words(f)})
    got = {r["doc_id"]: r["score"] for r in Q.search_index(spark, path, ["vägar", "norr"], rare=True).collect()}
    weight = lambda t: math.log(1 + len(ROWS) / has[t])
    assert math.isclose(got[2], 0.2 * weight("vägar") + 0.2 * weight("norr")) and math.isclose(got[4], 0.6 * weight("vägar"))
    assert [(r["doc_id"], r["times"]) for r in Q.search_phrase(spark, path, ["har", "vägar"]).collect()] == [(4, 3), (1, 1)]
    assert [(r["doc_id"], r["times"]) for r in Q.search_phrase(spark, path, ["har", "vägar", "har"]).collect()] == [(4, 2)]
    assert Q.search_phrase(spark, path, ["kalmar", "sou"]).count() == 0  # words of two fields are no phrase


def test_only_asked_parts_are_read(spark):
    path = index(spark)
    plan = Q.postings_of(spark, path, ["kalmar"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan) and re.search(r"PushedFilters: \[[^\]]*token", plan)
    own = spark.range(1).select(Q._part(F.lit("kalmar"), 8)).first()[0]
    files = {r["f"] for r in Q.postings_of(spark, path, ["kalmar"]).select(F.input_file_name().alias("f")).collect()}
    assert len(files) == 1 and f"/part={own}/" in files.pop()


def test_an_index_row_holds_many_documents(spark):
    """What is exchanged and stored is a row for each word of a group of documents, and the searches are the plain ones."""
    rows = [(i, "häst", None, " ".join(f"Ord{(i * k) % 7}" for k in range(9)) + " Häst häst") for i in range(300)]
    docs, path = spark.createDataFrame(rows, "doc_id long, title string, doc_number string, raw_content string").repartition(2), new_path(spark, "index")
    Q.store_index(docs, path, parts=2)
    stored = spark.read.parquet(f"{path}/postings")
    assert stored.count() <= 2 * stored.select("token").distinct().count() == 16
    got = {(r["token"], r["doc_id"]): r["places"] for r in Q.postings_of(spark, path, ["häst", "ord0", "Ord3"]).collect()}
    plain = {}
    for i, *fields in rows:
        for f, text in enumerate(fields):
            for at, w in enumerate(words(text)):
                plain.setdefault((w, i), []).append((f << 32) + at)
    assert got == {k: v for k, v in plain.items() if k[0] in ("häst", "ord0", "ord3")}
    assert {r["token"]: r["documents"] for r in Q.postings_of(spark, path, ["ord3"], "frequencies").collect()} == {"ord3": sum(k[0] == "ord3" for k in plain)}


def test_groups_of_words_are_bounded(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a", "b", "a"], [""], ["", "b"], ["a"] * 9, [], ["c", ""]]), pa.array([["b"], ["b"], [], [], [""], ["a"]], pa.list_(pa.string()))], ["id", "x", "y"])
    every = None
    for most in (1, 4, 100):
        monkeypatch.setattr(Q, "_GROUP_WORDS", most)
        out = list(Q._postings([1.0, 0.5], "id")(iter([batch, batch.slice(0, 0)])))
        found = sorted((r["token"], *x) for b in out for r in b.to_pylist() for x in zip(r["id"], r["weight"], r["places"], strict=True))
        assert (len(out) > 2) == (most < 100) and every in (None, found)
        every = found
    y = 1 << 32
    assert every == [("a", 0, 2.0, [0, 2]), ("a", 3, 9.0, list(range(9))), ("a", 5, 0.5, [y]), ("b", 0, 1.5, [1, y]), ("b", 1, 0.5, [y]), ("b", 2, 1.0, [0]), ("c", 5, 1.0, [0])]


def test_rows_of_one_key_are_one_document(spark):
    rows = [(1, "a", None, "b c"), (2, "c", None, None), (1, "a", None, "a c"), (None, "a", None, None), (None, "c", None, None)]
    docs, path = spark.createDataFrame(rows, "doc_id long, title string, doc_number string, raw_content string").repartition(3), new_path(spark, "index")
    Q.store_index(docs, path, parts=4)
    assert {(r["doc_id"], round(r["score"], 6), r["terms"]) for r in Q.search_index(spark, path, ["a", "c"]).collect()} == {(1, 2.6, 2), (None, 2.0, 2), (2, 1.0, 1)}
    assert Q.postings_of(spark, path, ["a"], "frequencies").first()["documents"] == 2


def test_equal_scores_tie(spark):
    """Weights are summed exactly: hits of equal weight score the same, in whatever fields and order they stand."""
    rows = [(3, "b", None, "a"), (1, None, "a b a", None), (2, "a", None, "b"), (4, None, "b b b", "a"), (5, None, None, "a b b b b b b")]
    fields, weights = ("title", "doc_number", "raw_content"), {"title": 1.0, "doc_number": 0.4, "raw_content": 0.2}
    docs, path = spark.createDataFrame(rows, "doc_id long, title string, doc_number string, raw_content string"), new_path(spark, "index")
    Q.store_index(docs.repartition(3), path, weights, parts=2)
    expected = [(4, 1.4, 2), (5, 1.4, 2), (1, 1.2, 2), (2, 1.2, 2), (3, 1.2, 2)]
    assert [tuple(r) for r in Q.search_index(spark, path, ["a", "b"]).collect()] == expected
    assert [tuple(r) for r in Q.ranked_search(Q.token_index(docs, weights), ["a", "b"]).collect()] == expected
    for odd in ((1.0, 1e-30, 0.2), (2, 100.0, 1 / 300)):  # more digits than a decimal has; no fractions and long ones
        path = new_path(spark, "index")
        Q.store_index(docs, path, dict(zip(fields, odd, strict=True)), parts=2)
        got = {r["doc_id"]: r["score"] for r in Q.search_index(spark, path, ["a", "b"]).collect()}
        assert got.keys() == {1, 2, 3, 4, 5} and all(math.isclose(got[d], sum(w * len(words(f)) for f, w in zip(x, odd, strict=True))) for d, *x in rows)


def test_texts_of_files(spark, tmp_path):
    (tmp_path / "a1.txt").write_text("first\nline two\n")
    (tmp_path / "b.c.pdf.txt").write_text("Å")
    (tmp_path / "plain").write_text("no ending")
    (tmp_path / "empty.txt").write_text("")
    got = {r["doc_id"]: r["text"] for r in S.read_texts(spark, str(tmp_path)).collect()}
    assert got.pop("empty", "") == "" and got == {"a1": "first\nline two\n", "b.c.pdf": "Å", "plain": "no ending"}


def vectors(spark, n=400, dim=16, seed=2):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((n // 5, dim))
    x = middle[np.arange(n) % (n // 5)] + 0.45 * r.standard_normal((n, dim))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(1000 + i, [1.0] * dim) for i in range(30)] + [(5, [9.0] * dim), (None, [1.0] * dim), (2000, None), (2001, [0.0] * dim), (2002, [1.0]), (2003, [float("nan")] * dim), (2004, [None] * dim)]
    return rows, spark.createDataFrame([(i, v, "a", 1.0) for i, v in rows], "doc_id long, embedding array<double>, a string, similarity double")


def alike(rows, threshold, dim=16):
    least = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            least[i] = min(least.get(i, v), v)
    ids = sorted(i for i, v in least.items() if any(v))
    x = np.array([least[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    return {(ids[i], ids[j]): cos[i, j] for i in range(len(ids)) for j in range(i + 1, len(ids)) if cos[i, j] >= threshold}


def test_corpus_pairs_against_all_pairs(spark):
    rows, df = vectors(spark)
    expected = alike(rows, 0.8)
    found = {(r["a"], r["b"]): r["similarity"] for r in Q.corpus_pairs(df, 0.8, 0.95, block=10).collect()}
    assert found.keys() <= expected.keys() and len(found) >= 0.9 * len(expected) and len(expected) > 500
    assert all(math.isclose(v, expected[k], rel_tol=1e-9) for k, v in found.items())
    exact = Q.corpus_pairs(df, 0.8, bits=0, block=50)
    assert {(r["a"], r["b"]) for r in exact.collect()} == expected.keys()
    assert Q.corpus_pairs(df.where("false")).count() == 0


def test_recall_on_the_tables(spark):
    pairs = parts.likened(spark, DATA).collect()
    expected = alike([(r["doc_id"], [float(x) for x in r["embedding"]]) for r in pairs], 0.75, 64)
    found = {(r["a"], r["b"]) for r in parts.q05_corpus_pairs(spark, DATA).collect()}
    assert found <= expected.keys() and len(found) >= 0.9 * len(expected) and len(expected) > 50
    links = parts.q06_corpus_links(spark, DATA).collect()
    assert {(r["a"], r["b"]) for r in links} == found and all(0 <= r["score"] <= 1 for r in links)


def test_links_of_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (2, 9, 0.5)], "a long, b long, similarity double")
    summaries = spark.createDataFrame([(1, ["x"], ["k", "l"], ["d"], ["b"], 2020), (2, ["x"], ["k"], ["d"], [], 2010), (3, None, None, None, None, None)], "doc_id long, leads array<string>, keywords array<string>, domains array<string>, bodies array<string>, year int")
    got = {(r["a"], r["b"]): (round(r["score"], 4), r["confidence"]) for r in Q.corpus_links(pairs, summaries).collect()}
    assert got == {(1, 2): (round(0.45 + 0.15 + 0.02 + 0.05 - 0.1, 4), "low"), (1, 3): (0.45, "low"), (2, 9): (0.25, "low")}


def test_tables_grow_with_bits():
    assert Q.hash_tables(10, 0.9, 0.9)[0] == 1
    for n in (10**3, 10**6, 10**9):
        bits, tables = Q.hash_tables(n, 0.9, 0.9)
        same = 1 - math.acos(0.9) / math.pi
        assert 1 - (1 - same**bits) ** tables >= 0.9 and same**bits >= 0.01


def test_a_pair_meets_only_if_it_is_near(spark):
    """What a bucket's task sends on are pairs about the threshold, not all that share the bucket."""
    x = np.random.default_rng(4).standard_normal((600, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    run, _ = Q._near(0.5, "long")
    rows = pa.table({"bucket": np.zeros(600, np.int64), "row": np.zeros(600, np.int32), "column": np.ones(600, np.int32), "own": (np.arange(600) % 2).astype(np.int32), "id": np.arange(600), "unit": [r.tobytes() for r in x]})
    got = {tuple(sorted(p)) for b in run(iter(rows.to_batches(max_chunksize=70))) for p in zip(*(c.to_pylist() for c in b.columns))}
    assert got == {(i, j) for i in range(600) for j in range(i + 1, 600) if (i + j) % 2 and x[i] @ x[j] >= 0.5} and got
    assert Q.hash_tables(100_000, 0.75, 0.99)[1] <= 12  # a vector is exchanged once a table
