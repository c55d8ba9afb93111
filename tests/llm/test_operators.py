"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.llm import dense, extract, forest, minhash, mixing, packing, quality, simple8b, suffix, topk, warc
from casegraph.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(8)
VOCABULARY = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(VOCABULARY[i] for i in r.integers(0, len(VOCABULARY), n))


def texts():
    base = prose(120, 1)
    words = base.split()
    near = [" ".join(w if i != 50 + 9 * k else "zz" for i, w in enumerate(words)) for k in range(6)]
    return [base, base, *near, None, "", "  ", "one two", "ONE\ttwo", "ab" * 400, prose(3000, 2), prose(40, 3) + "\n" + base[:300], base[200:] + " é" + prose(30, 4), "å" * 150, "å" * 120]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "x", 1.0) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "null id " + prose(20, 9), "en", "s1", 1, "x", 1.0)]
    # more columns, with names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size double")


def empty(docs):
    return docs.where("false")


def test_near_duplicates(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                part[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    expected = sorted((d if d is not None else -1, len(sets[i]), least.get(find(i), -1)) for i, (d, _) in enumerate(rows))
    for unit_docs in (3000, 3):  # the second way deals clusters over several units
        got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in minhash.near_duplicates(docs, unit_docs=unit_docs).collect()]
        assert sorted(got) == expected
    assert minhash.near_duplicates(empty(docs)).count() == 0
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for i, (d, _) in enumerate(rows) if d is None or least[find(i)] == d}


def test_repeats(spark, docs):
    def brute(rows, length=100):
        seen, out = set(), []
        for d, t in sorted(rows, key=lambda r: (r[0] if r[0] is not None else -math.inf, (r[1] or "")[:100].encode())):
            raw = (t or "").encode()
            marks = np.zeros(len(raw) + 1, int)
            for i in range(len(raw) - length + 1):
                w = raw[i : i + length]
                if w in seen:
                    marks[i] += 1
                    marks[i + length] -= 1
                seen.add(w)
            gone = np.cumsum(marks[:-1]) > 0
            kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
            out.append((d, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        return sorted(out, key=str)

    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, suffix.repeat_report(docs).collect()), key=str) == expected
    salted = suffix.without_repeats(docs, salt_rows=2).select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, salted.collect()), key=str) == expected
    cut = suffix.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count() and suffix.repeat_report(empty(docs)).count() == 0


def test_mix(spark, docs):
    rows = docs.collect()
    size = lambda t: len(WORD.findall(t or ""))
    totals = {}
    for r in rows:
        totals[r["source"]] = totals.get(r["source"], 0) + size(r["text"])
    order = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(totals.values()), set(order)
    while True:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * totals[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        free -= over
    got = mixing.mix_sources(docs, bucket_rows=4).collect()
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert {s: taken[s] for s in order} == {s: math.floor(target[s] + 1e-9) for s in order}
    again = mixing.mix_sources(docs.repartition(7), bucket_rows=4)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    clash = docs.withColumns({c: F.lit(1) for c in ("_key", "_k", "_doc", "_size", "of", "row", "nth", "taken", "all")})
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and sum(size(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in mixing.mix_sources(docs).collect())
    assert mixing.mix_sources(empty(docs)).count() == 0 and mixing.mixed_documents(empty(docs)).count() == 0


def test_tokens_and_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] if r[0] is not None else -1, 0))
    ids = [(d, t.encode(x, add_special_tokens=False).ids) for d, x in rows]
    start, expected = 0, []
    for d, x in ids:
        expected.append((d, len(x) + 1, crc([*x, 1])))
    got = sorted(simple8b.token_files(docs, tokenizer()).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(expected, key=str)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    placed = packing.best_fit_packing(docs, tokenizer(), length=256).collect()
    pieces = sorted(((d, k, a, len(x[a : a + 256]), crc(x[a : a + 256])) for d, x in ((d, [*x, 0]) for d, x in ids) for k, a in enumerate(range(0, len(x), 256))), key=str)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed), key=str) == pieces
    held = {}
    for r in placed:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    assert simple8b.token_files(empty(docs), tokenizer()).count() == 0 and packing.best_fit_packing(empty(docs), tokenizer()).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.standard_normal(16) * (1 + i % 3)], 0) for i in range(600)]
    rows += [(600 + i, rows[7][1], 0) for i in range(40)] + [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] * 16, 0), (703, [None] * 16, 0), (704, [1.0] * 9, 0), (None, [1.0] * 16, 0), (0, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def valid(vectors, zero):
    rows = {}
    for r in vectors.collect():
        e = r["embedding"]
        if r["vec_id"] is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and (zero or any(e)):
            rows[r["vec_id"]] = np.array(list(e) + [0.0] * (16 - len(e)))
    return rows


def test_exact_top_k(vectors):
    rows = {i: np.floor(256 * v).astype(np.int64) for i, v in valid(vectors, True).items()}
    expected = set()
    for q in (i for i in rows if i % 50 == 0):
        best = sorted(((-int(rows[q] @ v), i) for i, v in rows.items() if i != q))[:5]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    for shard in (16_384, 90):
        got = topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, shard_rows=shard, block_rows=16, query_rows=5)
        assert {tuple(r) for r in got.collect()} == expected
    assert topk.exact_top_k(vectors.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_forest_recall(vectors):
    rows = valid(vectors, False)
    got = {}
    for r in forest.hash_prefix_forest(vectors, F.col("vec_id") % 20 == 0, least=200, shard_rows=300).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in rows if i % 20 == 0}
    found = total = 0
    for q, hits in got.items():
        best = sorted(((-dense.inner_products(v[None, :], rows[q])[0], i) for i, v in rows.items() if i != q))[:20]
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
        assert all(h[2] == dense.inner_products(rows[h[1]][None, :], rows[q])[0] for h in hits)
        assert [(-h[2], h[1]) for h in hits] == sorted((-h[2], h[1]) for h in hits)
        found, total = found + len({h[1] for h in hits} & {i for _, i in best}), total + len(best)
    assert found / total >= 0.9
    assert forest.hash_prefix_forest(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_quality(spark):
    good = [(i, prose(60, i).capitalize() + ".", "x") for i in range(150)]
    bad = [(1000 + i, " ".join([VOCABULARY[i]] * 60).upper(), "x") for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (5000, None, "x"), (5001, "", "x"), (None, "A b.", "x")], "doc_id long, text string, terms string")
    labels = spark.createDataFrame([(d, int(d < 1000), 0) for d, *_ in [*good, *bad]] + [(0, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels, sample=64).collect()
    assert len(rows) == 213 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    known = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 5000]
    assert sum(r["predicted"] == int(r["doc_id"] < 1000) for r in known) / len(known) > 0.95
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality.accepted(docs, labels, sample=64).columns == docs.columns
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def test_archive_round_trip(spark):
    big = "x" * 1200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a.se/x", big, 0), (2, "http://a.se/y\r\n", big, 0), (9, None, big, 0), (3, "http://b.se", "short", 0), (4, "http://b.se", "short", 0), (5, "http://b.se/z", None, 0), (6, "https://www.a.se/x", "", 0), (7, "u", "é" * 600, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, bytes int")
    out = warc.archive(pages).collect()
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out}
    raw = {i: (h or "").encode() for i, _, h, _ in rows}
    assert got == {i: (len(b), hashlib.sha1(b).hexdigest(), "revisit" if i in (1, 2) else "response", 9 if i in (1, 2) else None) for i, b in raw.items()}
    assert warc.archive(pages.where("false")).count() == 0
    index = warc.merged_index(warc.read_runs(spark, write(pages)), part_rows=3)
    order = [(r["urlkey"], r["ts"], r["page_id"]) for r in index.collect()]
    assert order == sorted(order)


def write(pages):
    path = warc.new_path(pages.sparkSession, "warc")
    warc.write_warc(pages, path, file_bytes=2000)
    return path


def test_pages_keep_their_rows(spark):
    page = "<body><div>Site</div><p>Words {}</p><div>End</div>"
    rows = [(i, f"http://a.se/{i}", page.format(i), "t") for i in range(9)] + [(20, None, None, "t"), (21, "x", "", "t"), (3, "http://a.se/3", page.format(3), "t"), (30, "http://b.se/", "<article><h1>A</h1><p>B</article><p>C", "t")]
    out = extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), part_rows=4).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    text = {r["page_id"]: r["text"] for r in out}
    assert text[30] == "A\nB" and text[20] == text[21] == "" and all(text[i] == f"Words {i}" for i in range(9))


def test_units_of_a_large_cluster_are_bounded(spark, monkeypatch):
    def text(i):  # shares 80 of 100 words with the others: buckets in common, but no link
        return " ".join([*VOCABULARY[:80], *(f"own{i}x{k}" for k in range(20))])

    rows = [(i, text(i)) for i in range(150)] + [(150 + i, text(i) + " end") for i in range(0, 150, 10)]
    sizes, confirm = [], minhash._confirm

    def noted(members, *args, **kwargs):
        sizes.append(members.groupBy(*(c for c in members.columns if c in ("unit", "cluster", "own"))).count().agg(F.max("count")).first()[0])
        return confirm(members, *args, **kwargs)

    monkeypatch.setattr(minhash, "_confirm", noted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), unit_docs=15, rows=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - 150 if i >= 150 else i for i, _ in rows}
    assert len(sizes) == 2 and sizes[1] <= 4 * 15  # two blocks, with room for the hash


def test_page_texts_do_not_depend_on_partitions(spark):
    page = "<body><div>Site</div><p>Words {}</p><div>End</div>"
    rows = [(i, f"http://a.se/{i}", page.format(i)) for i in range(9)] + [(10 + i, f"http://b.se/{i}", page.format(10 + i)) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part_rows in (1, 2, 3, 4, 100):
        out = extract.extract_text(pages, part_rows=part_rows).collect()
        assert sorted((r["page_id"], r["text"]) for r in out) == [(i, f"Words {i}") for i, _, _ in rows]
    assert extract.extract_text(pages.where("false")).count() == 0


def test_a_frequent_name_scatters_in_the_second_round():
    pa = pytest.importorskip("pyarrow")
    r = np.random.default_rng(4)
    line, own = bytes(r.integers(97, 123, 60, dtype=np.uint8)), lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8))
    texts = [own(37) + line + own(37) for _ in range(200)]
    texts[7] = texts[5][:110] + own(24)  # its first eleven windows are those of 5
    n = len(texts)
    table = pa.table({"key": [1] * n, "doc": list(range(n)), "nth": [0] * n, "first": [9] * n, "salts": pa.array([3] * n, pa.int32()), "bytes": [0] * n, "text": pa.array(texts, pa.binary())})
    survivors, spans = suffix._spans(table, 100)
    assert spans == [(7, 0, 110)]
    second = pa.concat_tables(suffix.window_rows(table, *survivors, 100)).to_pylist()
    assert len(second) == 35 * n - 11 and len({w["key"] for w in second}) == len(second)
    assert all(w["text"] == texts[w["doc"]][w["first"] - 9 :][:100] and w["salts"] == 1 for w in second)


def test_repeated_ids_take_one_rank(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.standard_normal(16)]) for i in range(400)]
    near = [1.5 * x for x in rows[0][1]]
    rows += [(1000, near)] * 60 + [(1001, [x * (1 + i / 1000) for x in near]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best, whole = {}, {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -math.inf), dense.inner_products(np.array([v]), np.array(rows[0][1]))[0])
        whole[i] = max(whole.get(i, -(1 << 60)), int(np.floor(256 * np.array(v)).astype(np.int64) @ np.floor(256 * np.array(rows[0][1])).astype(np.int64)))
    asked = F.col("vec_id") == 0
    for shard in (16_384, 90):
        got = sorted(tuple(x) for x in topk.exact_top_k(vectors, asked, shard_rows=shard, block_rows=16).collect())
        assert got == [(0, n + 1, i, s) for n, (s, i) in enumerate(sorted(((s, i) for i, s in whole.items()), key=lambda p: (-p[0], p[1]))[:5])]
    for shard in (16_384, 90):  # all matches in all trees: nothing is left out
        got = sorted(tuple(x) for x in forest.hash_prefix_forest(vectors, asked, share=64.0, shard_rows=shard).collect())
        assert got == [(0, n + 1, i, s) for n, (s, i) in enumerate(sorted(((s, i) for i, s in best.items()), key=lambda p: (-p[0], p[1]))[:20])]


def test_large_components_are_exact(spark):
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in r.standard_normal(8) * 10.0 ** r.integers(0, 6)]) for i in range(120)] + [(200, [1e6, 2.0] + [0.0] * 6), (201, [2.0, 1e6] + [0.0] * 6), (202, [1e8] + [0.0] * 7), (203, [-3e4] + [0.5] * 7)]
    whole = {i: [int(math.floor(256 * x)) for x in v] for i, v in rows}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = set()
    for q in whole:
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert (200, 256 * 256 * 4_000_000) in {(q, s) for q, _, i, s in expected if i == 201} | {(200, 256 * 256 * 4_000_000)}
    for shard in (16_384, 30):
        assert {tuple(x) for x in topk.exact_top_k(vectors, F.col("vec_id") >= 0, shard_rows=shard, block_rows=7, query_rows=50).collect()} == expected
    two = spark.createDataFrame([(1, [1e15]), (2, [1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_top_k(two, F.col("vec_id") == 1).collect()


def test_blocks_of_far_vectors_are_not_scored(spark):
    r = np.random.default_rng(3)
    centres = np.eye(16) * 4  # groups in directions of their own
    rows = [(i, [float(x) for x in centres[i % 16] + r.standard_normal(16) * 0.05]) for i in range(1600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (16_384, 200):
        got = topk.pruning_report(vectors, F.col("vec_id") % 50 == 0, shard_rows=shard, block_rows=20).first()
        assert got["queries"] == 32 and got["blocks"] >= 80 and got["scored"] < 0.3 * got["queries"] * got["blocks"]


def test_vote_is_that_of_the_exact_neighbours():
    r = np.random.default_rng(5)
    terms = np.abs(r.standard_normal((90, quality.TERMS))).astype(np.float32)
    labels = r.integers(0, 2, 90)
    vote = quality.NeighbourVote(terms, labels, dims=12, neighbours=7)
    asked = np.abs(r.standard_normal((700, quality.TERMS))).astype(np.float32)
    x = vote._latent(asked).astype(np.float64)
    for i, score in enumerate(vote.scores(asked)):
        cosine = vote.known.astype(np.float64) @ x[i]
        near = np.argsort(-cosine, kind="stable")[:7]
        weight = np.maximum(cosine[near], 0) + 1e-6
        assert score == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-4)


def test_fit_is_bounded_by_ids(spark):
    docs = spark.createDataFrame([(1, f"Text {i}.") for i in range(500)] + [(2, "X"), (3, "y z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    vote = quality.fit(docs, labels, sample=16)
    assert len(vote.labels) == 3 and vote.labels.tolist() == [0, 1, 1]  # of two labels 0 counts


def test_words_tell_texts_that_are_written_alike(spark):
    r = np.random.default_rng(2)
    good, bad = VOCABULARY[:200], VOCABULARY[200:]
    text = lambda words: " ".join(words[i] for i in r.integers(0, len(words), 80))
    docs = spark.createDataFrame([(i, text(good if i % 2 else bad)) for i in range(300)], "doc_id long, text string")
    labels = docs.where("doc_id < 240").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = quality.quality_scores(docs, labels, threshold=0.5).where("doc_id >= 240").collect()
    assert sum(x["predicted"] == x["doc_id"] % 2 for x in rows) >= 0.95 * len(rows)
