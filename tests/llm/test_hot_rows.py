"""Rows that share an id: several texts of one doc_id, several payloads of one page_id, null ids, and equal rows."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from casegraph.llm import minhash, mixing, packing, suffix, warc


def pattern(n, flip):
    return "".join("ab"[(bin(i).count("1") & 1) ^ flip] for i in range(n))


def test_mirrored_words_are_not_linked(spark):
    docs = spark.createDataFrame([(1, pattern(4096, 0)), (2, pattern(4096, 1)), (3, pattern(4096, 1))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 2}


def test_texts_of_one_doc_id_are_told_apart(spark):
    first, other = "a b c d e f g h", "x y z"
    rows = [(1, first), (2, first), (2, other), (3, other), (3, other), (None, other), (4, ""), (4, None), (2, "lone words of two")]
    docs = spark.createDataFrame([(d, t, i, "p") for i, (d, t) in enumerate(rows)], "doc_id long, text string, n long, print string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(1, 4, 1, True), (2, 4, 1, False), (2, 1, 2, True), (3, 1, 2, False), (3, 1, 2, False), (None, 1, None, True), (4, 0, 4, True), (4, 0, 4, True), (2, 1, 2, True)])
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted((r for r in docs.collect() if r["n"] in (0, 2, 5, 6, 7, 8)), key=str)


def test_equal_rows_leave_one(spark):
    docs = spark.createDataFrame([(7, "one two three four five six", "s")] * 40 + [(8, "one two three four five six", "s")], "doc_id long, text string, source string")
    assert [tuple(r) for r in minhash.one_of_each(docs).collect()] == [(7, "one two three four five six", "s")]


def archived(rows, least=1000):
    """(page_id, bytes, digest, type, refers_to) of each row."""
    raw = [(i, (h or "").encode()) for i, h in rows]
    last = {}
    for i, b in raw:
        if len(b) >= least and i is not None:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, b in raw:
        again = i is not None and len(b) >= least and i < last[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    return Counter(out)


def test_pages_of_one_id_keep_their_payloads(spark):
    a, b, c = ("A" * 1200, "B" * 1200, "C" * 1200)
    r = np.random.default_rng(1)
    some = [(5, a), (5, b), (5, c), (9, a), (10, b)]
    many = [(None if x == 0 else int(x), [a, b, c, "short", None, "é" * 500][int(k)]) for x, k in zip(r.integers(0, 6, 300), r.integers(0, 6, 300), strict=True)]
    for rows in (some, many):
        pages = spark.createDataFrame([(i, None if k % 9 == 0 else f"http://h.se/{k % 4}", h, "x") for k, (i, h) in enumerate(rows)], "page_id long, url string, html string, digest string")
        out = warc.archive(pages).collect()
        assert Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in out) == archived(rows)
        path = warc.new_path(spark, "warc")
        warc.write_warc(pages, path, file_bytes=20_000)
        runs = warc.read_runs(spark, path)
        blocks = {x["payload_digest"] for x in runs.where("record_type = 'response'").collect()}
        assert blocks == {hashlib.sha1((h or "").encode()).hexdigest() for _, h in rows}


def test_null_ids_do_not_share_a_file(spark):
    pages = spark.createDataFrame([(None, "http://h.se/", "x" * 2000)] * 400, "page_id long, url string, html string")
    path = warc.new_path(spark, "warc")
    warc.write_warc(pages, path, file_bytes=100_000)
    sizes = [r["n"] for r in warc.read_runs(spark, path).groupBy("run").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400 and max(sizes) <= 50
    index = warc.merged_index(warc.read_runs(spark, path), part_rows=50)
    assert index.count() == 400 and index.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 100


def test_pieces_of_one_id_are_dealt_over_shards(spark):
    rows = [(None, 0, 0, 7, 1)] * 3000 + [(1, k, 0, 9, 1) for k in range(1000)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    out = packing.pack(pieces, length=64, shard_rows=100)
    per = [r["n"] for r in out.groupBy((F.col("sequence_id") / F.lit(1 << 32)).cast("long")).agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 4000 and max(per) <= 200
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 64 for r in used)


def test_texts_of_one_id_are_dealt_out(spark):
    words = [f"w{i}x" for i in range(50)]
    r = np.random.default_rng(6)
    line = " ".join(words[:40])
    rows = [(None, f"{i} " + " ".join(words[k] for k in r.integers(0, 50, 60)) + (f" {line}" if i % 3 == 0 else "")) for i in range(300)]
    rows += [(9, f"{line} end")] * 100 + [(i, f"{i}{line}") for i in range(20)]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    texts = docs.select(F.struct("doc_id", "source").alias("row"), F.coalesce("doc_id", F.lit(-1)).alias("doc"), "text")
    dealt = suffix.numbered(texts, 8)
    assert dealt.select("doc").distinct().count() == len(rows)
    per = [x["count"] for x in dealt.groupBy(F.pmod(F.xxhash64("doc"), F.lit(8))).count().collect()]
    assert len(per) == 8 and max(per) < 2 * len(rows) / 8
    places = {x["doc"] >> 33 for x in dealt.where("row.doc_id = 9").select("doc").collect()}
    assert len(places) > 1  # equal rows come from several tasks
    seen, expected = set(), Counter()
    for d, t in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], x[1][:100])):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(t[i : i + 100])
        expected[d, len(t), int(gone.sum())] += 1
    assert Counter((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in suffix.repeat_report(docs).collect()) == expected
    assert texts.where("doc = 3").count() == 1 and suffix.numbered(texts.where("doc = 3"), 8).collect() == texts.where("doc = 3").collect()


def test_equal_rows_are_counted_before_the_mix_orders_them(spark):
    """A third of all rows are equal, with a null id: one row in a bucket's window; the mix holds what it counts."""
    rows = [(None, "one two three four five six seven", "b")] * 2500 + [(i, f"w{i} x y z", "abc"[i % 3]) for i in range(5000)] + [(7, None, None), (7, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = mixing._groups(docs, (5, 2, 1), 1.5, 2.0, 17, 500)
    assert groups.where("doc_id is null").select("n", "size").collect() == [(2500, 7)] and groups.agg(F.sum("n")).first()[0] == len(rows)
    for weights, share in (((5, 2, 1), 1.5), ((1, 1, 1), 0.4), ((1, 5, 1), 0.9)):
        out = mixing.mix_sources(docs, weights=weights, share=share, bucket_rows=500)
        got = Counter((r["doc_id"], r["source"], r["size"]) for r in out.collect())
        assert got == Counter((d, s, len((t or "").split())) for d, t, s in rows)
        per = {r["source"]: r for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count_if((F.col("rest") > 0) & (F.col("rest") < F.col("size"))).alias("cut")).collect()}
        assert all(r["taken"] == int(r["target"]) and r["cut"] <= 1 for r in per.values())
        mixed = mixing.mixed_documents(docs, weights=weights, share=share, bucket_rows=500)
        expected = out.groupBy("doc_id", "source").agg(F.sum("taken").alias("words")).where("words > 0")
        words = mixed.groupBy("doc_id", "source").agg(F.sum(mixing.n_words("text")).alias("words"))
        assert Counter(map(tuple, words.collect())) == Counter(map(tuple, expected.collect()))
