"""The queries op1 to op13 and their SQL: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import centroid_clusters
from .extract import extract_text
from .forest import hash_prefix_forest
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import best_fit_packing
from .quality import quality_scores
from .simple8b import token_files
from .spelling import spelling_variants
from .suffix import repeat_report
from .topk import exact_top_k
from .toxicity import toxicity_scores
from .warc import archive


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.w, d.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


#: The files' own columns (urlkey, ts, run, offset, place) are left out on both sides by the query.
OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
l AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM d LEFT JOIN l USING (payload_digest)
"""


def _op11_sql(rounds: int = 10) -> str:
    """A step for each round: assignments by the least (distance, number), then floors of the means."""
    squared = "list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.rid, CAST(arg_min(c.c, {squared} * 8 + c.c) AS INTEGER) AS c FROM v, c{r} c GROUP BY v.rid)")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS w FROM (
    SELECT a.c, i, CAST(sum(v.w[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r} a JOIN v USING (rid), range(1, 65) t(i) GROUP BY 1, 2
  ) GROUP BY c UNION ALL SELECT c, CAST(w AS HUGEINT[]) FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), w) - 1 AS c, CAST(w AS HUGEINT[]) AS w FROM v ORDER BY 1 LIMIT 8
), {", ".join(steps)}, d AS (
  SELECT v.vec_id, c.c, {squared} AS distance, c.w FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON a.c = c.c
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM d
"""


#: The crc32 of the letters is summed byte by byte with a table of 256 numbers, which the first step makes by its rule.
#: Words with one letter left out meet at the place of that letter; a word that has one letter less has the rest whole.
OP13_SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN i WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2
), named AS (
  SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS name FROM runs WHERE length(run) >= 5
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(1, length(name), 2), lambda j: CAST((strpos('0123456789ABCDEF', name[j]) - 1) * 16 + strpos('0123456789ABCDEF', name[j + 1]) - 1 AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) % 256 AS BIGINT) + 1]), 4294967295), 4294967295) AS h
  FROM named, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
), cuts AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word
), ranked AS (
  SELECT p.word, p.near, w.n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place FROM pairs p JOIN words w ON p.near = w.word
), forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), paths AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL
), roots AS (SELECT p.word, p.root FROM paths p JOIN forms f ON f.word = p.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r USING (word)
"""


def tokenizer() -> str:
    """The public tokenizer file; the same path holds on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every fiftieth vector among all others."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector among all others."""
    return hash_prefix_forest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_min_max_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set, its component and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what repeated passages of 100 bytes take from it."""
    return repeat_report(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives says; the files' own columns are left out."""
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return extract_text(table(spark, sf_dir, "pages"))


def op8_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer())


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the token files give it back."""
    return token_files(table(spark, sf_dir, "documents"), tokenizer())


def op11_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 components with its cluster after ten rounds."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score and the window that it comes from."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the more common spelling that it varies."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_block_top_k, op2_hash_prefix_forest, op3_min_max_dedup, op4_previous_factors, op5_mix_sources, op6_warc_archive, op7_page_difference, op8_neighbour_vote, op9_best_fit_packing, op10_token_files, op11_shallot_clusters, op12_recurrent_toxicity, op13_permuterm_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op1_block_top_k": OP1_SQL, "op6_warc_archive": OP6_SQL, "op11_shallot_clusters": _op11_sql(), "op13_permuterm_variants": OP13_SQL}
