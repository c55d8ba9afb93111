"""Queries for the smaller parts of operators, and for searches of a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import metrics as M
from ..operators import network as N
from ..operators import references as G
from ..operators import search as Q
from ..operators import stance as P
from ..sources import tables as S
from ..sources.scratch import new_path
from .derived import _RESOLVED, _SAID, number_documents, number_references, one_of, one_of_sql, stance_texts
from .queries import dated, oracle_sql, query


@query("""WITH e AS (SELECT lower(p_name) k, min(p_partkey) m FROM part GROUP BY 1) SELECT l_orderkey, l_linenumber, coalesce(m, l_partkey) AS l_partkey FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN e ON lower(p_name) = k""")
def e12_repoint(spark, d):
    """Lines of parts whose name an older part has point to that one."""
    parts = S.load(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("entity_name"), F.lit(0).alias("created_at"))
    return E.repoint(S.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), E.merge_duplicates(parts)[1], "l_partkey")


@query(f"SELECT ref_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY ref_id) AS n FROM ({_RESOLVED})) WHERE n <= 20")
def g02_resolution_samples(spark, d):
    return G.resolution_samples(G.resolve_references(number_references(spark, d), number_documents(spark, d))).select("ref_id", "outcome")


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
  SELECT CASE WHEN n <= 3 THEN CAST(n AS VARCHAR) WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS clusters FROM c GROUP BY 1""")
def g10_size_histogram(spark, d):
    """Orders as members of their customer's cluster."""
    return G.size_histogram(S.load(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("component")))


@query(f"""WITH k AS ({oracle_sql()["m02_pick_by_priority"]}) SELECT c_custkey AS case_id, coalesce(k.value, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'Okänt departement') AS grouping
  FROM customer LEFT JOIN k ON k.case_id = c_custkey""")
def m02_with_group(spark, d):
    """Customers as cases: the picked value, else their segment, which every third lacks."""
    orders = S.load(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("doc_id"))
    cases = S.load(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("ministry"))
    return M.with_group(cases.select("case_id"), M.pick_by_priority(orders, {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}), cases)


_ROLES = ["Särskild utredare", "ledamot", "Statsråd", "expert", None]
_POINTS = ["3", "2", "2", "0", "0"]
_ROLE_SQL = one_of_sql("l_suppkey", ["NULL" if r is None else f"'{r}'" for r in _ROLES])


def role_links(spark, d) -> DataFrame:
    """Suppliers as people of the parts that they deliver, each in one role."""
    n = F.col("l_suppkey")
    return S.load(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), n.alias("name"), one_of(n, [F.lit(r).cast("string") for r in _ROLES]).alias("role"), F.col("l_orderkey").alias("page"))


@query(f"""WITH k AS (SELECT l_partkey AS doc_id, l_suppkey AS name, CAST({one_of_sql("l_suppkey", _POINTS)} AS BIGINT) AS p FROM lineitem), per AS (SELECT name, doc_id, count(*) n, sum(p) p FROM k GROUP BY 1, 2),
  q AS (SELECT a.doc_id source_id, b.doc_id, sum(b.n) shared, sum(b.p) points FROM per a JOIN per b ON a.name = b.name AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0 GROUP BY 1, 2),
  s AS (SELECT source_id, q.doc_id, CAST(shared AS BIGINT) shared, CAST(points + CASE WHEN x.p_brand = y.p_brand THEN 1 ELSE 0 END AS BIGINT) score FROM q JOIN part x ON x.p_partkey = source_id JOIN part y ON y.p_partkey = q.doc_id)
  SELECT source_id, doc_id, shared, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def m16_related_by_role(spark, d):
    """As m16_related_documents, with people in several roles."""
    docs = S.load(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("ministry"))
    return N.related_documents(role_links(spark, d), docs, F.col("doc_id") % 100 == 0).select("source_id", "doc_id", "shared", "score", "rank")


@query(f"""SELECT l_partkey AS doc_id, l_suppkey AS name, {_ROLE_SQL} AS role, l_orderkey AS page, CASE WHEN l_suppkey % 5 IN (0, 2) THEN 'lead' ELSE 'committee' END AS reason, CAST({one_of_sql("l_suppkey", _POINTS)} AS INTEGER) AS points
  FROM lineitem WHERE l_partkey <> 100 AND l_suppkey % 5 < 3 AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 100) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def m16_related_reasons(spark, d):
    """Why larger parts are related to part 100."""
    other = S.load(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("doc_id"))
    return N.related_reasons(role_links(spark, d), 100, other).select("doc_id", "name", "role", "page", "reason", "points")


@query("SELECT o_orderkey AS doc_id, l_linenumber AS line, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS publication_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey = 7")
def m23_actor_documents(spark, d):
    """Orders as a supplier's documents."""
    links = S.load(spark, d, "lineitem").select(F.col("l_suppkey").alias("actor_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"))
    docs = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("publication_date"))
    return dated(N.actor_documents(links, docs, 7).select("doc_id", "line", "publication_date"), "publication_date")


@query("SELECT doc_id, 'D' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS doc_number FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_number, doc_id LIMIT 15")
def m25_without_consultation(spark, d):
    docs = S.load(spark, d, "documents").select("doc_id", F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("doc_number"))
    return M.without_consultation(docs, S.load(spark, d, "labels").select(F.col("doc_id").alias("parent_id")))


@query("SELECT CASE WHEN n_chars % 4 = 0 THEN 'unknown' ELSE coalesce(lang, 'unknown') END AS method, count(*) AS n FROM documents GROUP BY 1")
def m25_by_method(spark, d):
    """Documents as consultations, whose language is how they were found; every fourth size has no such field."""
    method = F.when(F.col("n_chars") % 4 != 0, F.col("lang"))
    return M.by_method(S.load(spark, d, "documents").select(F.to_json(F.struct(method.alias("discovery_method"), "source")).alias("metadata")))


@query("SELECT doc_id, lang AS doc_type FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 1000")
def m27_document_list(spark, d):
    docs = S.load(spark, d, "documents").select("doc_id", F.col("lang").alias("doc_type"), "n_chars")
    return M.document_list(docs, ["en", "de"], F.col("n_chars") >= 1000).select("doc_id", "doc_type")


@query(f"SELECT CASE WHEN short THEN 'skipped' ELSE 'ok' END AS analysis_status, stance, count(*) AS n FROM ({_SAID}) WHERE id % 17 <> 0 GROUP BY 1, 2")
def p04_batch_summary(spark, d):
    return P.batch_summary(P.analyze_batch(stance_texts(spark, d)))


_TERMS = "list_sort(list_intersect(string_split({a}.p_name, ' '), string_split({b}.p_name, ' ')))"


@query(f"""WITH n AS (SELECT p_partkey, lead(p_partkey) OVER (ORDER BY p_partkey) AS other FROM part) SELECT n.p_partkey AS query_id, other AS doc_id, array_to_string({_TERMS.format(a="a", b="b")}, ' ') AS keywords, a.p_brand = b.p_brand AS same_domain
  FROM n JOIN part a ON a.p_partkey = n.p_partkey JOIN part b ON b.p_partkey = other""")
def q05_shared_terms(spark, d):
    """What each part's name and brand have in common with the next one's."""
    part = S.load(spark, d, "part")
    summaries = part.select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ").alias("keywords"), F.array("p_brand").alias("policy_domains"))
    # the next number: parts are joined by their keys' order
    following = part.select(F.col("p_partkey").alias("query_id")).withColumn("doc_id", F.lead("query_id").over(Window.orderBy("query_id")))
    out = Q.shared_terms(following.where("doc_id is not null"), summaries)
    return out.select("query_id", "doc_id", F.array_join(F.sort_array("shared_keywords"), " ").alias("keywords"), (F.size("shared_policy_domains") > 0).alias("same_domain"))


# --- a stored index of documents: a source weighs as a title, a language as a number ---
_TOKENS = """SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(source, '')), '[^\\p{L}\\p{N}]+')) AS token, 1.0 AS w FROM documents UNION ALL SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(lang, '')), '[^\\p{L}\\p{N}]+')), 0.4 FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')), 0.2 FROM documents"""


def indexed(spark, d) -> str:
    path = new_path(spark, "index")
    Q.store_index(S.load(spark, d, "documents"), path, {"source": 1.0, "lang": 0.4, "text": 0.2}, parts=16)
    return path


@query(f"SELECT doc_id, CAST(sum(w) AS DOUBLE) AS score, count(DISTINCT token) AS terms FROM ({_TOKENS}) WHERE token IN ('thing', 'en', 'src3') GROUP BY 1 ORDER BY terms DESC, score DESC, doc_id LIMIT 20")
def q03_stored_search(spark, d):
    """Weighted fields of a stored index, of which the asked words' parts are read."""
    return Q.search_index(spark, indexed(spark, d), ["Thing", "en", "src3"])


@query(f"""WITH t AS (SELECT doc_id, token, CAST(sum(w) AS DOUBLE) AS w FROM ({_TOKENS}) WHERE token IN ('thing', 'hand', 'and') GROUP BY 1, 2), f AS (SELECT token, count(*) AS n FROM t GROUP BY 1)
  SELECT doc_id, sum(w * ln(1 + (SELECT count(*) FROM documents) / n)) AS score, count(*) AS terms FROM t JOIN f USING (token) GROUP BY 1 ORDER BY terms DESC, score DESC, doc_id LIMIT 20""")
def q03_rare_words(spark, d):
    return Q.search_index(spark, indexed(spark, d), ["thing", "hand", "and"], rare=True)


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND t[i + 1] = 'the')) AS times FROM t WHERE times > 0 ORDER BY times DESC, doc_id LIMIT 20""")
def q03_phrase(spark, d):
    """The word "the" twice in a row."""
    return Q.search_phrase(spark, indexed(spark, d), ["the", "The"])


def likened(spark, d) -> DataFrame:
    """Each vector mixed with the one of the next lower number that seven divides: those of one seven are alike."""
    v = S.load(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"), "embedding")
    base = v.select(F.col("doc_id").alias("_base"), F.col("embedding").alias("_e"))
    both = v.join(base, (F.floor(F.col("doc_id") / 7) * 7) == F.col("_base"))
    return both.select("doc_id", F.zip_with("embedding", "_e", lambda x, y: x * F.lit(0.4) + y).alias("embedding"))


def similar_corpus(spark, d) -> DataFrame:
    return Q.corpus_pairs(likened(spark, d), threshold=0.75, recall=0.99)


@query()
def q05_corpus_pairs(spark, d):
    """All pairs of documents that are alike, found by sign hashes; tests hold it against all pairs."""
    return similar_corpus(spark, d)


@query()
def q06_corpus_links(spark, d):
    """The same pairs with their scores by what their documents share."""
    docs = S.load(spark, d, "documents")
    first = lambda n: F.slice(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda t: t != ""), 1, n)
    summaries = docs.select("doc_id", F.array_compact(F.array("source")).alias("leads"), first(30).alias("keywords"), F.array_compact(F.array("lang")).alias("domains"), F.array().cast("array<string>").alias("bodies"), (F.col("n_chars") % 20).cast("int").alias("year"))
    return Q.corpus_links(similar_corpus(spark, d), summaries)


@query("""SELECT d.doc_id, CASE WHEN e.embedding IS NOT NULL AND d.doc_id % 3 <> 0 THEN floor(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))) * 10000 + 0.5) END AS total FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def q07_stored_vectors(spark, d):
    """Documents with the vectors of the right size; every third vector lacks a component."""
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    vectors = S.load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), cut.alias("embedding"))
    stored = Q.store_embeddings(S.load(spark, d, "documents").select("doc_id"), vectors, 64)[0]
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return stored.select("doc_id", F.floor(total * 10000 + 0.5).cast("double").alias("total"))
