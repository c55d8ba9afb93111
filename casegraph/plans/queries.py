"""The operators over the star-schema tables: one query for each, with the SQL that gives the same rows.

An actor is a supplier, a case an order: a supplier has answered an order where its line is final (status F) and was
invited where the line's return flag is N or A; the flag is the stance. Other bindings stand with their queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..operators import entities as E
from ..operators import metrics as M
from ..operators import network as N
from ..operators import pages as H
from ..operators import references as G
from ..operators import search as Q
from ..operators import stance as P
from ..sources import tables as S
from ..sources.scratch import new_path
from ..sources.stored import create_table, read_table, upsert_table
from ..streaming import streams as R

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def dated(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as text, which both sides of a comparison write alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def responses(spark, d):
    return S.load(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("actor_id"), F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("stance"))


def invites(spark, d):
    return S.load(spark, d, "lineitem").where("l_returnflag in ('N', 'A')").select(F.col("l_suppkey").alias("actor_id"), F.col("l_orderkey").alias("case_id"))


def actors(spark, d):
    return S.load(spark, d, "supplier").select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("actor_type"))


def cases(spark, d):
    return S.load(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("case_date"))


_R = "r AS (SELECT l_suppkey AS actor_id, l_orderkey AS case_id, l_returnflag AS stance FROM lineitem WHERE l_linestatus = 'F')"
_I = "i AS (SELECT l_suppkey AS actor_id, l_orderkey AS case_id FROM lineitem WHERE l_returnflag IN ('N', 'A'))"
_PART = f"""{_R}, {_I}, rc AS (SELECT actor_id, count(*) n FROM r GROUP BY 1), ic AS (SELECT actor_id, count(*) n FROM i GROUP BY 1),
u AS (SELECT actor_id, count(*) n FROM (SELECT DISTINCT actor_id, case_id FROM r EXCEPT SELECT actor_id, case_id FROM i) GROUP BY 1),
p AS (SELECT coalesce(rc.actor_id, ic.actor_id) AS actor_id, coalesce(rc.n, 0) AS response_count, coalesce(ic.n, 0) AS invite_count,
  CASE WHEN coalesce(ic.n, 0) > 0 THEN CAST(floor(coalesce(rc.n, 0) / ic.n * 100 + 0.5) AS BIGINT) END AS response_rate
  FROM rc FULL JOIN ic ON rc.actor_id = ic.actor_id)"""


# --- durations ---
def order_spans(spark, d):
    placed = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit("placed").alias("event_type"), F.to_date("o_orderdate").alias("event_date"))
    shipped = S.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.lit("shipped").alias("event_type"), F.to_date("l_shipdate").alias("event_date"))
    return M.velocity(placed.unionByName(shipped), "placed", "shipped")


def grouped_spans(spark, d):
    orders = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("c_custkey"))
    named = orders.join(S.load(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "left")
    return order_spans(spark, d).join(named, "case_id", "left").withColumn("grouping", F.coalesce("c_mktsegment", F.lit(M.NO_MINISTRY)))


_SPANS = """v AS (SELECT o_orderkey AS case_id, min(CAST(o_orderdate AS DATE)) AS start_date, min(CAST(l_shipdate AS DATE)) AS end_date, min(o_custkey) AS c
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), s AS (SELECT *, date_diff('day', start_date, end_date) AS days FROM v WHERE end_date > start_date)"""


@query("""SELECT user_id AS case_id, CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS end_date, CAST(date_diff('day', a, b) AS INTEGER) AS days FROM (
  SELECT user_id, min(CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) END) a, min(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) b FROM events GROUP BY 1) WHERE b > a""")
def m01_velocity(spark, d):
    rows = S.load(spark, d, "events").select(F.col("user_id").alias("case_id"), "event_type", F.to_date("ts").alias("event_date"))
    return dated(M.velocity(rows, "signup", "purchase"), "start_date", "end_date")


@query(f"WITH {_SPANS} SELECT case_id, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, CAST(days AS INTEGER) AS days FROM s")
def m01_velocity_orders(spark, d):
    return dated(order_spans(spark, d), "start_date", "end_date")


@query("""SELECT o_custkey AS case_id, arg_min(o_orderstatus, (CAST(substr(o_orderpriority, 1, 1) AS INTEGER), o_orderkey)) AS value FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND trim(o_orderstatus) <> '' GROUP BY 1""")
def m02_pick_by_priority(spark, d):
    c = S.load(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("doc_id"))
    return M.pick_by_priority(c, {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3})


@query(f"""WITH {_SPANS} SELECT coalesce(c_mktsegment, 'Okänt departement') AS grouping, count(*) AS process_count, CAST(floor(avg(days) + 0.5) AS BIGINT) AS avg_days,
  CAST(min(days) AS INTEGER) AS min_days, CAST(max(days) AS INTEGER) AS max_days, CAST(floor(median(days) + 0.5) AS BIGINT) AS median_days
  FROM s LEFT JOIN customer ON c = c_custkey GROUP BY 1""")
def m03_velocity_by_group(spark, d):
    return M.velocity_by_group(grouped_spans(spark, d))


@query(f"WITH {_SPANS} SELECT count(*) AS total_processes, CAST(floor(avg(days) + 0.5) AS BIGINT) AS overall_avg_days, CAST(min(days) AS INTEGER) AS overall_min_days, CAST(max(days) AS INTEGER) AS overall_max_days FROM s")
def m04_velocity_summary(spark, d):
    return M.velocity_summary(order_spans(spark, d))


# --- participation and influence ---
@query(f"""WITH {_PART} SELECT p.actor_id, coalesce(s_name, 'Unknown') AS name, CAST(response_count AS BIGINT) AS response_count, CAST(invite_count AS BIGINT) AS invite_count, response_rate, coalesce(u.n, 0) AS uninvited_responses
  FROM p LEFT JOIN supplier ON s_suppkey = p.actor_id LEFT JOIN u ON u.actor_id = p.actor_id""")
def m05_participation(spark, d):
    return M.participation(responses(spark, d), invites(spark, d), actors(spark, d))


@query(f"""WITH {_PART} SELECT CAST(sum(response_count) AS BIGINT) AS total_responses, CAST(sum(invite_count) AS BIGINT) AS total_invites, count(*) AS total_entities,
  CAST(floor(sum(response_count) / sum(invite_count) * 100 + 0.5) AS BIGINT) AS overall_response_rate FROM p""")
def m06_participation_summary(spark, d):
    return M.participation_summary(M.participation(responses(spark, d), invites(spark, d)))


_INF = f"""{_R}, {_I}, a AS (SELECT actor_id, count(*) subs, count(DISTINCT case_id) cases FROM r GROUP BY 1), b AS (SELECT actor_id, count(*) invs FROM i GROUP BY 1),
st AS (SELECT actor_id, max(n) top, sum(n) tot FROM (SELECT actor_id, stance, count(*) n FROM r WHERE stance IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT coalesce(a.actor_id, b.actor_id) actor_id, coalesce(subs, 0) subs, coalesce(cases, 0) cases, coalesce(invs, 0) invs, coalesce(top / tot * 100, 0) con
  FROM a FULL JOIN b ON a.actor_id = b.actor_id LEFT JOIN st ON st.actor_id = coalesce(a.actor_id, b.actor_id)),
mx AS (SELECT greatest(1, max(subs)) ms, greatest(1, max(cases)) mc, greatest(1, max(invs)) mi FROM x),
l AS (SELECT actor_id, unnest([{{'t': 'remissvar_frequency', 's': floor(subs / ms * 100 * 100 + 0.5) / 100, 'sub': subs, 'c': NULL}}, {{'t': 'invitation_rate', 's': floor(invs / mi * 100 * 100 + 0.5) / 100, 'sub': NULL, 'c': NULL}},
  {{'t': 'stance_consistency', 's': floor(con * 100 + 0.5) / 100, 'sub': subs, 'c': NULL}}, {{'t': 'cross_case_breadth', 's': floor(cases / mc * 100 * 100 + 0.5) / 100, 'sub': NULL, 'c': cases}}]) AS u FROM x, mx),
lo AS (SELECT actor_id, u.t AS influence_type, u.s AS influence_score, CAST(u.sub AS BIGINT) AS total_submissions, CAST(u.c AS BIGINT) AS case_count FROM l),
w AS (SELECT actor_id, max(CASE WHEN influence_type = 'remissvar_frequency' THEN influence_score END) AS remissvar_frequency, max(CASE WHEN influence_type = 'invitation_rate' THEN influence_score END) AS invitation_rate,
  max(CASE WHEN influence_type = 'stance_consistency' THEN influence_score END) AS stance_consistency, max(CASE WHEN influence_type = 'cross_case_breadth' THEN influence_score END) AS cross_case_breadth,
  max(CASE WHEN influence_type = 'remissvar_frequency' THEN total_submissions END) AS total_submissions, max(case_count) AS case_count FROM lo GROUP BY 1),
c AS (SELECT *, floor((remissvar_frequency * 0.35 + invitation_rate * 0.25 + stance_consistency * 0.15 + cross_case_breadth * 0.25) * 100 + 0.5) / 100 AS composite_score FROM w)"""


def influence(spark, d):
    return M.influence(responses(spark, d), invites(spark, d), F.lit("2026-01-01").cast("date"))


@query(f"WITH {_INF} SELECT * FROM lo")
def m07_influence(spark, d):
    return influence(spark, d).drop("evidence", "calculation_date")


@query(f"WITH {_INF} SELECT c.*, coalesce(s_name, 'Okänd') AS name FROM c LEFT JOIN supplier ON s_suppkey = actor_id")
def m08_influence_composite(spark, d):
    return M.influence_composite(influence(spark, d), actors(spark, d))


@query(f"WITH {_INF} SELECT lo.*, s_name AS name FROM lo JOIN supplier ON s_suppkey = actor_id ORDER BY influence_score DESC, influence_type, actor_id LIMIT 200")
def m09_top_influencers(spark, d):
    return M.top_influencers(influence(spark, d), actors(spark, d)).drop("evidence", "calculation_date", "actor_type")


@query(f"""WITH {_INF} SELECT count(*) AS actors, floor(avg(composite_score) * 100 + 0.5) / 100 AS avg_composite, CAST(sum(total_submissions) AS BIGINT) AS total_submissions, max(case_count) AS max_cases
  FROM c JOIN supplier ON s_suppkey = actor_id WHERE contains(lower(s_name), '1')""")
def m10_influence_overview(spark, d):
    return M.influence_overview(M.influence_composite(influence(spark, d), actors(spark, d)), "1")


# --- pairs and networks ---
_PAIRS = f"""{_R}, {_I}, pr AS (SELECT case_id, actor_id, bool_or(iv) iv, bool_or(rs) rs FROM (SELECT case_id, actor_id, true iv, false rs FROM i UNION ALL SELECT case_id, actor_id, false, true FROM r) GROUP BY 1, 2),
n AS (SELECT actor_id, count(*) n FROM pr GROUP BY 1),
j AS (SELECT a.actor_id actor_a, b.actor_id actor_b, a.case_id, a.iv AND b.iv iv, a.rs AND b.rs rs, CAST(o_orderdate AS DATE) dt FROM pr a JOIN pr b ON a.case_id = b.case_id AND a.actor_id < b.actor_id
  LEFT JOIN orders ON o_orderkey = a.case_id WHERE (a.iv AND b.iv) OR (a.rs AND b.rs)),
g AS (SELECT actor_a, actor_b, count(*) FILTER (iv) AS invite_count, count(*) FILTER (rs) AS response_count, count(*) AS shared_count, list_slice(list(case_id ORDER BY dt DESC NULLS LAST, case_id), 1, 100) AS shared_cases, min(dt) AS first_date, max(dt) AS last_date FROM j GROUP BY 1, 2),
e AS (SELECT g.*, floor(shared_count / (na.n + nb.n - shared_count) * 10000 + 0.5) / 10000 AS jaccard, floor(shared_count / (na.n + nb.n - shared_count) * 100 + 0.5) / 100 AS strength
  FROM g JOIN n na ON na.actor_id = actor_a JOIN n nb ON nb.actor_id = actor_b)"""


def pairs(spark, d):
    return N.cooccurrence(invites(spark, d), responses(spark, d), cases(spark, d))


@query(f"WITH {_PAIRS} SELECT actor_a, actor_b, invite_count, response_count, shared_count, array_to_string(shared_cases, ',') AS shared_cases, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, jaccard, strength FROM e")
def m11_cooccurrence(spark, d):
    return dated(pairs(spark, d), "first_date", "last_date").withColumn("shared_cases", F.array_join("shared_cases", ","))


@query(f"WITH {_PAIRS} SELECT count(*) AS total_pairs, floor(avg(jaccard) * 10000 + 0.5) / 10000 AS avg_jaccard, arg_max(shared_count, (strength, -actor_a, -actor_b)) AS max_count FROM e")
def m12_cooccurrence_stats(spark, d):
    return N.cooccurrence_stats(pairs(spark, d))[0]


_NET = f"""{_PAIRS}, t AS (SELECT * FROM e WHERE strength >= 0.01 ORDER BY strength DESC, actor_a, actor_b LIMIT 150),
dg AS (SELECT actor_id, count(*) n FROM (SELECT actor_a actor_id FROM t UNION ALL SELECT actor_b FROM t) GROUP BY 1),
nd AS (SELECT actor_id FROM dg ORDER BY n DESC, actor_id LIMIT 50), fe AS (SELECT * FROM t WHERE actor_a IN (SELECT actor_id FROM nd) AND actor_b IN (SELECT actor_id FROM nd)),
fd AS (SELECT actor_id, count(*) n FROM (SELECT actor_a actor_id FROM fe UNION ALL SELECT actor_b FROM fe) GROUP BY 1)"""


@query(f"WITH {_NET} SELECT nd.actor_id, s_name AS name, s_nationkey AS actor_type, coalesce(fd.n, 0) AS degree FROM nd JOIN supplier ON s_suppkey = nd.actor_id LEFT JOIN fd ON fd.actor_id = nd.actor_id")
def m13_network(spark, d):
    return N.network(pairs(spark, d), actors(spark, d), 0.01, 50)[0].select("actor_id", "name", "actor_type", "degree")


@query(f"WITH {_PAIRS} SELECT s_nationkey AS actor_type, count(*) AS n FROM supplier WHERE s_suppkey IN (SELECT actor_a FROM e UNION SELECT actor_b FROM e) GROUP BY 1")
def m14_type_counts(spark, d):
    return N.type_counts(pairs(spark, d), actors(spark, d))


@query(f"""WITH {_PAIRS}, o AS (SELECT CASE WHEN actor_a = 7 THEN actor_b ELSE actor_a END AS actor_id, strength, shared_count FROM e WHERE actor_a = 7 OR actor_b = 7 ORDER BY strength DESC, 1 LIMIT 10)
  SELECT o.*, s_name AS name, s_nationkey AS actor_type FROM o JOIN supplier ON s_suppkey = actor_id""")
def m15_neighbors(spark, d):
    return N.actor_neighbors(invites(spark, d), responses(spark, d), actors(spark, d), 7)


# --- documents are parts, their actors the suppliers that deliver them; role is the part's type, ministry its brand ---
def part_links(spark, d):
    lines = S.load(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("actor_id"))
    return lines


_LINKS = "k AS (SELECT l_partkey AS doc_id, l_suppkey AS actor_id FROM lineitem)"


@query(f"""WITH {_LINKS}, per AS (SELECT actor_id, doc_id, count(*) n FROM k GROUP BY 1, 2),
  q AS (SELECT a.doc_id source_id, b.doc_id, sum(b.n) shared, sum(b.n * 2) points FROM per a JOIN per b ON a.actor_id = b.actor_id AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0 GROUP BY 1, 2),
  s AS (SELECT source_id, q.doc_id, CAST(shared AS BIGINT) shared, CAST(points + CASE WHEN x.p_brand = y.p_brand THEN 1 ELSE 0 END AS BIGINT) score, coalesce(x.p_brand = y.p_brand, false) same_ministry
    FROM q JOIN part x ON x.p_partkey = source_id JOIN part y ON y.p_partkey = q.doc_id)
  SELECT source_id, doc_id, shared, score, same_ministry, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def m16_related_documents(spark, d):
    """Searches for the documents whose id is divisible by 100, as the reference asks for one document at a time."""
    links = part_links(spark, d).select("doc_id", F.col("actor_id").alias("name"), F.lit("ledamot").alias("role"))
    docs = S.load(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("ministry"))
    return N.related_documents(links, docs, F.col("doc_id") % 100 == 0)


@query("SELECT s_name AS name, s_nationkey AS actor_type, count(DISTINCT l_partkey) AS documents FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') GROUP BY 1, 2")
def m18_process_actors(spark, d):
    links = part_links(spark, d).join(actors(spark, d), "actor_id").withColumn("role", F.lit("supplier"))
    parts = S.load(spark, d, "part").select(F.col("p_brand").alias("process_id"), F.col("p_partkey").alias("doc_id"))
    return N.process_actors("Brand#11", parts, links).drop("roles")


@query(f"WITH {_LINKS} SELECT actor_id, count(*) AS connections FROM k WHERE actor_id <> 7 AND doc_id IN (SELECT doc_id FROM k WHERE actor_id = 7) GROUP BY 1 ORDER BY connections DESC, actor_id LIMIT 10")
def m20_related_actors(spark, d):
    return N.related_actors(part_links(spark, d), 7)


@query("""SELECT o_orderkey AS process_id, o_orderstatus AS event_type, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 7))
  ORDER BY event_date DESC, process_id, event_type LIMIT 20""")
def m21_actor_timeline(spark, d):
    events = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("process_id"), F.col("o_orderstatus").alias("event_type"), F.to_date("o_orderdate").alias("event_date"))
    bridge = S.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("process_id"), F.col("l_partkey").alias("doc_id"))
    return dated(N.actor_timeline(part_links(spark, d), bridge, events, 7), "event_date")


@query("""WITH r AS (SELECT l_suppkey actor_id, l_orderkey case_id, 'f' || l_linenumber || CASE WHEN l_linenumber % 3 = 0 THEN ' Bilaga' ELSE '' END AS f, CASE WHEN l_returnflag = 'N' THEN 'no_position' ELSE l_returnflag END st FROM lineitem WHERE l_linestatus = 'F'),
  k AS (SELECT *, row_number() OVER (PARTITION BY actor_id, case_id ORDER BY st <> 'no_position' DESC, contains(lower(f), 'bilaga'), f, st) n FROM r)
  SELECT actor_id, case_id, max(CASE WHEN n = 1 THEN f END) AS primary_file, max(CASE WHEN n = 1 THEN st END) AS primary_stance, CAST(count(*) - 1 AS INTEGER) AS attachments, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS case_date FROM k LEFT JOIN orders ON o_orderkey = case_id GROUP BY 1, 2""")
def m22_actor_responses(spark, d):
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, " Bilaga").otherwise(""))
    rows = S.load(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("actor_id"), F.col("l_orderkey").alias("case_id"), name.alias("filename"), F.when(F.col("l_returnflag") == "N", "no_position").otherwise(F.col("l_returnflag")).alias("stance"))
    return dated(N.actor_responses(rows, cases(spark, d)), "case_date").withColumn("attachments", F.size("attachments"))


@query("SELECT l_suppkey AS actor_id, l_orderkey AS case_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS case_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey = 7 AND l_returnflag IN ('N', 'A')")
def m23_actor_invites(spark, d):
    return dated(N.actor_invites(invites(spark, d), cases(spark, d), 7).select("actor_id", "case_id", "case_date"), "case_date")


# --- coverage of documents; a document's type is its language, done means labelled ---
def labelled(spark, d):
    return S.load(spark, d, "labels").select("doc_id").distinct()


@query("SELECT lang, count(*) AS total, count(*) FILTER (length(text) > 0) AS with_text, count(*) FILTER (source IS NOT NULL) AS with_url, count(*) FILTER (n_chars >= 1000) AS long FROM documents GROUP BY 1")
def m24_coverage(spark, d):
    return M.coverage(S.load(spark, d, "documents"), "lang", {"with_text": F.length("text") > 0, "with_url": F.col("source").isNotNull(), "long": F.col("n_chars") >= 1000})


@query("""SELECT lang, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS facts, floor(coalesce(sum(n), 0) / count(*) * 10 + 0.5) / 10 AS per_document FROM documents d LEFT JOIN (SELECT doc_id, count(*) n FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id GROUP BY 1""")
def m24_linked_average(spark, d):
    return M.linked_average(S.load(spark, d, "documents"), S.load(spark, d, "labels"), "doc_id", "lang")


@query("SELECT 'documents' AS table_name, count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages")
def m24_table_counts(spark, d):
    return M.table_counts({t: S.load(spark, d, t) for t in ("documents", "labels", "events", "pages")})


@query("SELECT count(*) AS documents, count(l.doc_id) AS with_consultation, (SELECT count(*) FROM labels) AS consultations, CAST(floor(count(l.doc_id) / count(*) * 100 + 0.5) AS BIGINT) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def m25_consultation_coverage(spark, d):
    return M.consultation_coverage(S.load(spark, d, "documents").select("doc_id"), S.load(spark, d, "labels").select(F.col("doc_id").alias("parent_id")))


@query("SELECT l_returnflag AS stance, count(*) AS n, floor(count(*) / sum(count(*)) OVER () * 100 * 100 + 0.5) / 100 AS share FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def m26_stance_distribution(spark, d):
    return M.distribution(responses(spark, d), "stance")


@query("SELECT c_custkey, c_acctbal, coalesce(n, 0) AS document_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def m27_process_list(spark, d):
    bridge = S.load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return M.with_counts(S.load(spark, d, "customer").select("c_custkey", "c_acctbal"), bridge, "c_custkey", "c_acctbal")


@query("SELECT DISTINCT 'lang' AS facet, lang AS value FROM documents WHERE lang <> '' UNION SELECT DISTINCT 'source', source FROM documents WHERE source <> ''")
def m28_facets(spark, d):
    return M.facets(S.load(spark, d, "documents"), ["lang", "source"])


@query("SELECT event_type AS task_type, CASE WHEN value >= 50 THEN 'done' ELSE 'pending' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def m29_task_stats(spark, d):
    return M.task_stats(S.load(spark, d, "events").select(F.col("event_type").alias("task_type"), F.when(F.col("value") >= 50, "done").otherwise("pending").alias("status")))


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def m29_recent_tasks(spark, d):
    return M.recent(S.load(spark, d, "events").select("event_id", "event_type", "ts"), "ts", "event_id")


@query("""SELECT lang AS doc_type, count(*) AS total, count(*) FILTER (length(text) > 0) AS with_text, count(*) FILTER (NOT length(text) > 0) AS missing_text, count(l.doc_id) AS summarised, count(*) FILTER (e.vec_id IS NOT NULL AND l.doc_id IS NOT NULL) AS embedded
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings WHERE embedding IS NOT NULL) e ON e.vec_id = l.doc_id GROUP BY 1""")
def m30_pipeline_counts(spark, d):
    docs = S.load(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("doc_type"))
    summaries = labelled(spark, d).join(S.load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return M.pipeline_counts(docs, summaries)


# --- table maintenance on orders ---
def orders(spark, d, condition):
    return S.load(spark, d, "orders").where(condition).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 <> 0")
def s05_insert_absent(spark, d):
    """All orders are new, those with even keys are there."""
    return S.insert_absent(orders(spark, d, "true"), orders(spark, d, "o_orderkey % 2 = 0"), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def s06_upsert_update(spark, d):
    """Every third order is new, the others and half of these are there."""
    new = orders(spark, d, "o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return S.upsert(new, orders(spark, d, "o_orderkey % 3 <> 0 or o_orderkey % 2 = 0"), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0 THEN o_totalprice ELSE o_totalprice + 1 END AS o_totalprice FROM orders")
def s06_upsert_ignore(spark, d):
    new = orders(spark, d, "o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return S.upsert(new, orders(spark, d, "o_orderkey % 3 <> 0 or o_orderkey % 2 = 0"), ["o_orderkey"], "ignore")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 1 OR o_orderkey % 2 = 0")
def s06_upsert_stored(spark, d):
    """The same in a stored table: two batches of one source, the second of which comes twice, and an old one again."""
    path = new_path(spark, "orders")
    new = orders(spark, d, "o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    create_table(orders(spark, d, "o_orderkey % 3 <> 0 and o_orderkey % 2 = 0"), path, ["o_orderkey"], 16)
    upsert_table(new, path, source="orders", batch=0)
    for _ in range(2):
        upsert_table(orders(spark, d, "o_orderkey % 3 <> 1"), path, "ignore", "orders", 1)
    upsert_table(orders(spark, d, "o_orderkey % 3 = 0"), path, source="orders", batch=0)
    return read_table(spark, path)


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' AND value > 10 ORDER BY ts, event_id LIMIT 50")
def s08_pending(spark, d):
    return S.pending(S.load(spark, d, "events"), [F.col("event_type") == "error", F.col("value") > 10], ["ts", "event_id"], 50).select("event_id", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def s09_after_cursor(spark, d):
    return S.after_cursor(S.load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 100)[0]


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) n FROM documents WHERE lang IN ('en', 'de', 'fr') AND doc_id NOT IN (SELECT doc_id FROM labels))
  WHERE n <= CASE WHEN lang IN ('en', 'de') THEN 17 ELSE 16 END""")
def s11_balanced_batch(spark, d):
    return S.balanced_batch(S.load(spark, d, "documents"), labelled(spark, d), 50, ["en", "de", "fr"], kind="lang", order="n_chars").select("doc_id", "lang")


@query("SELECT l_suppkey, l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem GROUP BY 1, 2")
def s12_dedupe_keep_oldest(spark, d):
    lines = S.load(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_shipdate", "l_linenumber")
    return S.dedupe_keep_oldest(lines, ["l_suppkey", "l_partkey"], "l_shipdate", ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_partkey", "l_orderkey")


@query("SELECT 'l_orderkey' AS \"end\", count(*) AS dangling FROM lineitem WHERE l_orderkey % 5 = 0 UNION ALL SELECT 'l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)")
def s13_integrity_report(spark, d):
    return S.integrity_report(S.load(spark, d, "lineitem"), S.load(spark, d, "orders").where("o_orderkey % 5 <> 0"), ("l_orderkey", "l_partkey"), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def s15_backfill_const(spark, d):
    return S.backfill_const(S.load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderpriority", F.col("o_orderstatus") == "F", "closed").select("o_orderkey", "o_orderpriority")


# --- texts ---
@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS characters, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines FROM documents")
def t02_text_stats(spark, d):
    stats = X.text_stats(F.col("text"))
    return S.load(spark, d, "documents").select("doc_id", *(stats[n].alias(n) for n in ("characters", "words", "lines")))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS short FROM documents")
def t02_truncate(spark, d):
    return S.load(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 80).alias("short"))


_PLAIN = r"regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_char}')"
_PLAIN = rf"trim(regexp_replace(regexp_replace({_PLAIN}, '[ \t]+', ' ', 'g'), '\n[ \t\n\v\f\r]*\n[ \t\n\v\f\r]*\n+', chr(10) || chr(10), 'g'), ' ')"


@query(f"SELECT page_id, {_PLAIN} AS text FROM pages")
def t03_html_to_text(spark, d):
    return S.load(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


# --- names and similarity: part names against the distinct ones of other parts ---
def names(spark, d):
    return S.load(spark, d, "part").select(F.concat("p_name", F.lit(" AB")).alias("name"), "p_name").distinct()


_NAMES = """p AS (SELECT DISTINCT p_name FROM part), {sides},
  s AS (SELECT x.n a, y.n b, count(*) c FROM ga x JOIN gb y ON x.gram = y.gram GROUP BY 1, 2), na AS (SELECT n, count(*) k FROM ga GROUP BY 1), nb AS (SELECT n, count(*) k FROM gb GROUP BY 1),
  z AS (SELECT a, b, CASE WHEN lower(a) = lower(b) THEN 1.0::DOUBLE WHEN (contains(lower(a), lower(b)) OR contains(lower(b), lower(a))) AND least(length(a), length(b)) / greatest(length(a), length(b)) >= 0.5
    THEN 0.8::DOUBLE + 0.2::DOUBLE * (least(length(a), length(b)) / greatest(length(a), length(b))) ELSE c * 2 / (na.k + nb.k) END AS score FROM s JOIN na ON na.n = a JOIN nb ON nb.n = b)"""


def _grams_sql(side: str, name: str) -> str:
    folded = "lower(trim(regexp_replace(regexp_replace(n, '-', ' ', 'g'), '\\s+', ' ', 'g')))"
    return f"g{side} AS (SELECT DISTINCT n, substr({folded}, CAST(i AS BIGINT), 2) AS gram FROM (SELECT {name} AS n FROM p), (SELECT unnest(range(1, 200)) i) WHERE i < length({folded}))"


@query("WITH " + _NAMES.format(sides=_grams_sql("a", "p_name") + ", " + _grams_sql("b", "p_name")) + " SELECT a, b, score FROM z WHERE score >= 0.5")
def e06_string_similarity(spark, d):
    """All pairs of part names with a similarity of .5 or more."""
    p = S.load(spark, d, "part").select("p_name").distinct()
    return E.similar_pairs(p.select(F.col("p_name").alias("a")), p.select(F.col("p_name").alias("b")))


_ALIASES = ", ".join("('" + a.upper() + "', '" + t.lower() + "')" for a, t in rules.ABBREVIATIONS.items())
_STEM = "lower(e)"
for _ending in rules.ORG_ENDINGS:
    _STEM = f"trim(regexp_replace({_STEM}, '{_ending}$', ''))"


@query("WITH " + _NAMES.format(sides=_grams_sql("a", "p_name || ' AB'") + ", " + _grams_sql("b", "p_name")) + f""", ents AS (SELECT p_name AS e, min(p_partkey) AS k FROM part GROUP BY 1), nm AS (SELECT p_name || ' AB' AS n FROM p), al AS (SELECT * FROM (VALUES {_ALIASES}) AS t(a, t)),
  st AS (SELECT e, k, {_STEM} AS stem FROM ents), pt AS (SELECT n, regexp_replace(regexp_replace(lower(n), '^svenska?\\s+', ''), '^sveriges\\s+', '') AS part FROM nm),
  c AS (SELECT n, k, e, 1 AS step, 1.0 AS s, 'exact' AS m FROM nm JOIN ents ON lower(n) = lower(e) UNION ALL SELECT n, k, e, 2, 1.0, 'exact' FROM nm JOIN ents ON regexp_replace(lower(n), '[ -]', '', 'g') = regexp_replace(lower(e), '[ -]', '', 'g')
    UNION ALL SELECT n, k, e, 5, 1.0, 'abbreviation' FROM nm JOIN al ON a = upper(regexp_extract(n, '^[^ -]*')) JOIN ents ON contains(lower(e), t) UNION ALL SELECT n, k, e, 6, 1.0, 'abbreviation' FROM nm JOIN al ON length(a) >= 3 AND contains(upper(n), a) JOIN ents ON contains(upper(e), a)
    UNION ALL SELECT n, k, e, 7, 0.95, 'stem' FROM pt JOIN st ON length(part) >= 6 AND contains(stem, part)),
  d AS (SELECT n, arg_min(k, (step, k)) AS k, arg_min(e, (step, k)) AS e, CAST(arg_min(s, (step, k)) AS DOUBLE) AS s, arg_min(m, (step, k)) AS m FROM c GROUP BY 1), f AS (SELECT a, arg_max(b, (score, -length(b), reverse(b))) AS b, max(score) AS score FROM z WHERE score >= 0.5 GROUP BY 1)
  SELECT nm.n AS name, coalesce(d.k, fe.k) AS entity_id, coalesce(d.e, f.b) AS matched_name, CASE WHEN d.n IS NOT NULL OR f.score >= 0.9 THEN 'high' WHEN f.score >= 0.7 THEN 'medium' WHEN f.score >= 0.5 THEN 'low' ELSE 'unmatched' END AS confidence,
  coalesce(d.s, f.score, 0) AS score, CASE WHEN d.n IS NOT NULL THEN d.m WHEN f.a IS NULL THEN 'none' ELSE 'fuzzy' END AS method FROM nm LEFT JOIN d ON d.n = nm.n LEFT JOIN f ON f.a = nm.n LEFT JOIN ents fe ON fe.e = f.b""")
def e08_resolve(spark, d):
    """Part names with a company's form behind, through the whole cascade."""
    entities = S.load(spark, d, "part").groupBy(F.col("p_name").alias("entity_name")).agg(F.min("p_partkey").alias("entity_id"))
    return E.resolve(names(spark, d).select("name"), entities)


# --- references: orders cite parts ---
def edges(spark, d):
    return S.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), (F.col("l_partkey") + 1_000_000_000).alias("target_id"))


@query("SELECT p_partkey AS doc_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def g06_orphans(spark, d):
    used = S.load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("doc_id"))
    return G.orphans(S.load(spark, d, "part").select(F.col("p_partkey").alias("doc_id")), used)


@query()
def g08_components(spark, d):
    """All edges between orders and parts. SQL's recursion would make all pairs of a component: the tests hold this
    query against a union-find."""
    return G.components(edges(spark, d), "source_id", "target_id")


@query("SELECT node, component FROM (SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1")
def g08_chains(spark, d):
    """Each order is linked to its customer's next one: a chain for each customer."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    chain = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), after.alias("target_id")).where("target_id is not null")
    return G.components(chain, "source_id", "target_id", small=0)


@query("""WITH e AS (SELECT DISTINCT l_orderkey s, l_suppkey t FROM lineitem WHERE l_orderkey <> l_suppkey),
  k AS (SELECT s, t, a.o_orderstatus x, b.o_orderstatus y FROM e JOIN orders a ON a.o_orderkey = s JOIN orders b ON b.o_orderkey = t)
  SELECT DISTINCT CASE WHEN NOT hit AND s > t THEN t ELSE s END AS source_id, CASE WHEN NOT hit AND s > t THEN s ELSE t END AS target_id, CASE WHEN hit THEN 'sou_to_proposition' ELSE 'references' END AS relationship_type FROM
  (SELECT *, (x = 'F' AND y = 'O') OR (x = 'O' AND y = 'F') AS hit FROM k)""")
def g05_classify_relationships(spark, d):
    """Orders cite the order that has their supplier's number; final orders count as reports, open ones as bills."""
    kind = F.when(F.col("o_orderstatus") == "F", "sou").when(F.col("o_orderstatus") == "O", "proposition").otherwise("other")
    docs = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), kind.alias("doc_type"))
    refs = S.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))
    return G.classify_relationships(refs, docs).drop("confidence_score", "confidence_class")


# --- stance: rules of frequent plain words, so that SQL can count them too ---
WORDS = {"support": (" and ", " the "), "oppose": (" of ", " a "), "conditional": (" to ",), "no_opinion": (" on ",)}


@query("""WITH c AS (SELECT doc_id AS id, len(regexp_extract_all(text, '(?i) and ')) + len(regexp_extract_all(text, '(?i) the ')) s, len(regexp_extract_all(text, '(?i) of ')) + len(regexp_extract_all(text, '(?i) a ')) o,
  len(regexp_extract_all(text, '(?i) to ')) c, len(regexp_extract_all(text, '(?i) on ')) n, length(text) >= 100 AS long FROM documents)
  SELECT id, CAST(CASE WHEN long THEN s ELSE 0 END AS BIGINT) AS support_count, CAST(CASE WHEN long THEN o ELSE 0 END AS BIGINT) AS oppose_count, CAST(CASE WHEN long THEN c ELSE 0 END AS BIGINT) AS conditional_count, CAST(CASE WHEN long THEN n ELSE 0 END AS BIGINT) AS no_opinion_count,
  CASE WHEN NOT long THEN 'neutral' WHEN c > 0 AND c >= s AND c >= o THEN 'conditional' WHEN s > 0 AND s > 2 * o THEN 'support' WHEN o > 0 AND o > 2 * s THEN 'oppose' WHEN s > 0 AND o > 0 THEN 'mixed' ELSE 'neutral' END AS stance FROM c""")
def p03_stance(spark, d):
    docs = S.load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return P.stance(docs, positive=WORDS, negated=(), flags="(?i)").select("id", "support_count", "oppose_count", "conditional_count", "no_opinion_count", "stance")


# --- search ---
@query("SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'tion the') AND lang IN ('en', 'de') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def q01_search_documents(spark, d):
    docs = S.load(spark, d, "documents")
    return Q.search_documents(docs, "tion the", ("text",), {"lang": ["en", "de"]}, page=2, date="n_chars")[0].select("doc_id", "lang", "n_chars")


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM documents WHERE contains(lower(text), 'tion the') AND lang IN ('en', 'de')")
def q01_search_total(spark, d):
    return Q.search_documents(S.load(spark, d, "documents"), "tion the", ("text",), {"lang": ["en", "de"]}, page=2, date="n_chars")[1]


@query("""WITH p AS (SELECT doc_id, substr(text, 1, 5000) AS s FROM documents WHERE contains(lower(text), 'tion the')), q AS (SELECT *, greatest(0, coalesce(nullif(instr(lower(s), 'tion'), 0), nullif(instr(lower(s), 'the'), 0), 1) - 101) AS a FROM p)
  SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || substr(s, a + 1, 300) || '...' AS excerpt FROM q""")
def q02_highlight(spark, d):
    hits = S.load(spark, d, "documents").where(Q.like(F.col("text"), "tion the"))
    return hits.select("doc_id", Q.highlight(F.col("text"), "tion the").alias("excerpt"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents)
  SELECT doc_id, CAST(count(*) AS DOUBLE) AS score, count(DISTINCT token) AS terms FROM t WHERE token IN ('thing', 'hand') GROUP BY 1 ORDER BY terms DESC, score DESC, doc_id LIMIT 20""")
def q03_ranked_search(spark, d):
    return Q.ranked_search(Q.token_index(S.load(spark, d, "documents"), {"text": 1.0}), ["thing", "hand"])


@query("""SELECT s_suppkey AS actor_id, s_name AS name, s_nationkey AS actor_type, coalesce(n, 0) AS documents FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
  WHERE contains(lower(s_name), '1') ORDER BY documents DESC, name, actor_id LIMIT 20""")
def q04_search_actors(spark, d):
    return Q.search_actors(actors(spark, d), part_links(spark, d), "1").select("actor_id", "name", "actor_type", "documents")


@query("""WITH q AS (SELECT vec_id query_id, embedding v FROM embeddings WHERE vec_id IN (3, 7)), s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])) similarity FROM q JOIN embeddings ON vec_id <> query_id)
  SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) rank FROM s WHERE similarity >= 0.1) WHERE rank <= 10""")
def q05_similar_documents(spark, d):
    return Q.similar_documents(S.load(spark, d, "embeddings"), [3, 7], threshold=0.1, key="vec_id")


# --- pages ---
@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=')) FROM pages) GROUP BY 1")
def t00_page_tokens(spark, d):
    """Anchors of each page, counted over the table of tags."""
    return H.page_tokens(S.load(spark, d, "pages")).where("tag = 'a'").groupBy("page_id").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT page_id, CASE WHEN regexp_matches(h, '^https?://') THEN h ELSE 'https://www.regeringen.se' || CASE WHEN h LIKE '/%' THEN '' ELSE '/' END || h END AS url
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) WHERE h <> '' AND h NOT LIKE '#%'""")
def t05_extract_links(spark, d):
    """By href alone: these pages have no related-links sections."""
    return H.extract_links(H.page_tokens(S.load(spark, d, "pages")), within=None).select("page_id", "url")


@query("SELECT doc_id, CAST(CASE WHEN instr(text, ' the ') > 0 THEN floor((instr(text, ' the ') - 1) / 500) + 1 END AS INTEGER) AS page FROM documents")
def t10_estimate_page(spark, d):
    return S.load(spark, d, "documents").select("doc_id", X.estimate_page(F.col("text"), F.lit(" the "), 500).alias("page"))


@query("SELECT page_id, upper(regexp_replace(trim(url), '\\s+', ' ', 'g')) AS number FROM (SELECT page_id, regexp_replace(url, '\\.\\s*', '. ', 'g') AS url FROM pages)")
def t08_normal_number(spark, d):
    return S.load(spark, d, "pages").select("page_id", X.normal_number(F.col("url")).alias("number"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.pdf$') THEN 'pdf' ELSE 'other' END AS kind FROM pages")
def t11_file_kind(spark, d):
    return S.load(spark, d, "pages").select("page_id", X.file_kind(F.col("url")).alias("kind"))


@query("SELECT c_custkey AS id, unnest(['Almega ' || c_custkey, 'Kommun ' || c_custkey, 'Vinnova' || c_custkey, c_name, 'Hovrätten ' || c_custkey]) AS name FROM customer")
def t19_numbered_names(spark, d):
    """A numbered list for each customer, in all of the forms."""
    n = F.col("c_custkey").cast("string")
    lines = ("1. Almega ", n, "\n2) Kommun ", n, "\n3: Vinnova", n, "\n4 – ", F.col("c_name"), "\n5\nHovrätten ", n, "\n999. Verket\n6. Sida 3\nutan nummer")
    text = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    return H.parse_numbered_list(S.spread(S.load(spark, d, "customer").select("c_custkey", "c_name")).select(F.col("c_custkey").alias("id"), text.alias("text")))[0].select("id", "name")


@query()
def t19_numbered_list(spark, d):
    rows = H.parse_numbered_list(S.load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))[1]
    return rows.select("id", "total_lines", "numbered_lines", "organizations", "status")


# --- names and titles ---
@query("SELECT p_name || ' ' AS name, min(p_partkey) AS entity_id FROM part GROUP BY p_name")
def e03_match_exact(spark, d):
    """Names with a blank behind: equal without blanks and hyphens."""
    part = S.load(spark, d, "part")
    entities = part.groupBy(F.col("p_name").alias("entity_name")).agg(F.min("p_partkey").alias("entity_id"))
    return E.match_exact(part.select(F.concat("p_name", F.lit(" ")).alias("name")).distinct(), entities).select("name", "entity_id")


@query("WITH " + _NAMES.format(sides=_grams_sql("a", "p_name || 'x'") + ", " + _grams_sql("b", "p_name")) + """, m AS (SELECT a, arg_max(b, (score, -length(b), reverse(b))) AS b, max(score) AS score FROM z WHERE score >= 0.5 GROUP BY 1)
  SELECT p_name || 'x' AS name, k AS entity_id, b AS matched_name, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'unmatched' END AS confidence, coalesce(score, 0) AS score, 'fuzzy' AS method
  FROM p LEFT JOIN m ON a = p_name || 'x' LEFT JOIN (SELECT p_name AS e, min(p_partkey) AS k FROM part GROUP BY 1) ON e = b""")
def e07_match_fuzzy(spark, d):
    part = S.load(spark, d, "part")
    entities = part.groupBy(F.col("p_name").alias("entity_name")).agg(F.min("p_partkey").alias("entity_id"))
    return E.match_fuzzy(part.select(F.concat("p_name", F.lit("x")).alias("name")).distinct(), entities)


@query("""WITH e AS (SELECT lower(p_name) k, min(p_partkey) m FROM part GROUP BY 1) SELECT p_partkey AS entity_id, m AS canonical_id FROM part JOIN e ON lower(p_name) = k WHERE p_partkey <> m""")
def e12_merge_duplicates(spark, d):
    part = S.load(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("entity_name"), F.lit(0).alias("created_at"))
    return E.merge_duplicates(part)[1]


def _trigrams_sql(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c}) + 2), lambda i: substr('  ' || {c} || ' ', CAST(i AS BIGINT), 3)))"


@query(f"""WITH r AS (SELECT p_partkey AS ref_id, lower(p_name) || ' enligt förslaget' AS title FROM part WHERE length(p_name) > 0), t AS (SELECT DISTINCT title FROM r), w AS (SELECT title, unnest(string_split(title, ' ')) AS w, generate_subscripts(string_split(title, ' '), 1) AS i FROM t),
  k AS (SELECT title, list(w ORDER BY length(w) DESC, i) AS ws FROM w WHERE length(w) > 4 AND w NOT IN ({", ".join(repr(x) for x in G.STOP_WORDS)}) GROUP BY 1), d AS (SELECT lower(p_name) AS low, min(p_partkey) AS doc_id FROM part GROUP BY p_name),
  p AS (SELECT k.title, doc_id, low, coalesce(contains(low, ws[2]), false) AS both_, len(list_intersect({_trigrams_sql('k.title')}, {_trigrams_sql('low')})) AS c, len({_trigrams_sql('k.title')}) + len({_trigrams_sql('low')}) AS n FROM k JOIN d ON contains(low, ws[1])),
  s AS (SELECT *, c / (n - c) AS similarity FROM p), b AS (SELECT title, coalesce(arg_min({{'d': doc_id, 's': similarity}}, (-similarity, doc_id)) FILTER (both_), arg_min({{'d': doc_id, 's': similarity}}, (-similarity, doc_id))) AS x FROM s GROUP BY 1)
  SELECT ref_id, CASE WHEN x.s >= 0.35 THEN x.d END AS target_id, x.s AS similarity, CASE WHEN k.title IS NULL THEN 'no_search_words' WHEN x IS NULL THEN 'no_candidates' WHEN x.s >= 0.35 THEN 'matched' ELSE 'below_threshold' END AS reason FROM r LEFT JOIN k USING (title) LEFT JOIN b USING (title)""")
def g03_match_titles(spark, d):
    """References by part names with another ending, against parts as documents."""
    part = S.load(spark, d, "part")
    refs = part.select(F.col("p_partkey").alias("ref_id"), F.col("p_partkey").alias("source_id"), F.concat("p_name", F.lit(" enligt förslaget")).alias("target_number"))
    docs = part.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("doc_id"))
    return G.match_titles(refs, docs).select("ref_id", "target_id", "similarity", "reason")


# --- adoption and clusters: parts are documents, brands are processes; an order links its first and last part, and parts
# of one brand, type and size are linked to the first of them ---
def part_edges(spark, d):
    lines = S.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("source_id"), F.max("l_partkey").alias("target_id"))
    return lines.where("source_id <> target_id").select("source_id", "target_id")


def alike_edges(spark, d):
    kind = ["p_brand", "p_type", "p_size"]
    part = S.load(spark, d, "part")
    first = part.groupBy(*kind).agg(F.min("p_partkey").alias("source_id"))
    return part.join(first, kind).select("source_id", F.col("p_partkey").alias("target_id"))


_EDGES = "e AS (SELECT min(l_partkey) s, max(l_partkey) t FROM lineitem GROUP BY l_orderkey HAVING min(l_partkey) <> max(l_partkey))"


@query(f"""WITH {_EDGES}, b AS (SELECT DISTINCT s AS doc_id, t AS other FROM e UNION SELECT DISTINCT t, s FROM e), m AS (SELECT p_partkey doc_id, p_brand process_id FROM part WHERE p_partkey % 2 = 0)
  SELECT b.doc_id, min(process_id) AS process_id FROM b JOIN m ON m.doc_id = b.other WHERE b.doc_id % 2 <> 0 GROUP BY 1 HAVING count(DISTINCT process_id) = 1""")
def g07_adopt_orphans(spark, d):
    members = S.load(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("process_id"))
    return G.adopt_orphans(part_edges(spark, d), members)[0]


@query("""WITH g AS (SELECT p_brand, count(*) AS size, min(p_partkey) m FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) BETWEEN 2 AND 20)
  SELECT m AS component, p_name AS title, g.p_brand AS ministry, 'published' AS stage, CAST(size AS BIGINT) AS size FROM g JOIN part ON p_partkey = m""")
def g09_clusters_to_processes(spark, d):
    docs = S.load(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("N "), F.col("p_partkey")).alias("doc_number"), F.lit("sou").alias("doc_type"), F.col("p_name").alias("title"), F.col("p_brand").alias("ministry"))
    made = G.clusters_to_processes(G.components(alike_edges(spark, d), "source_id", "target_id"), docs)[0]
    return made.select("component", "title", "ministry", "stage", "size")


# --- streams: files that come one after the other, to the end ---
#: Days of events in one file; every eleventh event comes a file later than its time says.
_FILE_DAYS, _LATE_FILES = 8, 1
_FILED = f"""f AS (SELECT *, date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) // {_FILE_DAYS} + CASE WHEN event_id % 11 = 0 THEN {_LATE_FILES} ELSE 0 END AS file FROM events),
  n AS (SELECT *, dense_rank() OVER (ORDER BY file) - 1 AS batch FROM f)"""


def events_stream(spark, d, in_order: bool = True) -> DataFrame:
    """Events as a stream of files, each a batch; in_order: by their time, else some come late."""
    events = S.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = events.agg(F.min(F.to_date("ts")).alias("first"))
    late = F.lit(0) if in_order else F.when(F.col("event_id") % 11 == 0, _LATE_FILES).otherwise(0)
    filed = events.crossJoin(F.broadcast(first)).withColumn("file", (F.floor(F.datediff(F.to_date("ts"), "first") / _FILE_DAYS) + late).cast("int")).drop("first")
    base = new_path(spark, "events")
    for r in filed.select("file").distinct().orderBy("file").collect():
        # a stream takes files in the order of their times of change
        filed.where(F.col("file") == r["file"]).drop("file").repartition(1).write.mode("append").parquet(f"{base}/{r['file']:06d}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/*")


def streamed(df: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream has given out when it has read all that is there, with the number of their batch."""
    spark, base = df.sparkSession, new_path(df.sparkSession, "stream")
    writer = df.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/rows"))
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema.add("batch", "integer")).parquet(f"{base}/rows")


def deduplicated(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, late, counts by batch) of the events, some of which come a file late; a delay of four days."""
    base = new_path(spark, "once")
    rows = events_stream(spark, d, in_order=False).withColumnRenamed("user_id", "case_id").withColumn("event_date", F.to_date("ts"))
    none = spark.createDataFrame([], rows.schema).withColumn("batch", F.lit(0).cast("long"))
    create_table(none, f"{base}/kept", ["case_id", "event_type", "event_date"], 8)
    create_table(none, f"{base}/late", ["event_id"], 8)
    create_table(spark.createDataFrame([], "batch long, rows long, late long, added long, duplicates long, latest timestamp"), f"{base}/counts", ["batch"], 1)
    R.stream_events_once(rows, f"{base}/kept", f"{base}/late", f"{base}/counts", f"{base}/state", "4 days").awaitTermination()
    return tuple(read_table(spark, f"{base}/{t}") for t in ("kept", "late", "counts"))


_SPLIT = _FILED + """, w AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM n GROUP BY batch),
  s AS (SELECT n.*, coalesce(ts < latest - INTERVAL 4 DAY, false) AS late FROM n JOIN w USING (batch)),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY batch, ts, event_id) AS turn FROM s WHERE NOT late)"""


@query(f"WITH {_SPLIT} SELECT event_id, batch, 'kept' AS outcome FROM k WHERE turn = 1 UNION ALL SELECT event_id, batch, 'late' FROM s WHERE late")
def x02_stream_dedup(spark, d):
    """Each case's first event of a type and day, of those that came before the watermark had passed them, and the late ones."""
    kept, late, _ = deduplicated(spark, d)
    told = lambda df, outcome: df.select("event_id", "batch", F.lit(outcome).alias("outcome"))
    return told(kept, "kept").unionByName(told(late, "late"))


@query(f"""WITH {_SPLIT} SELECT batch, count(*) AS rows, count(*) FILTER (WHERE s.late) AS late, count(*) FILTER (WHERE k.turn = 1) AS added, count(*) FILTER (WHERE k.turn > 1) AS duplicates
  FROM s LEFT JOIN k USING (event_id, batch) GROUP BY 1""")
def x02_stream_counts(spark, d):
    """By batch: kept, late and repeated events make up what came."""
    return deduplicated(spark, d)[2].select("batch", "rows", "late", "added", "duplicates")


_SLIDES = "SELECT ts, event_type, time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS w FROM events, range(0, 4) t(i)"


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 DAY")
def x03_stream_task_counts(spark, d):
    """Hours that the watermark has closed, each given out once."""
    return dated(streamed(R.task_counts(events_stream(spark, d)), "append").select("window_start", "event_type", "n"), "window_start")


@query(f"SELECT CAST(w AS VARCHAR) AS window_start, event_type, count(*) AS n FROM ({_SLIDES}) GROUP BY w, event_type HAVING w + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 DAY")
def x03_stream_sliding(spark, d):
    """Hours that start every quarter, closed by a watermark two days back."""
    counts = R.task_counts(events_stream(spark, d), slide="15 minutes", delay="2 days")
    return dated(streamed(counts, "append").select("window_start", "event_type", "n"), "window_start")


@query("""SELECT user_id AS case_id, CAST(a AS VARCHAR) AS start_ts, CAST(b AS VARCHAR) AS end_ts, CAST(date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) AS INTEGER) AS days FROM (
  SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts END) a, min(CASE WHEN event_type = 'purchase' THEN ts END) b FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1)""")
def x04_stream_velocity(spark, d):
    """Spans of cases, merged into a stored table as they change; state goes two days after a case's last event."""
    rows = events_stream(spark, d).withColumnRenamed("user_id", "case_id")
    spans, base = R.stream_velocity(rows, "signup", "purchase", delay="1 day", keep="2 days"), new_path(spark, "spans")
    create_table(spark.createDataFrame([], spans.schema), f"{base}/cases", ["case_id"], 8)
    writer = spans.writeStream.outputMode("update").foreachBatch(R.table_sink(f"{base}/cases", "spans", R.earliest_span))
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return dated(read_table(spark, f"{base}/cases").select("case_id", "start_ts", "end_ts", "days"), "start_ts", "end_ts")
