"""Queries of operators whose input the star schema does not hold as it is: texts, pages, names and documents are built
from the tables' columns, row by row, so the work grows with the tables; the SQL says what must come out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..operators import entities as E
from ..operators import network as N
from ..operators import pages as H
from ..operators import process as C
from ..operators import references as G
from ..operators import search as Q
from ..operators import stance as P
from ..sources import api as A
from ..sources import tables as S
from ..sources.scratch import new_path, written
from ..sources.stored import create_table, read_table
from ..streaming import streams as R
from .queries import dated, query


def filled(template: str, **columns: Column) -> Column:
    """A text with columns in the places {name}."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else columns[p].cast("string") for i, p in enumerate(parts) if i % 2 or p))


def filled_sql(template: str, **columns: str) -> str:
    """The same in SQL."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join("'" + p.replace("'", "''") + "'" if i % 2 == 0 else f"CAST({columns[p]} AS VARCHAR)" for i, p in enumerate(parts) if i % 2 or p)


def one_of(n: Column, values: list) -> Column:
    """The value whose number n is, modulo their count."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def one_of_sql(n: str, values: list[str]) -> str:
    return f"list_extract([{', '.join(values)}], CAST({n} % {len(values)} AS BIGINT) + 1)"


def quoted(values: list[str | None]) -> list[str]:
    return ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]


def clean_sql(c: str) -> str:
    """S10, S16, T1: a sanitized text in SQL."""
    c = f"replace(replace(replace(coalesce({c}, ''), chr(0), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    blank = "[ \\t\\n\\v\\f\\r]"
    return f"regexp_replace(regexp_replace(nfc_normalize(regexp_replace({c}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')), '^{blank}+', ''), '{blank}+$', '')"


# --- sources ---
@query("SELECT c_custkey, c_name FROM customer")
def s01_load(spark, d):
    return S.load(spark, d, "customer", "c_custkey bigint, c_name string")


def listings(spark, d):
    """A listing page for each customer, of the customer's orders: one object where there is one, else an array."""
    o = S.load(spark, d, "orders")
    item = F.struct(F.concat(F.lit("H"), "o_orderkey").alias("dok_id"), F.lit("2024/25").alias("rm"), F.col("o_orderkey").cast("string").alias("beteckning"), F.col("o_orderpriority").alias("titel"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("datum"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("organ"))
    per = o.groupBy("o_custkey").agg(F.collect_list(item).alias("items"))
    text = F.when(F.size("items") == 1, F.to_json(F.get("items", F.lit(0)))).otherwise(F.to_json("items"))
    return per.select("o_custkey", F.concat(F.lit('{"dokumentlista":{"dokument":'), text, F.lit("}}")).alias("json"))


@query("""SELECT 'proposition' AS doc_type, 'Prop. 2024/25:' || o_orderkey AS doc_number, o_orderpriority AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS publication_date,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS ministry, 'proposition' AS lifecycle_stage, 'https://www.riksdagen.se/sv/dokument-och-lagar/dokument/proposition/H' || o_orderkey || '/' AS url FROM orders""")
def s02_ingest_listing(spark, d):
    return dated(A.ingest_listing(listings(spark, d), "prop").drop("metadata"), "publication_date")


@query("SELECT o_custkey, CAST(count(*) AS INTEGER) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def s03_one_or_many(spark, d):
    rows = listings(spark, d).select("o_custkey", S.one_or_many(F.get_json_object("json", "$.dokumentlista.dokument"), "struct<beteckning:string>").alias("items"))
    return rows.select("o_custkey", F.size("items").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["beteckning"].cast("long")).alias("total"))


def status_documents(spark, d):
    """A status document for each order: its lines are references, activities and attachments."""
    line = S.load(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    ref = F.struct(one_of_flag(flag, "behandlar", "hänvisar", "besvarar").alias("referenstyp"), F.lit("prop").alias("ref_dok_typ"), F.lit("2024/25").alias("ref_dok_rm"), F.col("l_partkey").cast("string").alias("ref_dok_bet"))
    act = F.struct(one_of_flag(flag, "BES", "UTL", "AVG").alias("kod"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("datum"), F.lit(None).cast("string").alias("namn"))
    file = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "PDF").otherwise("DOC").alias("filtyp"), F.concat(F.lit("f"), F.lpad("l_linenumber", 2, "0")).alias("fil_url"))
    per = line.groupBy("l_orderkey").agg(*(F.sort_array(F.collect_list(x)).alias(n) for n, x in (("referens", ref), ("aktivitet", act), ("bilaga", file))))
    status = F.struct(F.struct(F.lit("FiU21").alias("beteckning")).alias("dokument"), F.struct("bilaga").alias("dokbilaga"), F.struct("referens").alias("dokreferens"), F.struct("aktivitet").alias("dokaktivitet"))
    return per.select(F.col("l_orderkey").alias("dok_id"), F.to_json(F.struct(status.alias("dokumentstatus"))).alias("json"))


def one_of_flag(flag: Column, a: str, n: str, r: str) -> Column:
    return F.when(flag == "A", a).when(flag == "N", n).otherwise(r)


@query("SELECT l_orderkey AS dok_id, 'Prop. 2024/25:' || l_partkey AS target_number, CASE l_returnflag WHEN 'A' THEN 'recommends' WHEN 'N' THEN 'cites' ELSE 'responds_to' END AS reference_type FROM lineitem")
def s04_status_references(spark, d):
    return A.extract_status(status_documents(spark, d))["references"].select("dok_id", "target_number", "reference_type")


@query("""WITH b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
  SELECT l_orderkey AS dok_id, CASE l_returnflag WHEN 'A' THEN 'parliament_decision' WHEN 'N' THEN 'committee_referral' ELSE 'parliament_vote' END AS event_type, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS event_date,
  CASE l_returnflag WHEN 'A' THEN 'Riksdagsbeslut' WHEN 'N' THEN 'Utskottsbehandling' ELSE 'Omröstning' END AS description FROM lineitem WHERE l_returnflag <> 'R' OR l_orderkey NOT IN (SELECT l_orderkey FROM b)""")
def s04_status_events(spark, d):
    return dated(A.extract_status(status_documents(spark, d))["events"], "event_date")


@query("SELECT l_orderkey AS dok_id, 'f' || lpad(CAST(min(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END) AS VARCHAR), 2, '0') AS pdf_url, 'FiU' AS committee FROM lineitem GROUP BY 1")
def s04_status_facts(spark, d):
    return A.extract_status(status_documents(spark, d))["facts"]


@query("SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders")
def s07_full_refresh(spark, d):
    """Orders are written as a table, which is then replaced by a query over itself."""
    path = new_path(spark, "orders")
    S.full_refresh(S.load(spark, d, "orders").select("o_orderkey", "o_totalprice"), path)
    S.full_refresh(spark.read.parquet(path).withColumn("o_totalprice", F.col("o_totalprice") + 1), path)
    return spark.read.parquet(path)


_FILES = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '<html>' || text WHEN doc_id % 7 = 1 THEN substr(text, 1, 40) ELSE text END AS t FROM documents WHERE doc_id % 5 <> 0"


@query(f"""WITH f AS ({_FILES}) SELECT doc_id, reason, sha1(CASE reason WHEN 'kept' THEN text WHEN 'filled' THEN {clean_sql('t')} END) AS content FROM
  (SELECT d.doc_id, text, t, CASE WHEN d.doc_id % 3 = 0 AND length(text) > 0 THEN 'kept' WHEN t IS NULL THEN 'no_file' WHEN d.doc_id % 7 = 0 THEN 'html_redirect' WHEN length({clean_sql('t')}) < 50 THEN 'too_short' ELSE 'filled' END AS reason FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id)""")
def s10_backfill_text(spark, d):
    docs, n = S.load(spark, d, "documents"), F.col("doc_id") % 7
    files = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(n == 0, F.concat(F.lit("<html>"), "text")).when(n == 1, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text"))
    out = S.backfill_text(docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("raw_content")), files)
    return out.select("doc_id", "reason", F.sha1("raw_content").alias("content"))


@query("""WITH x AS (SELECT 'lines' AS table_name, CASE WHEN l_quantity > 10 THEN l_linenumber END AS p, CASE WHEN l_tax > 0.02 THEN 'e' END AS e FROM lineitem UNION ALL SELECT 'orders', CASE WHEN o_orderstatus = 'F' THEN 1 END, CASE WHEN o_orderstatus <> 'P' THEN 'e' END FROM orders)
  SELECT table_name, count(*) AS total, count(p) AS with_page, count(e) AS with_excerpt, round(count(*) FILTER (p IS NOT NULL AND e IS NOT NULL) * 100 / count(*), 2) AS coverage, count(*) FILTER ((p IS NULL) <> (e IS NULL)) AS violations FROM x GROUP BY 1""")
def s14_citation_quality(spark, d):
    line = S.load(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 10, F.col("l_linenumber")).alias("source_page"), F.when(F.col("l_tax") > 0.02, "e").alias("source_excerpt"))
    order = S.load(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", 1).alias("source_page"), F.when(F.col("o_orderstatus") != "P", "e").alias("source_excerpt"))
    return S.citation_quality({"lines": line, "orders": order})


@query(f"""WITH s AS (SELECT doc_id, {clean_sql('text')} AS t, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'not_pdf' WHEN doc_id % 13 = 0 THEN 'error' WHEN length({clean_sql('text')}) < 100 THEN 'skipped' ELSE 'ok' END AS extraction_status FROM documents)
  SELECT doc_id, extraction_status, sha1(CASE WHEN extraction_status = 'ok' THEN t ELSE 'old' END) AS content FROM s""")
def s16_apply_texts(spark, d):
    docs, n = S.load(spark, d, "documents"), F.col("doc_id")
    found = docs.where("doc_id % 6 <> 0").select("doc_id", "text", (F.col("n_chars") / 2000).cast("int").alias("pages"), F.col("n_chars").alias("bytes"), F.when(n % 13 == 0, "broken").alias("error"), F.when(n % 11 == 0, "word").otherwise("pdf").alias("file_kind"))
    out = S.apply_texts(docs.select("doc_id", F.lit("sou").alias("doc_type"), F.lit("old").alias("raw_content"), F.lit(None).cast("string").alias("metadata")), found)
    return out.select("doc_id", "extraction_status", F.sha1("raw_content").alias("content"))


# --- texts ---
_ENTITY_SQL = "regexp_replace(html, '&amp;|&#38;', '&', 'g')"
for _char, _names in rules.ENTITIES.items():
    _ENTITY_SQL = f"regexp_replace({_ENTITY_SQL}, '{'|'.join(f'&{n};' for n in _names)}', '{_char}', 'g')"


@query(f"SELECT page_id, sha1({_ENTITY_SQL}) AS clean FROM pages")
def t04_decode_entities(spark, d):
    return S.load(spark, d, "pages").select("page_id", F.sha1(X.decode_entities(F.col("html"))).alias("clean"))


@query(f"SELECT doc_id, sha1({clean_sql('text')}) AS clean FROM documents")
def t01_sanitize(spark, d):
    return S.load(spark, d, "documents").select("doc_id", F.sha1(X.sanitize(F.col("text"))).alias("clean"))


_LINKS = [
    ("https://www.regeringen.se/rattsliga-dokument/kommittedirektiv/2023/12/dir.-2023{n}", "Direktivet", "cites", False, None),
    ("https://www.regeringen.se/x/{n}", "Ändringar i lagen", "amends", False, None),
    ("https://www.regeringen.se/y/{n}", "Remissvar på förslaget", "responds_to", False, None),
    ("https://www.regeringen.se/pressmeddelanden/2024/{n}", "Direktiv", "related", True, "press_release"),
    ("https://www.regeringen.se/a{n}.zip", "Allt", "related", True, "document_bundle"),
    ("https://example.com/{n}", "Annat", "related", True, "external"),
    ("https://data.riksdagen.se/{n}", "Läs mer", "related", False, None),
]


@query(f"""SELECT p_partkey AS id, {one_of_sql('p_partkey', quoted([x[2] for x in _LINKS]))} AS reference_type, {one_of_sql('p_partkey', [str(x[3]) for x in _LINKS])} AS external, {one_of_sql('p_partkey', quoted([x[4] for x in _LINKS]))} AS external_type FROM part""")
def t06_classify_links(spark, d):
    n = F.col("p_partkey")
    rows = S.load(spark, d, "part").select(n.alias("id"), one_of(n, [filled(x[0], n=n) for x in _LINKS]).alias("url"), one_of(n, [x[1] for x in _LINKS]).alias("anchor"))
    kinds = X.link_kind(F.col("url"), F.col("anchor"))
    return rows.select("id", *(kinds[c].alias(c) for c in ("reference_type", "external", "external_type")))


#: Spellings of a number {n} in a year, and what is read from them.
_NUMBERS = [
    ("SOU 2024:{n}", "SOU 2024:{n}", "sou_pattern"), ("Betänkandet sou-2024-{n} om", "SOU 2024:{n}", "sou_pattern"), ("Dir 2023:{n}", "Dir. 2023:{n}", "dir_pattern"), ("Prop. 2024/25:{n}", "Prop. 2024/25:{n}", "prop_pattern"),
    ("Ds 2025:{n}", "Ds 2025:{n}", "ds_pattern"), ("2024/25:FPM{n}", "2024/25:FPM{n}", "fpm_pattern"), ("Bet. 2024/25:FiU{n}", "HC01FiU{n}", "bet_pattern"), ("ingenting {n}", None, None),
]
_NUMBER_SQL = one_of_sql("p_partkey", ["NULL" if x[1] is None else filled_sql(x[1], n="p_size") for x in _NUMBERS])


def numbered(n: Column, size: Column) -> Column:
    return one_of(n, [filled(x[0], n=size) for x in _NUMBERS])


@query(f"SELECT p_partkey AS id, {_NUMBER_SQL} AS number, {one_of_sql('p_partkey', quoted([x[2] for x in _NUMBERS]))} AS evidence FROM part")
def t07_document_number(spark, d):
    rows = S.load(spark, d, "part").select(F.col("p_partkey").alias("id"), X.document_number(numbered(F.col("p_partkey"), F.col("p_size"))).alias("f"))
    return rows.select("id", "f.number", "f.evidence")


def swedish_days(date: Column, n: Column) -> Column:
    """A date as texts write it: in four ways by n."""
    month = F.element_at(F.array(*map(F.lit, rules.MONTHS)), F.month(date))
    parts = {"d": F.dayofmonth(date), "m": month, "y": F.year(date)}
    return one_of(n, [F.date_format(date, "'Beslut' yyyy-MM-dd"), filled("den {d} {m} {y}", **parts), filled("Stockholm {d} {m} {y}", **parts), filled("i {m} {y}", **parts)])


@query("""SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 4 = 3 THEN date_trunc('month', CAST(o_orderdate AS DATE)) ELSE CAST(o_orderdate AS DATE) END AS DATE)::VARCHAR AS date, CASE WHEN o_orderkey % 4 = 3 THEN 'month' ELSE 'day' END AS precision FROM orders""")
def t09_swedish_date(spark, d):
    rows = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.swedish_date(swedish_days(F.col("o_orderdate"), F.col("o_orderkey"))).alias("f"))
    return dated(rows.select("id", "f.date", "f.precision"), "date")


@query("SELECT doc_id, substr('passage: ' || concat_ws(' ', text, lang, concat_ws(', ', source, 'x')), 1, 1800) AS input FROM documents")
def t22_embedding_input(spark, d):
    return S.load(spark, d, "documents").select("doc_id", X.embedding_input(F.col("text"), F.col("lang"), F.array("source", F.lit("x"))).alias("input"))


_TYPES = ["prop", "directive", "sou", "law"]


@query("""SELECT doc_id, sha1(CASE doc_id % 4 WHEN 0 THEN CASE WHEN length(text) > 25000 THEN substr(text, 1, 15000) || chr(10) || right(text, 10000) ELSE text END WHEN 1 THEN substr(text, 1, 5000) WHEN 2 THEN substr(text, 1, 15000) ELSE substr(text, 1, 10000) END) AS focus FROM documents""")
def t23_focus_text(spark, d):
    return S.load(spark, d, "documents").select("doc_id", F.sha1(X.focus_text(F.col("text"), one_of(F.col("doc_id"), _TYPES))).alias("focus"))


# --- pages: one for each part ---
PAGE = """<html><body><main class="main-content"><h1>Remiss av SOU 2024:{n}</h1><p>Sista svarsdatum: {day} april 2025</p><p>Finansdepartementet</p>
<h2>Ladda ner</h2><ul class="list--icons"><li><a href="/contentassets/x/sou-2024-{n}.pdf">SOU 2024:{n} (pdf 3,2 MB)</a></li><li><a href="/contentassets/x/fil{n}.pdf">{second}</a></li><li><a href="/contentassets/x/data.xlsx">Data</a></li></ul>
<div class="genvagar"><a href="/remisser/2024/05/{n}">Remiss av betänkandet</a><a href="#">x</a></div>
<h3>Remissinstanser</h3><ul><li><a href="/contentassets/x/lista{n}.pdf">Lista (pdf)</a></li></ul>
<div class="remissvar"><a href="/contentassets/x/kalmar.pdf">Kalmar kommun (pdf 522 kB)</a></div></main></body></html>"""
_SECOND = [("Kortversion (pdf 1 MB)", 36), ("Faktablad (1 MB)", 51), ("Bilaga (pdf)", 46)]


def case_pages(spark, d) -> DataFrame:
    n = F.col("p_partkey")
    return S.spread(S.load(spark, d, "part")).select(n.alias("page_id"), filled(PAGE, n=n, day=F.pmod(n, F.lit(28)) + 1, second=one_of(n, [x[0] for x in _SECOND])).alias("html"))


def case_documents(spark, d) -> DataFrame:
    n = F.col("p_partkey")
    return S.load(spark, d, "part").select(n.alias("page_id"), n.alias("doc_id"), F.lit("sou").alias("doc_type"), F.concat(F.lit("SOU 2024:"), n).alias("doc_number"))


@query(f"""WITH l AS (SELECT p_partkey AS page_id, unnest([{{'u': 'sou-2024-' || p_partkey, 's': 49}}, {{'u': 'fil' || p_partkey, 's': {one_of_sql('p_partkey', [str(x[1]) for x in _SECOND])}}}]) AS x FROM part)
  SELECT page_id, 'https://www.regeringen.se/contentassets/x/' || x.u || '.pdf' AS url, CAST(x.s AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY x.s DESC) AS INTEGER) AS rank, CAST(least(100, 2 * x.s) AS INTEGER) AS confidence FROM l""")
def t12_score_attachments(spark, d):
    """The best two files of each page."""
    out = H.score_attachments(H.page_tokens(case_pages(spark, d)), case_documents(spark, d), top=2)
    return out.select("page_id", "url", F.col("score").cast("int").alias("score"), "rank", F.col("confidence").cast("int").alias("confidence"))


@query("SELECT p_partkey AS page_id, 'Remiss av SOU 2024:' || p_partkey AS title, '2025-04-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS deadline, 'https://www.regeringen.se/contentassets/x/lista' || p_partkey || '.pdf' AS invitees_url FROM part")
def t13_consultation_page(spark, d):
    pages = case_pages(spark, d)
    return dated(H.parse_consultation_page(pages, H.page_tokens(pages))[0], "deadline")


#: Consultation pages of three kinds with their answers: (file behind /x/, organisation, kind of file).
_ANSWER_PAGES = [
    ('<h1>Remiss</h1><div class="remissvar"><ul><li><a href="/contentassets/x/{n}-kalmar.pdf">Kalmar kommun</a></li><li><a href="/contentassets/x/{n}-skv.pdf">Yttrande från Skatteverket.pdf</a></li></ul></div><a href="/om">Om oss</a>',
     [("{n}-kalmar.pdf", "Kalmar kommun", "pdf"), ("{n}-skv.pdf", "Skatteverket", "pdf")]),
    ('<h2>Remissinstanser</h2><a href="/contentassets/x/{n}-lista.pdf">Sändlista</a><h2>Svar</h2>' + "<div>" * 20 + '<section class="remissvar"><p><a href="/contentassets/x/{n}-a">Bilaga Östhammars kommun</a></p><div><a href="/contentassets/x/{n}-b">Remissvar_Lunds-universitet</a></div></section>' + "</div>" * 20 + '<a href="/contentassets/x/{n}-c">Ingen</a>',
     [("{n}-a", "Östhammars kommun", None), ("{n}-b", "Lunds universitet", None)]),
    ('</div></section></ul><div class="content"><p>Svar<p><a href="/contentassets/x/{n}-bov.pdf">Boverket (pdf 120 kB)</a><a href="/contentassets/x/{n}-nv">Remissvar Naturvårdsverket</a><a href="/rapport/{n}">Kalmar kommun</a></div>',
     [("{n}-bov.pdf", "Boverket", "pdf"), ("{n}-nv", "Naturvårdsverket", None)]),
]


def _answer_rows(kind: int) -> str:
    out = []
    for file, name, file_kind in _ANSWER_PAGES[kind][1]:
        out.append(f"SELECT p_partkey AS page_id, 'https://www.regeringen.se/contentassets/x/' || {filled_sql(file, n='p_partkey')} AS url, '{name}' AS organization, '{file_kind or 'other'}' AS file_kind FROM part WHERE p_partkey % 3 = {kind}")
    return " UNION ALL ".join(out)


@query(" UNION ALL ".join(_answer_rows(k) for k in range(3)))
def t13_answers(spark, d):
    """All answers of three kinds of pages: in a list, twenty levels deep, and behind end tags that close nothing."""
    n = F.col("p_partkey")
    pages = S.spread(S.load(spark, d, "part")).select(n.alias("page_id"), one_of(n, [filled(html, n=n) for html, _ in _ANSWER_PAGES]).alias("html"))
    return H.parse_consultation_page(pages, H.page_tokens(pages))[1].select("page_id", "url", "organization", "file_kind")


@query("SELECT p_partkey AS page_id, p_partkey AS doc_id, 'SOU 2024:' || p_partkey AS number FROM part WHERE p_size > 10")
def t14_discover_listings(spark, d):
    known = case_documents(spark, d).join(S.load(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("doc_id")), "doc_id", "left_semi")
    return H.discover_listings(H.page_tokens(case_pages(spark, d)), known)[0].select("page_id", "doc_id", "number")


@query("SELECT p_partkey AS page_id, p_partkey % 5 = 4 AS repeated FROM part")
def t14_repeated_pages(spark, d):
    """Listings of five pages each, the last of which repeats the one before."""
    n = F.col("p_partkey")
    part = S.spread(S.load(spark, d, "part"))
    pages = part.select(n.alias("page_id"), filled('<a href="/x/{n}">A</a>', n=F.when(n % 5 == 4, n - 1).otherwise(n)).alias("html"))
    listing = part.select(n.alias("page_id"), F.floor(n / 5).alias("listing"), (n % 5).alias("number"))
    return H.repeated_pages(H.page_tokens(pages), listing).select("page_id", "repeated")


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 'https://www.regeringen.se/remisser/ref/' || p_partkey ELSE 'https://www.regeringen.se/remisser/2024/05/' || p_partkey END AS url, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 3 END AS priority, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 13 END AS points FROM part""")
def t15_find_consultation_link(spark, d):
    docs, n = case_documents(spark, d), F.col("doc_id")
    refs = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("https://www.regeringen.se/remisser/ref/"), n).alias("target_url"), F.lit("x").alias("target_number"))
    return H.find_consultation_link(docs, refs, H.page_tokens(case_pages(spark, d)).withColumnRenamed("page_id", "doc_id"))


@query("SELECT p_partkey AS page_id, 'Fi 2024:' || p_size AS code, p_name AS title, 'fi-2024-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS process_key, 'https://www.regeringen.se/kommittedirektiv/2024/01/dir-' || p_partkey AS url FROM part")
def t16_parse_inquiries(spark, d):
    n, part = F.col("p_partkey"), S.spread(S.load(spark, d, "part"))
    html = filled('<ul><li><h3>Fi 2024:{s} {t}</h3><a href="/kommittedirektiv/2024/01/dir-{n}">Direktiv</a></li><li>Ju 2024:04 utan</li></ul>', s=F.col("p_size"), t=F.col("p_name"), n=n)
    return H.parse_inquiries(H.page_tokens(part.select(n.alias("page_id"), html.alias("html")))).select("page_id", "code", "title", "process_key", "url")


@query("SELECT p_partkey AS page_id, unnest(['sarskild_utredare', 'sekreterare', 'bitradande_sekreterare_x']) AS role, unnest([p_name, p_brand, p_type]) AS name FROM part".replace("'bitradande_sekreterare_x'", "'sekreterare'"))
def t17_parse_contacts(spark, d):
    html = filled("Särskild utredare: {a}<br>Sekreterare: {b}<br/>Biträdande sekreterare: {c}<br>Webb: http://x<br>ingen", a=F.col("p_name"), b=F.col("p_brand"), c=F.col("p_type"))
    return H.parse_contacts(S.spread(S.load(spark, d, "part")).select(F.col("p_partkey").alias("page_id"), html.alias("html"))).select("page_id", "role", "name")


@query("SELECT p_partkey AS page_id, 'sou' AS doc_type, 'SOU 2024:' || p_partkey AS doc_number, 'Remiss av SOU 2024:' || p_partkey AS title, 'Finansdepartementet' AS ministry, '2025-04-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS published FROM part")
def t18_detect_document(spark, d):
    pages = case_pages(spark, d)
    out = H.detect_document(pages, H.page_tokens(pages), ["Justitiedepartementet", "Finansdepartementet"])
    return out.withColumn("published", F.col("published.date").cast("string"))


@query("""WITH t AS (SELECT doc_id, text || repeat(' x', 40001) AS s FROM documents)
  SELECT doc_id, CASE WHEN s IS NULL THEN 'full_text' WHEN doc_id % 3 = 0 THEN 'full_text_truncated' WHEN doc_id % 3 = 1 THEN 'first_80k' ELSE 'sammanfattning_with_toc' END AS strategy,
  sha1(CASE WHEN s IS NULL THEN '' WHEN doc_id % 3 = 2 THEN '[SAMMANFATTNING]' || chr(10) || trim(repeat('Lång sammanfattning. ', 60)) ELSE substr(s, 1, 80000) END) AS part FROM t""")
def t20_key_sections(spark, d):
    """Long texts: laws, committee reports, and reports with a summary before the text."""
    docs, n = S.load(spark, d, "documents"), F.col("doc_id")
    long = F.concat("text", F.repeat(F.lit(" x"), F.lit(40_001)))
    report = F.concat(F.lit("Sammanfattning\n" + "Lång sammanfattning. " * 60 + "\nSummary\n"), F.regexp_replace(long, "(?i)(sammanfattning|innehåll)", "y"))
    rows = docs.select("doc_id", one_of(n, ["law", "bet", "sou"]).alias("doc_type"), F.when(n % 3 == 2, report).otherwise(long).alias("raw_content"))
    return H.key_sections(rows).select("doc_id", "strategy", F.sha1("text").alias("part"))


@query("SELECT p_partkey AS id, 'Sammanfattning' || chr(10) || 'Vi säger ' || p_name || '.' AS head, true AS rest FROM part")
def t21_stance_excerpt(spark, d):
    text = filled("Hej\nSammanfattning\nVi säger {n}.\n1. Bakgrund\nMer om {b}.", n=F.col("p_name"), b=F.col("p_brand"))
    out = H.stance_excerpt(S.load(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), filled("Mer om {b}.", b=F.col("p_brand")).alias("more")))
    rest = S.load(spark, d, "part").select(F.col("p_partkey").alias("id"), filled("Mer om {b}.", b=F.col("p_brand")).alias("more"))
    head = F.array_join(F.slice(F.split("excerpt", "\n"), 1, 2), "\n")
    return out.join(rest, "id").select("id", head.alias("head"), F.contains("excerpt", "more").alias("rest"))


_PEOPLE = [("{n}", "no_space"), ("Ann {n}", "ok"), ("[x] {n}", "brackets"), ("Statsrådet {n}", "title_only"), ("ab", "too_short")]


@query(f"SELECT c_custkey AS id, {one_of_sql('c_custkey', quoted([x[1] for x in _PEOPLE]))} AS reason, substr(repeat('e', 600), 1, 500) AS excerpt, 1 AS page FROM customer")
def t24_validate_extracted(spark, d):
    n = F.col("c_custkey")
    rows = S.load(spark, d, "customer").select(n.alias("id"), one_of(n, [filled(x[0], n=F.col("c_name")) for x in _PEOPLE]).alias("name"), F.lit("sou").alias("doc_type"), F.lit("e" * 600).alias("excerpt"), F.lit(None).cast("int").alias("page"))
    return H.validate_extracted(rows).select("id", "reason", "excerpt", "page")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS summary_text, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'unknown' END AS outcome, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END AS keywords, o_orderstatus <> 'P' AS valid FROM orders""")
def t25_load_summaries(spark, d):
    """Summaries of orders, those in progress as broken JSON."""
    status = F.col("o_orderstatus")
    body = F.to_json(F.struct(F.col("o_orderpriority").alias("summary_text"), F.when(status == "F", "approved").otherwise("odd").alias("outcome"), F.array(F.lit("a"), status).alias("keywords")))
    rows = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(status == "P", "no json").otherwise(body).alias("json"))
    return H.load_summaries(rows).select("doc_id", "summary_text", "outcome", F.size("keywords").alias("keywords"), "valid")


@query("SELECT l_orderkey AS doc_id, l_returnflag AS event_type, CAST(CASE WHEN l_linenumber % 2 = 0 THEN date_trunc('month', CAST(l_shipdate AS DATE)) ELSE CAST(l_shipdate AS DATE) END AS DATE)::VARCHAR AS event_date, CASE WHEN l_linestatus = 'F' THEN 'high' ELSE 'medium' END AS confidence FROM lineitem")
def t25_load_events(spark, d):
    """An order's lines as events, each second one with a month only."""
    form = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    event = F.struct(F.col("l_returnflag").alias("event_type"), form.alias("event_date"), F.when(F.col("l_linestatus") == "F", "high").alias("confidence"))
    rows = S.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.to_json(F.collect_list(event)).alias("json"))
    return dated(H.load_events(rows).select("doc_id", "event_type", "event_date", "confidence"), "event_date")


# --- names: customers answer and are invited under the name of their segment's board in their nation ---
_DRESS = ["{n}", "Bilaga {n}", "{n}.pdf", "{n} (pdf 140 kB)", "Yttrande från {n}"]
_ORG = """cu AS (SELECT c_custkey, 'Nämnden ' || c_mktsegment || ' ' || n_name AS org FROM customer JOIN nation ON n_nationkey = c_nationkey), en AS (SELECT org, min(c_custkey) AS k FROM cu GROUP BY 1),
  an AS (SELECT o_orderkey AS id, org, k FROM orders JOIN cu ON c_custkey = o_custkey JOIN en USING (org))"""


def boards(spark, d) -> DataFrame:
    nation = S.load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return S.load(spark, d, "customer").join(nation, "c_nationkey").select("c_custkey", F.concat(F.lit("Nämnden "), "c_mktsegment", F.lit(" "), "n_name").alias("name"))


def organisations(spark, d) -> DataFrame:
    """The boards as entities under their least customer's number; those whose number four divides are missing."""
    return boards(spark, d).groupBy(F.col("name").alias("entity_name")).agg(F.min("c_custkey").alias("entity_id")).where("entity_id % 4 <> 0").select("entity_id", "entity_name")


def answers(spark, d) -> DataFrame:
    """Answers: an order's board under a dressed-up name; those of every seventh order are linked already."""
    n = F.col("o_orderkey")
    rows = S.load(spark, d, "orders").select("o_orderkey", "o_custkey").join(boards(spark, d).withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    name = one_of(n, [filled(x, n=F.col("name")) for x in _DRESS])
    return rows.select(n.alias("id"), name.alias("responding_organization"), F.when(n % 7 == 0, F.lit(-1)).cast("long").alias("entity_id"), F.lit(None).cast("string").alias("match_confidence"))


@query(f"WITH {_ORG} SELECT id, org AS name FROM an")
def e01_normalize_org(spark, d):
    return E.with_normal_names(answers(spark, d).select("id", "responding_organization"), "responding_organization", "name").select("id", "name")


_LINES = [("{n}", False), ("Sida 3", True), ("info@x.se", True), ("Regeringskansliet", True), ("www.{n}.se", True), ("Remissvaren ska ha kommit in", True), ("Kalmar kommun", False)]


@query(f"SELECT c_custkey AS id, {one_of_sql('c_custkey', [str(x[1]) for x in _LINES])} AS boilerplate FROM customer")
def e02_is_boilerplate(spark, d):
    n = F.col("c_custkey")
    return S.load(spark, d, "customer").select(n.alias("id"), E.is_boilerplate(one_of(n, [filled(x[0], n=F.col("c_name")) for x in _LINES])).alias("boilerplate"))


@query("SELECT 'x' || c_custkey AS name, c_custkey AS entity_id FROM customer WHERE c_custkey < 10000 AND length('x' || c_custkey) <= 5")
def e04_match_abbreviation(spark, d):
    """Customers with an abbreviation of theirs in brackets."""
    rows = S.load(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("x"), "c_custkey").alias("name"))
    entities = rows.select("entity_id", F.concat(F.lit("Verket för ärende ("), F.upper("name"), F.lit(")")).alias("entity_name"))
    return E.match_abbreviation(rows.select("name"), entities).select("name", "entity_id")


@query("SELECT 'Svenska kund' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name, c_custkey AS entity_id FROM customer")
def e05_match_stem(spark, d):
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    rows = S.load(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("Svenska kund"), key).alias("name"), F.concat(F.lit("Kund"), key, F.lit("föreningen")).alias("entity_name"))
    return E.match_stem(rows.select("name"), rows.select("entity_id", "entity_name")).select("name", "entity_id")


_ALIASES = ", ".join("('" + a.upper() + "', '" + t.lower() + "')" for a, t in rules.ABBREVIATIONS.items())


def cascade_sql(names: str, entities: str) -> str:
    """CTEs up to r (name, entity_id, matched_name, confidence, score): names (n) through exact, abbreviation, stem and fuzzy
    matching among entities (e, k), all with all."""
    folded = "lower(trim(regexp_replace(regexp_replace({n}, '-', ' ', 'g'), '\\s+', ' ', 'g')))"
    town = "trim(regexp_replace(regexp_replace({n}, '\\bstad\\b', 'kommun', 'gi'), '\\s+', ' ', 'g'))"
    grams = lambda c: f"list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"
    ratio = "least(length(x.f), length(y.f)) / greatest(length(x.f), length(y.f))"
    stem = "lower(e)"
    for ending in rules.ORG_ENDINGS:
        stem = f"trim(regexp_replace({stem}, '{ending}$', ''))"
    forms = lambda n: f"(VALUES ({folded.format(n=n)}), ({folded.format(n=town.format(n=n))})) t(f)"
    return f"""nm AS ({names}), ents AS ({entities}), al AS (SELECT * FROM (VALUES {_ALIASES}) AS t(a, t)),
  st AS (SELECT e, k, {stem} AS stem FROM ents), pt AS (SELECT n, regexp_replace(regexp_replace(lower(n), '^svenska?\\s+', ''), '^sveriges\\s+', '') AS part FROM nm WHERE length(n) > 5),
  c AS (SELECT n, k, e, 1 AS step, 1.0 AS s FROM nm JOIN ents ON lower(n) = lower(e) UNION ALL SELECT n, k, e, 2, 1.0 FROM nm JOIN ents ON regexp_replace(lower(n), '[ -]', '', 'g') = regexp_replace(lower(e), '[ -]', '', 'g')
    UNION ALL SELECT n, k, e, 5, 1.0 FROM nm JOIN al ON a = upper(regexp_extract(n, '^[^ -]*')) JOIN ents ON contains(lower(e), t) WHERE length(n) > 5
    UNION ALL SELECT n, k, e, 6, 1.0 FROM nm JOIN al ON length(a) >= 3 AND contains(upper(n), a) JOIN ents ON contains(upper(e), a) WHERE length(n) > 5
    UNION ALL SELECT n, k, e, 7, 0.95 FROM pt JOIN st ON length(part) >= 6 AND contains(stem, part)),
  d AS (SELECT n, arg_min(k, (step, k)) AS k, arg_min(e, (step, k)) AS e, CAST(arg_min(s, (step, k)) AS DOUBLE) AS s FROM c GROUP BY 1),
  fa AS (SELECT n, f, {grams('f')} AS g FROM nm, LATERAL (SELECT DISTINCT f FROM {forms('n')})), fb AS (SELECT e, k, f, {grams('f')} AS g FROM ents, LATERAL (SELECT DISTINCT f FROM {forms('e')})),
  z AS (SELECT x.n, y.e, y.k, CASE WHEN x.f = y.f THEN 1.0::DOUBLE WHEN (contains(x.f, y.f) OR contains(y.f, x.f)) AND {ratio} >= 0.5 THEN 0.8::DOUBLE + 0.2::DOUBLE * ({ratio}) ELSE len(list_intersect(x.g, y.g)) * 2 / (len(x.g) + len(y.g)) END AS score
    FROM fa x, fb y WHERE x.n NOT IN (SELECT n FROM d)),
  f AS (SELECT n, arg_max(e, (score, -length(e), reverse(e))) AS e, max(score) AS score FROM z WHERE score >= 0.5 GROUP BY 1),
  r AS (SELECT nm.n AS name, coalesce(d.k, fe.k) AS entity_id, coalesce(d.e, f.e) AS matched_name, CASE WHEN d.n IS NOT NULL OR f.score >= 0.9 THEN 'high' WHEN f.score >= 0.7 THEN 'medium' WHEN f.score >= 0.5 THEN 'low' ELSE 'unmatched' END AS confidence, coalesce(d.s, f.score, 0) AS score
    FROM nm LEFT JOIN d ON d.n = nm.n LEFT JOIN f ON f.n = nm.n LEFT JOIN ents fe ON fe.e = f.e)"""


#: All answers with the match of their name; every seventh is linked already and is not looked at.
_MATCHED = _ORG + ", " + cascade_sql("SELECT DISTINCT lower(org) AS n FROM an", "SELECT org AS e, k FROM en WHERE k % 4 <> 0")
_LINKED = "SELECT id, org, CASE WHEN id % 7 = 0 THEN -1 WHEN confidence = 'high' THEN r.entity_id END AS entity_id, CASE WHEN id % 7 <> 0 THEN confidence END AS match_confidence, CASE WHEN id % 7 <> 0 THEN matched_name END AS matched_name FROM an JOIN r ON r.name = lower(org)"


@query(f"WITH {_MATCHED} SELECT id, entity_id, match_confidence, matched_name FROM ({_LINKED})")
def e09_link_responses(spark, d):
    """All answers: links, suggestions, and those that were linked before; some boards are no entity."""
    return E.link_responses(answers(spark, d), organisations(spark, d)).select("id", "entity_id", "match_confidence", "matched_name")


@query(f"WITH {_MATCHED} SELECT match_confidence, count(*) AS n FROM ({_LINKED}) GROUP BY 1")
def e09_link_report(spark, d):
    return E.link_report(E.link_responses(answers(spark, d), organisations(spark, d)))[0]


_FEW = "SELECT s_name AS e, s_suppkey AS k FROM supplier"


def few_entities(spark, d) -> DataFrame:
    """Suppliers as entities: their names are like no board's."""
    return S.load(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name"))


@query(f"WITH {_ORG}, {cascade_sql('SELECT DISTINCT lower(org) AS n FROM an', _FEW)} SELECT org AS responding_organization, count(*) AS n FROM an JOIN r ON r.name = lower(org) WHERE id % 7 <> 0 AND confidence = 'unmatched' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def e09_unmatched_names(spark, d):
    """The names that most often match nothing, among suppliers."""
    return E.link_report(E.link_responses(answers(spark, d), few_entities(spark, d)))[1]


@query(f"WITH {_ORG}, {cascade_sql('SELECT DISTINCT lower(org) AS n FROM an', _FEW)} SELECT id, CASE WHEN id % 7 = 0 THEN 'before' WHEN confidence = 'high' THEN 'known' WHEN confidence = 'unmatched' THEN 'created' ELSE 'none' END AS entity, CASE WHEN id % 7 <> 0 AND confidence = 'unmatched' THEN org END AS entity_name FROM an JOIN r ON r.name = lower(org)")
def e09_create_entities(spark, d):
    """The same with an entity made for each name that matches nothing."""
    few = written(few_entities(spark, d), "few")
    rows, known = E.create_unmatched(E.link_responses(answers(spark, d), few), few)
    named = rows.join(known.join(few.select("entity_id"), "entity_id", "left_anti").select("entity_id", "entity_name"), "entity_id", "left")
    kind = F.when(F.col("entity_name").isNotNull(), "created").when(F.col("entity_id") == -1, "before").when(F.col("entity_id").isNotNull(), "known").otherwise("none")
    return named.select("id", kind.alias("entity"), "entity_name")


@query(f"WITH {_MATCHED} SELECT id, CASE WHEN r.confidence = 'high' THEN r.entity_id END AS entity_id, r.confidence AS match_confidence, r.matched_name FROM an JOIN r ON r.name = lower(org)")
def e10_link_invitees(spark, d):
    """All invitations anew, under another column of names, those with a link too."""
    rows = answers(spark, d).withColumnRenamed("responding_organization", "organization_name")
    out = E.link_responses(rows, organisations(spark, d), "organization_name", mode="all", force=True)
    return out.select("id", "entity_id", "match_confidence", "matched_name")


#: Decisions: rules approve entity 7, models reject or approve 8, people reject at first and then approve 9, or the other way round.
_LOGGED = """g AS (SELECT o_orderkey AS id, 'rule' AS source, 30 AS decided_at, 'approve' AS action, 7 AS entity_id FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'model', 20, CASE WHEN o_orderkey % 2 = 0 THEN 'reject' ELSE 'approve' END, 8 FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 'person', 1, 'reject', NULL FROM orders WHERE o_orderkey % 11 < 3 UNION ALL SELECT o_orderkey, 'person', 2, 'approve', 9 FROM orders WHERE o_orderkey % 11 IN (1, 4)
  UNION ALL SELECT o_orderkey, 'person', 1, 'reject', NULL FROM orders WHERE o_orderkey % 11 = 4),
  b AS (SELECT DISTINCT ON (id) * FROM g ORDER BY id, CASE source WHEN 'person' THEN 0 WHEN 'model' THEN 1 ELSE 2 END, decided_at DESC)"""


def decision_log(spark, d) -> DataFrame:
    n, rows = F.col("o_orderkey"), S.load(spark, d, "orders").select("o_orderkey")
    said = lambda df, source, at, action, entity: df.select(n.alias("id"), F.lit(source).alias("source"), F.lit(at).alias("decided_at"), action.alias("action"), F.lit(entity).cast("long").alias("entity_id"))
    no, yes = F.lit("reject"), F.lit("approve")
    parts = (
        said(rows.where(n % 3 == 0), "rule", 30, yes, 7), said(rows.where(n % 5 == 0), "model", 20, F.when(n % 2 == 0, "reject").otherwise("approve"), 8),
        said(rows.where(n % 11 < 3), "person", 1, no, None), said(rows.where((n % 11).isin(1, 4)), "person", 2, yes, 9), said(rows.where(n % 11 == 4), "person", 1, no, None),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@query(f"WITH {_LOGGED} SELECT id, source, action, CASE WHEN action = 'approve' THEN entity_id END AS decided_entity FROM b")
def e14_standing_decisions(spark, d):
    return E.standing_decisions(decision_log(spark, d))


@query(f"""WITH {_MATCHED}, {_LOGGED} SELECT an.id, CASE WHEN b.action = 'approve' THEN b.entity_id WHEN b.action = 'reject' THEN NULL WHEN an.id % 7 = 0 THEN -1 WHEN r.confidence = 'high' THEN r.entity_id END AS entity_id,
  CASE WHEN b.action = 'approve' THEN 'high' WHEN b.action = 'reject' THEN 'rejected' WHEN an.id % 7 <> 0 THEN r.confidence END AS match_confidence, b.source AS decided_by FROM an JOIN r ON r.name = lower(org) LEFT JOIN b ON b.id = an.id""")
def e14_relink(spark, d):
    """Two passes, the second over the first's own rows and in another mode: what was decided stands, rejections too."""
    known, log = written(organisations(spark, d), "organisations"), written(decision_log(spark, d), "log")
    rows = written(E.relink(answers(spark, d), known, log)[0], "pass")
    return E.relink(rows, known, log, mode="unmatched_and_rejected")[0].select("id", "entity_id", "match_confidence", "decided_by")


@query(f"WITH {_ORG} SELECT lower(org) AS name_lower, count(*) AS occurrences FROM an WHERE k % 4 = 0 AND id % 5 <> 1 GROUP BY 1 HAVING count(*) >= 2")
def e11_bootstrap_entities(spark, d):
    """Names that no entity has; those behind "Bilaga" count as boilerplate."""
    rows = answers(spark, d).select(F.col("responding_organization").alias("name"), F.col("id").alias("seen_at"))
    lists = S.load(spark, d, "nation").select(F.lower("n_name").alias("name_lower"), F.lit("block").alias("rule_type"))
    return E.bootstrap_entities(rows, organisations(spark, d), lists, min_occurrences=2)[0].select("name_lower", "occurrences")


_BANDS = ["high", "low", None, "medium", "unmatched"]


def judged(spark, d) -> DataFrame:
    n = F.col("o_orderkey")
    return S.load(spark, d, "orders").select(n.alias("id"), F.when(n % 3 == 0, F.col("o_custkey")).alias("entity_id"), one_of(n, [F.lit(b).cast("string") for b in _BANDS]).alias("match_confidence"))


_JUDGED = f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS entity_id, {one_of_sql('o_orderkey', quoted(_BANDS))} AS match_confidence FROM orders"


@query(f"SELECT * FROM ({_JUDGED}) WHERE entity_id IS NULL AND (match_confidence IS NULL OR match_confidence <> 'high') ORDER BY match_confidence NULLS FIRST, id LIMIT 100")
def e13_review_queue(spark, d):
    return E.review_queue(judged(spark, d))


@query(f"SELECT coalesce(match_confidence, 'none') AS confidence, count(*) AS n FROM ({_JUDGED}) WHERE entity_id IS NULL GROUP BY 1")
def e13_review_counts(spark, d):
    return E.review_counts(judged(spark, d))


@query(f"""SELECT id, CASE WHEN id % 10 = 1 THEN id WHEN id % 10 = 2 THEN NULL ELSE entity_id END AS entity_id, CASE WHEN id % 10 = 1 THEN 'high' WHEN id % 10 = 2 THEN 'rejected' WHEN id % 10 = 4 THEN 'high' ELSE match_confidence END AS match_confidence, id % 10 = 4 AS created FROM ({_JUDGED})
  WHERE id % 10 <> 4 UNION ALL SELECT id, NULL, 'high', true FROM ({_JUDGED}) WHERE id % 10 = 4""")
def e14_apply_decisions(spark, d):
    """Approved, rejected and created entities, with numbers as ids; the id of a created one is shown as null here."""
    rows, n = judged(spark, d), F.col("id")
    decisions = rows.where("id % 10 in (1, 2, 4)").select("id", F.when(n % 10 == 1, "approve").when(n % 10 == 2, "reject").otherwise("create").alias("action"), n.alias("entity_id"), F.concat(F.lit("Ny "), n).alias("new_name"))
    out, entities = E.apply_decisions(rows, organisations(spark, d), decisions)
    new = entities.where("entity_name like 'Ny %'").select(F.col("entity_id").alias("_new"), F.substring("entity_name", 4, 20).try_cast("long").alias("_id"))
    both = out.join(new, (F.col("entity_id") == F.col("_new")) & (F.col("id") == F.col("_id")), "left")
    return both.select("id", F.when(F.col("_new").isNull(), F.col("entity_id")).alias("entity_id"), "match_confidence", F.col("_new").isNotNull().alias("created"))


_ROLES = ["lead", "secretary", "mentioned"]


@query(f"""WITH p AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN s_name ELSE c_name END AS name, s_suppkey, {one_of_sql('c_custkey', [f"'{x}'" for x in _ROLES])} AS relation_type FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey // 4 + 1)
  SELECT doc_id, name AS entity_name, relation_type, CASE WHEN c.s_suppkey IS NOT NULL THEN c.s_suppkey END AS known_id FROM p LEFT JOIN (SELECT s_name, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) c ON c.s_name = p.name WHERE name IS NOT NULL""")
def e15_upsert_extracted(spark, d):
    """Relations of extracted people with their entities: every fourth is a supplier, known under a number; the number of a new entity is shown as null."""
    n = F.col("c_custkey")
    known = S.load(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.lit("person").alias("entity_type"), F.col("s_name").alias("entity_name"))
    rows = S.load(spark, d, "customer").join(known.select((F.col("entity_id") * 4 - 4).alias("_k"), F.col("entity_name").alias("_s")), (n >= F.col("_k")) & (n < F.col("_k") + 4) & (F.floor(n / 4) * 4 == F.col("_k")), "left")
    people = rows.select(n.alias("doc_id"), F.lit("sou").alias("doc_type"), F.when(n % 4 == 0, F.col("_s")).otherwise(F.col("c_name")).alias("name"), F.lit("person").alias("entity_type"), one_of(n, ["Särskild utredare", "huvudsekreterare", "expert"]).alias("role")).where("name is not null")
    none = people.select(F.lit(0).cast("long").alias("entity_id"), "doc_id", F.lit("mentioned").alias("relation_type")).where("false")
    entities, relations, _ = E.upsert_extracted(people, known, none)
    named = relations.join(entities.select("entity_id", "entity_name"), "entity_id")
    return named.join(known.select(F.col("entity_id").alias("known_id")), F.col("entity_id") == F.col("known_id"), "left").select("doc_id", "entity_name", "relation_type", "known_id")


# --- references: parts cite each other by number ---
def number_documents(spark, d) -> DataFrame:
    """Documents SOU 2024:size, one for each size of a part."""
    return S.load(spark, d, "part").groupBy("p_size").agg(F.min("p_partkey").alias("doc_id")).where("p_size <= 40").select("doc_id", F.concat(F.lit("SOU 2024:"), "p_size").alias("doc_number"))


def number_references(spark, d) -> DataFrame:
    n = F.col("p_partkey")
    return S.load(spark, d, "part").select(n.alias("ref_id"), n.alias("source_id"), numbered(n, F.col("p_size")).alias("target_number"))


_RESOLVED = f"""SELECT p_partkey AS ref_id, m AS target_id, CASE WHEN m IS NOT NULL THEN 'resolved' WHEN p_partkey % 8 = 7 THEN 'extraction_failed' ELSE 'no_match' END AS outcome,
  CASE WHEN m IS NOT NULL AND p_partkey % 8 = 0 THEN 'direct_match' ELSE {one_of_sql('p_partkey', quoted([x[2] for x in _NUMBERS]))} END AS evidence
  FROM part LEFT JOIN (SELECT p_size s, min(p_partkey) m FROM part WHERE p_size <= 40 GROUP BY 1) ON s = p_size AND p_partkey % 8 < 2"""


@query(_RESOLVED)
def g01_resolve_references(spark, d):
    return G.resolve_references(number_references(spark, d), number_documents(spark, d)).select("ref_id", "target_id", "outcome", "evidence")


@query(f"SELECT outcome, coalesce(evidence, 'none') AS evidence, count(*) AS n FROM ({_RESOLVED}) GROUP BY 1, 2")
def g02_resolution_stats(spark, d):
    return G.resolution_stats(G.resolve_references(number_references(spark, d), number_documents(spark, d)))


@query("""SELECT l_orderkey AS source_id, l_partkey AS target_id, max(l_discount * 10) AS confidence_score, 'references' AS relationship_type, CASE WHEN max(l_discount * 10) >= 0.7 THEN 'high' ELSE 'medium' END AS confidence_class FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey <> l_partkey GROUP BY 1, 2""")
def g04_title_relationships(spark, d):
    """Lines as title matches: a line's discount is the similarity, returned lines have no target."""
    rows = S.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("target_id"), (F.col("l_discount") * 10).alias("similarity"))
    return G.title_relationships(rows)


@query("""WITH o AS (SELECT p_partkey k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)), g AS (SELECT k FROM o WHERE k % 3 = 0 OR k % 5 = 0)
  SELECT (SELECT count(*) FROM o) AS before, (SELECT count(*) FROM o) - (SELECT count(*) FROM g) AS after, CAST(floor((SELECT count(*) FROM g) * 100 / (SELECT count(*) FROM o) + 0.5) AS BIGINT) AS reduction""")
def g10_linkage_manifest(spark, d):
    used = S.load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("doc_id"))
    free = G.orphans(S.load(spark, d, "part").select(F.col("p_partkey").alias("doc_id")), used)
    return G.linkage_manifest(free, free.where("doc_id % 3 = 0"), free.where("doc_id % 5 = 0"))


_KINDS = ["directive", "sou", "remiss", "prop", "law", "other"]
_HAPPENED = ["directive_issued", "sou_published", "remiss_end", "proposition_submitted", "law_enacted", "other"]


def process_rows(spark, d):
    """Customers as processes: their orders are documents by priority and events by month."""
    o = S.load(spark, d, "orders")
    kind = one_of(F.substring("o_orderpriority", 1, 1).cast("int"), _KINDS)
    docs = o.select(F.col("o_custkey").alias("process_id"), F.col("o_orderkey").alias("doc_id"), kind.alias("doc_type"))
    events = o.select(F.col("o_custkey").alias("process_id"), one_of(F.month("o_orderdate"), _HAPPENED).alias("event_type"), F.to_date("o_orderdate").alias("event_date"))
    processes = S.load(spark, d, "customer").select(F.col("c_custkey").alias("process_id"), one_of(F.col("c_custkey"), list(C.ORDER)).alias("current_stage"))
    return processes, docs, events


_EV = f"""x AS (SELECT o_custkey p, {one_of_sql('CAST(substr(o_orderpriority, 1, 1) AS BIGINT)', quoted(_KINDS))} k, {one_of_sql('month(o_orderdate)', quoted(_HAPPENED))} e FROM orders),
  v AS (SELECT c_custkey AS process_id, coalesce(bool_or(k = 'directive'), false) d1, coalesce(bool_or(k = 'sou'), false) d2, coalesce(bool_or(k = 'remiss'), false) d3, coalesce(bool_or(k = 'prop'), false) d4, coalesce(bool_or(k = 'law'), false) d5,
    coalesce(bool_or(e = 'directive_issued'), false) e1, coalesce(bool_or(e = 'sou_published'), false) e2, coalesce(bool_or(e = 'remiss_end'), false) e3, coalesce(bool_or(e = 'proposition_submitted'), false) e4, coalesce(bool_or(e = 'law_enacted'), false) e5 FROM customer LEFT JOIN x ON p = c_custkey GROUP BY 1),
  st AS (SELECT process_id, CASE WHEN d5 OR e5 THEN 'enacted' WHEN d4 OR e4 THEN 'proposition' WHEN d3 OR e3 THEN 'remiss' WHEN d2 AND e2 THEN 'published' WHEN d1 OR e1 THEN 'directive_issued' ELSE 'directive' END AS stage, {one_of_sql('process_id', quoted(list(C.ORDER)))} AS current_stage FROM v),
  rk AS (SELECT *, list_position([{', '.join(quoted(list(C.ORDER)))}], stage) n, list_position([{', '.join(quoted(list(C.ORDER)))}], current_stage) o FROM st)"""


@query(f"WITH {_EV} SELECT process_id, d1 AS has_directive, d2 AS has_sou, d3 AS has_remiss, d4 AS has_proposition, d5 AS has_law, e1 AS event_directive_issued, e2 AS event_sou_published, e3 AS event_remiss, e4 AS event_proposition_submitted, e5 AS event_law_enacted FROM v")
def g11_process_evidence(spark, d):
    return C.evidence(*process_rows(spark, d)).drop("current_stage", "sou_date")


@query(f"WITH {_EV} SELECT process_id, stage FROM st")
def g12_process_stage(spark, d):
    return C.stage(C.evidence(*process_rows(spark, d))).select("process_id", "stage")


@query(f"WITH {_EV} SELECT process_id, n = o AS match, n >= o AS valid_transition FROM rk")
def g13_verify_stages(spark, d):
    return C.verify_stages(C.stage(C.evidence(*process_rows(spark, d)))).select("process_id", "match", "valid_transition")


@query(f"WITH {_EV} SELECT count(*) AS total, count(*) FILTER (n = o) AS matches, count(*) FILTER (n > o) AS forward, count(*) FILTER (n < o) AS invalid FROM rk")
def g13_verification_summary(spark, d):
    return C.verification_summary(C.verify_stages(C.stage(C.evidence(*process_rows(spark, d)))))


@query("""WITH m AS (SELECT user_id, event_type, CAST(ts AS DATE) dt, bool_or(event_id % 2 = 0) old, bool_or(event_id % 2 = 1) new FROM events GROUP BY 1, 2, 3)
  SELECT user_id AS process_id, event_type, CAST(dt AS VARCHAR) AS event_date, CASE WHEN NOT old THEN 'inserted' WHEN new THEN 'updated' ELSE 'kept' END AS action FROM m""")
def g14_merge_events(spark, d):
    rows = S.load(spark, d, "events").select(F.col("user_id").alias("process_id"), "event_type", F.to_date("ts").alias("event_date"), F.lit(None).cast("string").alias("person"), F.col("props").alias("metadata"), (F.col("event_id") % 2).alias("half"))
    return dated(C.merge_events(rows.where("half = 0").drop("half"), rows.where("half = 1").drop("half")).select("process_id", "event_type", "event_date", "action"), "event_date")


@query("""WITH k AS (SELECT p_size s, min(p_partkey) m FROM part WHERE p_size <= 40 GROUP BY 1) SELECT DISTINCT l_orderkey AS source_id, 'SOU 2024:' || p_size AS target_number, m AS target_id FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN k ON s = p_size""")
def g15_store_link_references(spark, d):
    """An order's page links to the reports that its parts' sizes number."""
    lines = S.load(spark, d, "lineitem").join(S.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    links = lines.select(F.col("l_orderkey").alias("source_id"), F.concat(F.lit("https://www.regeringen.se/x/"), "l_partkey").alias("url"), F.concat(F.lit("SOU 2024:"), "p_size").alias("anchor"))
    return G.store_link_references(links, number_documents(spark, d)).select("source_id", "target_number", "target_id")


# --- pages of one document and one process ---
@query("SELECT p_brand AS process_id, p_partkey AS doc_id, CAST(count(*) OVER (PARTITION BY p_brand) AS BIGINT) AS documents FROM part WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') ")
def m19_process_page(spark, d):
    """The documents of a brand, with their number by type summed up."""
    part = S.load(spark, d, "part")
    docs, events, types = N.process_page("Brand#11", part.select(F.col("p_brand").alias("process_id"), F.col("p_partkey").alias("doc_id")), part.select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("doc_type")), part.select(F.col("p_brand").alias("process_id"), F.lit("x").alias("event_type"), F.lit(None).cast("date").alias("event_date")))
    total = types.agg(F.sum("n").alias("documents"))
    return docs.select("process_id", "doc_id").join(F.broadcast(total))


@query("SELECT 'process' AS kind, p_brand AS name FROM part WHERE p_partkey = 7 UNION ALL SELECT 'actor', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_partkey = 7")
def m17_document_context(spark, d):
    part = S.load(spark, d, "part").select(F.col("p_brand").alias("process_id"), F.col("p_partkey").alias("doc_id"))
    links = S.load(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").cast("string").alias("name"))
    own, actors = N.document_context(7, part, part.select("process_id").distinct(), links)
    return own.select(F.lit("process").alias("kind"), F.col("process_id").alias("name")).unionByName(actors.select(F.lit("actor").alias("kind"), "name"))


# --- stances ---
_STANCES = [("Vi tillstyrker förslaget.", "support", 1, 0), ("Vi avstyrker förslaget.", "oppose", 0, 1), ("Nämnden kan inte tillstyrka förslaget.", "oppose", 0, 1), ("Vi tillstyrker delar men avstyrker andra.", "mixed", 1, 1), ("Vi skriver om annat.", "neutral", 0, 0)]
_FILL = " Detta är en text som är lång nog för att räknas och den säger annars ingenting om saken i fråga."


def stance_texts(spark, d) -> DataFrame:
    """An answer for each order: a summary that says a stance, and a body."""
    n = F.col("o_orderkey")
    text = F.concat(F.lit("Sammanfattning\n"), one_of(n, [x[0] for x in _STANCES]), F.lit(_FILL), F.when(n % 11 == 0, "\nYttrande\nVi säger mer.").otherwise(""))
    short = F.when(n % 13 == 0, "Kort.").otherwise(text)
    status = F.when(n % 17 == 0, "error").otherwise("ok")
    return S.spread(S.load(spark, d, "orders").select("o_orderkey", "o_orderdate")).select(n.alias("id"), short.alias("text"), status.alias("extraction_status"), F.lit(None).cast("string").alias("analysis_status"), F.to_date("o_orderdate").alias("created_at"))


_SAID = f"SELECT o_orderkey AS id, o_orderkey % 13 = 0 AS short, CASE WHEN o_orderkey % 13 = 0 THEN 'neutral' ELSE {one_of_sql('o_orderkey', quoted([x[1] for x in _STANCES]))} END AS stance, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE {one_of_sql('o_orderkey', [str(x[2]) for x in _STANCES])} END AS s, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE {one_of_sql('o_orderkey', [str(x[3]) for x in _STANCES])} END AS o FROM orders"


@query("SELECT o_orderkey AS id, 'summary' AS kind, 2.0::DOUBLE AS weight FROM orders WHERE o_orderkey % 13 <> 0 UNION ALL SELECT o_orderkey, 'stance', 2.0 FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, 'body', 1.0 FROM orders WHERE o_orderkey % 13 = 0")
def p01_stance_sections(spark, d):
    return P.sections(stance_texts(spark, d)).select("id", "kind", "weight")


@query(f"SELECT id, CAST(s AS INTEGER) AS support_count, CAST(o AS INTEGER) AS oppose_count FROM ({_SAID})")
def p02_count_signals(spark, d):
    counts = P.count_signals(F.col("text"))
    return stance_texts(spark, d).select("id", *(counts[c].alias(c) for c in ("support_count", "oppose_count")))


@query(f"SELECT id, stance, CASE WHEN short THEN 'skipped' ELSE 'ok' END AS analysis_status FROM ({_SAID}) WHERE id % 17 <> 0")
def p04_analyze_batch(spark, d):
    """Answers that have been analysed before: what was found then goes."""
    rows = stance_texts(spark, d).withColumns({"stance": F.lit("old"), "keywords": F.array(F.lit("old")), "word_count": F.lit(-1)})
    return P.analyze_batch(rows).select("id", "stance", "analysis_status")


def analysed(spark, d) -> DataFrame:
    """Answers with the stance that their text says, every fourth with a review."""
    n = F.col("o_orderkey")
    word = one_of(n, [F.lit(x[1]) for x in _STANCES])
    return S.load(spark, d, "orders").select(n.alias("id"), word.alias("stance"), F.array_compact(F.array(F.when(word != "neutral", word))).alias("keywords"), F.when(n % 4 == 0, '{"confidence": "low"}').alias("ai_review"), F.when(n % 4 == 0, "ai_low_confidence").otherwise("ok").alias("analysis_status"), F.to_date("o_orderdate").alias("created_at"))


_ANALYSED = f"SELECT o_orderkey AS id, {one_of_sql('o_orderkey', quoted([x[1] for x in _STANCES]))} AS stance, o_orderkey % 4 = 0 AS seen, CAST(o_orderdate AS DATE) AS created_at FROM orders"


@query(f"SELECT id, stance FROM ({_ANALYSED}) WHERE NOT seen AND stance IN ('mixed', 'neutral')")
def p05_review_candidates(spark, d):
    return P.review_candidates(analysed(spark, d)).select("id", "stance")


@query(f"SELECT count(*) FILTER (stance = 'mixed' AND NOT seen) AS mixed, count(*) FILTER (stance = 'neutral' AND NOT seen) AS neutral_without_keywords, count(*) FILTER (seen) AS reviewed FROM ({_ANALYSED})")
def p05_review_telemetry(spark, d):
    return P.review_telemetry(analysed(spark, d))


@query(f"""SELECT id, CASE WHEN id % 6 = 0 THEN 'support' WHEN id % 6 = 4 THEN 'no_position' ELSE stance END AS stance, CASE WHEN id % 6 IN (0, 4) THEN 'ai_classified' WHEN id % 6 = 2 THEN 'ai_low_confidence' WHEN seen THEN 'ai_low_confidence' ELSE 'ok' END AS analysis_status FROM ({_ANALYSED})""")
def p06_apply_labels(spark, d):
    rows, n = analysed(spark, d), F.col("id")
    labels = rows.where("id % 2 = 0").select("id", F.lit("support").alias("label"), F.when(n % 6 == 0, "high").otherwise("low").alias("confidence"), F.when(n % 6 == 4, "Ingen ståndpunkt framgår").otherwise("tydligt").alias("reason"))
    return P.apply_labels(rows, labels).select("id", "stance", "analysis_status")


@query(f"""SELECT id, CASE WHEN id % 6 = 0 THEN 'oppose' ELSE stance END AS stance, CASE WHEN id % 6 = 0 THEN 'corrected' WHEN id % 6 = 3 THEN 'confirmed' WHEN seen THEN 'ai_low_confidence' ELSE 'ok' END AS analysis_status FROM ({_ANALYSED})""")
def p07_apply_reviews(spark, d):
    rows = analysed(spark, d)
    reviews = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, "oppose").alias("decision"))
    return P.apply_reviews(rows, reviews).select("id", "stance", "analysis_status")


@query(f"SELECT 'low' AS confidence, count(*) AS n FROM ({_ANALYSED}) WHERE seen")
def p07_review_stats(spark, d):
    return P.review_stats(analysed(spark, d))


@query("""WITH e AS (SELECT DISTINCT lower(p_name) k, CASE WHEN p_size <= 25 THEN 'approved' ELSE 'rejected' END s FROM part WHERE p_partkey % 2 = 0), f AS (SELECT DISTINCT lower(p_name) k FROM part WHERE p_partkey % 2 = 1)
  SELECT k AS keyword, 'support' AS category, s AS status FROM e UNION ALL SELECT k, 'support', 'pending' FROM f WHERE k NOT IN (SELECT k FROM e WHERE s <> 'rejected')""")
def p08_keyword_suggestions(spark, d):
    part = S.load(spark, d, "part")
    old = part.where("p_partkey % 2 = 0").select(F.lower("p_name").alias("keyword"), F.lit("support").alias("category"), F.when(F.col("p_size") <= 25, "approved").otherwise("rejected").alias("status")).distinct()
    return P.keyword_suggestions(old, part.where("p_partkey % 2 = 1").select(F.upper("p_name").alias("keyword"), F.lit("support").alias("category")))


# --- search ---
@query("""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, l_discount * 10 * 0.5 + least(l_linenumber * 0.15, 0.3) + least(l_quantity * 0.02, 0.2) - least(l_tax * 100 * 0.01, 0.2) AS x FROM lineitem), s AS (SELECT id, line, greatest(0.0, least(1.0, x)) AS x FROM r)
  SELECT id, line, floor(x * 10000 + 0.5) / 10000 AS score FROM s""")
def q06_link_score(spark, d):
    c, none = F.col, F.lit(0)
    parts = Q.link_score(c("l_discount") * 10, c("l_linenumber"), c("l_quantity"), none, none, c("l_tax") * 100)
    return S.load(spark, d, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), parts["score"].alias("score"))


@query("""SELECT CASE WHEN e.vec_id IS NULL OR e.embedding IS NULL THEN 'missing' WHEN d.doc_id % 3 = 0 THEN 'wrong_dimension' ELSE 'stored' END AS outcome, count(*) AS n FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1""")
def q07_store_embeddings(spark, d):
    """Documents as summaries; every third vector lacks a component."""
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    vectors = S.load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), cut.alias("embedding"))
    return Q.store_embeddings(S.load(spark, d, "documents").select("doc_id"), vectors, 64)[1]


@query(f"WITH {_MATCHED} SELECT l.id, entity_id, match_confidence, matched_name, stance FROM ({_LINKED}) l JOIN ({_SAID}) s ON s.id = l.id")
def x01_stream_responses(spark, d):
    """Answers as a stream of two files, linked and judged batch by batch and upserted into a stored table; then the last
    batch comes again."""
    base = new_path(spark, "answers")
    rows = answers(spark, d).join(stance_texts(spark, d).select("id", "text"), "id")
    for k in (0, 1):
        rows.where(F.col("id") % 2 == k).write.parquet(f"{base}/in/{k}")
    known = written(organisations(spark, d), "organisations")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(f"{base}/in/*")
    judged = "id long, entity_id long, match_confidence string, matched_name string, stance string"
    create_table(spark.createDataFrame([], judged), f"{base}/judged", ["id"], 8)
    sink, batches = R.table_sink(f"{base}/judged", "answers"), []

    def write(df: DataFrame, number: int) -> None:
        sink(df, number)
        batches.append((number, df.limit(1)))

    R.stream_responses(stream, known, write, f"{base}/state").awaitTermination()
    sink(batches[-1][1].withColumn("stance", F.lit("again")), batches[-1][0])
    return read_table(spark, f"{base}/judged")
