"""Page jobs, API tables and model output on small fixtures."""

import json

from pyspark.sql import functions as F

from casegraph.operators import pages as G
from casegraph.sources import api as A

PAGE = """<html><body><main class="main-content"><h1>Remiss av SOU 2024:55</h1><p>Sista svarsdatum: 7 april 2025</p>
<h2>Ladda ner</h2><ul class="list--icons"><li><a href="/contentassets/x/sou-2024-55.pdf">SOU 2024:55 (pdf 3,2 MB)</a></li>
<li><a href="/contentassets/x/kortversion.pdf">Kortversion (pdf 1 MB)</a></li><li><a href="/contentassets/x/omslag.pdf">Omslag (pdf)</a></li><li><a href="/contentassets/x/bilaga.xlsx">Data</a></li></ul>
<div class="genvagar"><a href="/remisser/2024/05/x">Remiss av betänkandet</a><a href="#">x</a><a href="https://facebook.com/x">Dela</a></div>
<h3>Remissinstanser</h3><ul><li><a href="/contentassets/x/lista.pdf">Lista (pdf)</a></li></ul>
<div class="remissvar"><a href="/contentassets/x/kalmar.pdf">Kalmar kommun (pdf 522 kB)</a></div></main></body></html>"""


def test_page_jobs(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id int, html string")
    tokens = G.page_tokens(pages).cache()
    links = G.extract_links(tokens).collect()
    assert [(r["url"], r["anchor"], r["doc_kind"]) for r in links] == [("https://www.regeringen.se/remisser/2024/05/x", "Remiss av betänkandet", "remiss")]
    docs = spark.createDataFrame([(1, "sou", "SOU 2024:55")], "page_id int, doc_type string, doc_number string")
    ranked = G.score_attachments(tokens, docs).orderBy("rank").collect()
    assert ranked[0]["url"].endswith("sou-2024-55.pdf") and ranked[0]["confidence"] == 98 and "ladda_ner_context" in ranked[0]["signals"]
    assert not any("omslag" in r["url"] or "xlsx" in r["url"] for r in ranked)
    page, answers = G.parse_consultation_page(pages, tokens)
    p = page.first()
    assert p["title"] == "Remiss av SOU 2024:55" and str(p["deadline"]) == "2025-04-07" and p["invitees_url"].endswith("lista.pdf")
    assert "Kalmar kommun" in {r["organization"] for r in answers.collect()}
    known = spark.createDataFrame([("a", "SOU 2024:55")], "doc_id string, doc_number string")
    matched, orphan = G.discover_listings(tokens, known)
    assert matched.first()["doc_id"] == "a" and orphan.count() > 0
    found = G.detect_document(pages, tokens, ["Finansdepartementet"]).first()
    assert (found["doc_type"], found["doc_number"], str(found["published"]["date"])) == ("sou", "SOU 2024:55", "2025-04-07")


def test_numbered_lists(spark):
    texts = [("a", "1. Almega\n2) Kalmar kommun\n3: Vinnova\n4 – Riksarkivet\n5\nSvea hovrätt\n999. Sida\n6. Sida 3"), ("b", "Ingen lista\nalls"), ("c", None), ("d", "1. www.x.se")]
    names, counts = G.parse_numbered_list(spark.createDataFrame(texts, "id string, text string"))
    assert {r["name"] for r in names.collect()} == {"Almega", "Kalmar kommun", "Vinnova", "Riksarkivet", "Svea hovrätt"}
    assert {r["id"]: r["status"] for r in counts.collect()} == {"a": "success", "b": "no_numbered_entries", "c": "extraction_failed", "d": "extraction_failed"}


def test_contacts_and_inquiries(spark):
    blocks = spark.createDataFrame([(1, "Särskild utredare: Ann Ek<br>Sekreterare: Bo Al<br>Webb: http://x<br>ingen")], "page_id int, html string")
    assert [(r["role"], r["name"]) for r in G.parse_contacts(blocks).orderBy("line").collect()] == [("sarskild_utredare", "Ann Ek"), ("sekreterare", "Bo Al")]
    page = spark.createDataFrame([(1, '<ul><li><h3>Fi 2024:3 En utredning</h3><a href="/kommittedirektiv/2024/01/dir-2024-1">Direktiv</a></li><li>Ju 2024:04 utan</li></ul>')], "page_id int, html string")
    got = G.parse_inquiries(G.page_tokens(page)).collect()
    assert [(r["code"], r["title"], r["process_key"]) for r in got] == [("Fi 2024:3", "En utredning", "fi-2024-03")]


def test_sections(spark):
    body = "Inledning\n" * 9000
    text = "Innehåll\n1 Ett\n2 Två\n3 Tre\nSammanfattning\n" + "Kort. " * 5 + "\nSammanfattning\n" + "Lång sammanfattning. " * 60 + "\nSummary\n" + body
    got = G.key_sections(spark.createDataFrame([("a", "sou", text), ("b", "sou", "kort"), ("c", "law", "x" * 90_000)], "doc_id string, doc_type string, raw_content string"))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows["a"]["strategy"] == "sammanfattning_with_toc" and "Lång sammanfattning" in rows["a"]["text"] and "Inledning" not in rows["a"]["text"]
    assert rows["b"]["strategy"] == "full_text" and (rows["c"]["strategy"], len(rows["c"]["text"])) == ("full_text_truncated", 80_000)
    out = G.stance_excerpt(spark.createDataFrame([("a", "Hej\nSammanfattning\nVi säger ja.\n1. Bakgrund\nMer text.")], "id string, text string")).first()["excerpt"]
    assert out.startswith("Sammanfattning\nVi säger ja.") and "Mer text." in out


def test_api_tables(spark):
    listing = {"dokumentlista": {"dokument": {"dok_id": "HC031", "rm": "2024/25", "beteckning": "1", "titel": "Budget", "datum": "2024-09-19", "organ": "Fi"}}}
    row = A.ingest_listing(spark.createDataFrame([(json.dumps(listing),)], "json string"), "prop").first()
    assert (row["doc_number"], row["doc_type"], str(row["publication_date"])) == ("Prop. 2024/25:1", "proposition", "2024-09-19")
    status = lambda acts: json.dumps({"dokumentstatus": {"dokument": {"beteckning": "FiU21"}, "dokbilaga": {"bilaga": [{"filtyp": "DOC", "fil_url": "a"}, {"filtyp": "PDF", "fil_url": "b"}]}, "dokreferens": {"referens": {"referenstyp": "behandlar", "ref_dok_typ": "prop", "ref_dok_rm": "2024/25", "ref_dok_bet": "1", "ref_dok_id": "x"}}, "dokaktivitet": {"aktivitet": acts}}})
    both = [{"kod": "BES", "datum": "2024-12-01 00:00:00", "namn": None}, {"kod": "AVG", "datum": "2024-12-01", "namn": "r"}, {"kod": "UTL", "datum": "2024-11-01", "namn": "u"}]
    out = A.extract_status(spark.createDataFrame([("1", status(both)), ("2", status({"kod": "AVG", "datum": "2024-12-01", "namn": "r"}))], "dok_id string, json string"))
    assert {(r["dok_id"], r["event_type"]) for r in out["events"].collect()} == {("1", "parliament_decision"), ("1", "committee_referral"), ("2", "parliament_vote")}
    assert [(r["target_number"], r["reference_type"]) for r in out["references"].collect()][:1] == [("Prop. 2024/25:1", "recommends")]
    assert {(r["pdf_url"], r["committee"]) for r in out["facts"].collect()} == {("b", "FiU")}


def test_model_output(spark):
    rows = spark.createDataFrame([("a", '{"summary_text": "S", "outcome": "odd"}'), ("b", "nonsense")], "doc_id string, json string")
    got = {r["doc_id"]: r for r in G.load_summaries(rows).collect()}
    assert got["a"]["valid"] and got["a"]["outcome"] == "unknown" and got["a"]["keywords"] == [] and not got["b"]["valid"]
    events = G.load_events(spark.createDataFrame([("a", '[{"event_type": "x", "event_date": "2024-05"}]')], "doc_id string, json string")).first()
    assert (str(events["event_date"]), events["confidence"]) == ("2024-05-01", "medium")
    people = spark.createDataFrame([("Ann Ek", "sou"), ("Ann", "sou"), ("[x] y", "sou"), ("Statsrådet Ek", "sou"), ("Statsrådet Ek", "proposition")], "name string, doc_type string").withColumns({"excerpt": F.lit("e"), "page": F.lit(None).cast("int")})
    assert [r["reason"] for r in G.validate_extracted(people).collect()] == ["ok", "no_space", "brackets", "title_only", "ok"]


def test_sections_at_any_depth_and_stray_end_tags(spark):
    deep = '<div class="outer">' + "<div>" * 50 + '<section class="related"><ul><li><a href="/a">A</a></li></ul></section><a href="/b">B</a>' + "</div>" * 50 + '</div><a href="/c">C</a>'
    stray = '</div></div></section><div class="related"><p><a href="/d">D</a></ul></p><nav><ul><a href="/e">E</a></div><a href="/f">F</a>'
    rows = [(1, deep, "x"), (2, stray, "x"), (2, '<main class="m"><a href="/g">G</a>', "x"), (3, None, "x"), (4, "", "x"), (None, '<div class="n"/><a href="/h">H</a>', "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, section string")
    got = {r["href"]: (r["page_id"], r["section"], r["depth"], r["text"]) for r in G.page_tokens(pages).where("tag = 'a'").collect()}
    assert got == {
        "/a": (1, "related", 53, "A"), "/b": (1, "outer", 51, "B"), "/c": (1, None, 0, "C"), "/d": (2, "related", 1, "D"), "/e": (2, "related", 3, "E"), "/f": (2, None, 0, "F"),
        "/g": (2, "m", 1, "G"), "/h": (None, None, 0, "H"),
    }
    assert [r["url"] for r in G.extract_links(G.page_tokens(pages.where("page_id = 1"))).collect()] == ["https://www.regeringen.se/a"]


def test_a_number_far_down_a_page_counts(spark):
    pages = spark.createDataFrame([(1, "<h1>Om</h1><p>" + "ord " * 9000 + "SOU 2024:55</p>")], "page_id long, html string")
    assert G.detect_document(pages, G.page_tokens(pages), []).first()["doc_number"] == "SOU 2024:55"


def test_small_tables_are_dealt_over_the_cores(spark):
    """Pages made of a small file's rows are read by many tasks, and what is made of a text is made of it once."""
    from casegraph.functions import text as X
    from casegraph.plans import derived

    assert derived.case_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    got = spark.range(1).select(X.once(counted(F.lit("a")), lambda c: F.concat(c, c, c)).alias("x")).collect()
    assert got[0]["x"] == "aaa" and seen.value == 1


def test_tags_are_neither_exchanged_nor_sorted(spark):
    html = "<p>a&aring;&amp;ouml; <i>\x0bb</i> </p><h2 CLASS='x' id=1>H  <em> c</em></h2><a href=\"/u\">d</a><li>e</li>"
    tokens = G.page_tokens(spark.createDataFrame([(1, html), (1, html), (2, None), (3, "")], "page_id int, html string"))
    assert "Exchange" not in tokens._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["place"], r["tag"], r["class"], r["href"], r["text"], r["heading"]) for r in tokens.where("page_id = 1").collect())
    one = [(0, "p", "", "", "aåö b ", None), (1, "i", "", "", "b", None), (4, "h2", "x", "", "H c", None), (5, "em", "", "", "c", "H c"), (8, "a", "", "/u", "d", "H c"), (10, "li", "", "", "e", "H c")]
    assert got == [row for row in one for _ in range(2)] and tokens.where("page_id <> 1").count() == 0


def test_what_pages_make_is_not_broadcast(spark):
    """However small their file, the titles and lists of all pages are not sent to the driver, and pages are read once for both."""
    rows = [(1, '<h1>Remissinstanser</h1><h1>B</h1><a href="/contentassets/x/lista.pdf">Sändlista</a><a href="/contentassets/x/k.pdf">Kalmar</a> 2025-04-07'), (2, '<a href="/contentassets/x/k.pdf">Kalmar</a><h1>C</h1>'), (3, "<h1>D</h1>"), (3, "<h1>D</h1>"), (4, None), (None, "<h1>E</h1>")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    found, answers = G.parse_consultation_page(pages, G.page_tokens(pages))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MapInArrow ") == 1
    base = "https://www.regeringen.se/contentassets/x/"
    got = sorted((str(r["page_id"]), str(r["deadline"]), r["title"], r["invitees_url"]) for r in found.collect())
    assert got == [("1", "2025-04-07", "Remissinstanser", f"{base}lista.pdf"), ("2", "None", "C", None), ("3", "None", "D", None), ("3", "None", "D", None), ("4", "None", None, None), ("None", "None", None, None)]
    assert sorted((r["page_id"], r["url"]) for r in answers.collect()) == [(1, f"{base}k.pdf"), (2, f"{base}k.pdf")]


def test_a_listed_name_is_made_normal_in_one_place(spark):
    names = G.parse_numbered_list(spark.createDataFrame([("a", "1. Almega\n2\nBorås hamns")], "id string, text string"))[0]
    assert names._jdf.queryExecution().optimizedPlan().toString().count("AP[") == 1
    assert {r["name"] for r in names.collect()} == {"Almega", "Borås hamn"}


def test_key_sections_exchange_no_text(spark):
    long = "Sammanfattning\n" + "Kort. " * 90 + "\nSummary\n2 Sammanfattning\n" + "Lång. " * 90 + "\nSummary\nSammanfattning\n" + "Lika. " * 90 + "\n1 Början\n" + "x" * 90_000 + "\nSammanfattning\n" + "Sen. " * 900
    got = G.key_sections(spark.createDataFrame([("a", "sou", long), (None, "sou", long), ("b", None, "x" * 90_000)], "doc_id string, doc_type string, raw_content string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows["a"]["text"] == rows[None]["text"] == "[SAMMANFATTNING]\n" + ("Kort. " * 90).strip() and rows["b"]["strategy"] == "fallback_first_80k"
