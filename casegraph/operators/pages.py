"""Page jobs as relations: a table of tags with their context, and filters, windows and score sums over it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import ENTITIES, FLAGS
from ..functions.text import decode_entities, document_number, file_kind, normal_number, swedish_date
from .entities import is_boilerplate, normalize_org

BASE = "https://www.regeringen.se"
# Classes of sections, and parts of URLs that no reference has.
RELATED = r"genv[äa]g|related|shortcuts"
DOWNLOADS = r"list--icons|download|file-list"
#: Tags that make sections.
SECTIONS = ("div", "section", "aside", "ul", "ol", "main", "article", "footer", "nav")
SOCIAL = r"facebook\.com|twitter\.com|linkedin\.com|email-protection"


_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1>", re.S | re.I)
_PARTS = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)([^<]*)")
_TOKENS = "place int, tag string, class string, href string, text string, heading string, section string, depth int"


def _tags(html: str) -> Iterator[tuple[int, str, str, str, int, str | None]]:
    """The tags of a page in order: place, name, attributes, the text behind, how many sections are open, and the class of
    the innermost open one that has a class. An end tag closes the last section of its name, and those that were opened
    since and left open; one that has nothing to close counts for nothing."""
    names, classes, open_ = [], [None], Counter()
    for place, m in enumerate(_PARTS.finditer(_HIDDEN.sub(" ", html))):
        tag = m[1].lower()
        head, closed, rest = m[2].partition(">")
        if tag in SECTIONS and not head.rstrip().endswith("/"):
            found = _CLASS.search(head)
            names.append(tag)
            open_[tag] += 1
            classes.append(found[1] if found and found[1] else classes[-1])
        elif tag[0] == "/" and open_[tag[1:]]:
            while True:
                last = names.pop()
                classes.pop()
                open_[last] -= 1
                if last == tag[1:]:
                    break
        yield place, tag, head, rest if closed else "", len(names), classes[-1]


_CLASS = re.compile(r"""\bclass\s*=\s*["']([^"']*)["']""", re.I)
# as the columns' patterns are: ASCII only
_ATTRIBUTES = [re.compile(rf"""\b{name}\s*=\s*["']([^"']*)["']""", re.I | re.A) for name in ("class", "href")]
_BLANKS = re.compile(r"\s+", re.A)
_ENTITIES = [(re.compile("&amp;|&#38;"), "&"), *((re.compile("|".join(f"&{n};" for n in names)), char) for char, names in ENTITIES.items())]
_HEADS = frozenset(("h1", "h2", "h3", "h4", "strong", "b"))
_INLINE = _HEADS | {"a", "li", "button", "p", "title"}


def _decoded(text: str) -> str:
    """decode_entities of one text."""
    return reduce(lambda text, x: x[0].sub(x[1], text), _ENTITIES, text) if "&" in text else text


def _tokens(html: str) -> Iterator[tuple[int, str, str, str, str, str | None, str | None, int]]:
    """The start tags of a page in order, with class, href, text and heading. The text of an inline tag is that of its run, the
    tags up to the next inline one."""
    run, heading = [], None
    squeezed = lambda text: _BLANKS.sub(" ", text).strip(" ")
    for row in chain(_tags(html), (None,)):
        if run and (row is None or row[1] in _INLINE):
            whole = squeezed("".join(r[3] for r in run))
            for place, tag, attributes, own, depth, section in run:
                if tag[0] != "/":
                    text = whole if tag in _INLINE else squeezed(own)
                    found = [p.search(attributes) if attributes else None for p in _ATTRIBUTES]
                    yield place, tag, *(m[1] if m else "" for m in found), text, heading, section, depth
                    heading = text if tag in _HEADS else heading
            run = []
        if row is not None:
            run.append((*row[:3], _decoded(row[3]), *row[4:]))


def page_tokens(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """T0. One row for each start tag: page, place, tag, class, href, text (up to the tag's own end tag's or the next start
    tag's text), the nearest heading before it, the class of the innermost section, list or division with a class that it
    stands in, at any depth, and the depth. Pages that share an id are read each for itself.

    All of it comes from one pass over a page's text in Arrow batches: what a tag needs to know stands before it or in its
    run, so tags are neither exchanged nor sorted, and a page costs as much as it has tags. A null page has none. Batches
    are cut by rows and characters, over the pages' borders.
    """
    kind = pages.schema[key].dataType.simpleString()

    def tokens(batches):
        import pyarrow as pa

        types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
        names = [key, *(c.split()[0] for c in _TOKENS.split(", "))]

        def batch(rows, own):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (own, *types), strict=True)], names)

        for part in batches:
            rows, size, own = [], 0, part.column(0).type
            for page, html in zip(part.column(0), part.column(1), strict=True):
                page = page.as_py()
                for row in _tokens(html.as_py()):
                    rows.append((page, *row))
                    size += len(row[4])
                    if len(rows) >= 20_000 or size >= 1 << 23:
                        yield batch(rows, own)
                        rows, size = [], 0
            if rows:
                yield batch(rows, own)

    return pages.where("html is not null").select(key, "html").mapInArrow(tokens, f"`{key}` {kind}, {_TOKENS}")


def absolute(href: Column, base: str = BASE) -> Column:
    return F.when(href.rlike("^https?://"), href).otherwise(F.concat(F.lit(base), F.when(href.startswith("/"), "").otherwise("/"), href))


def extract_links(tokens: DataFrame, within: str | None = RELATED, heading: str | None = None, key: str = "page_id", base: str = BASE) -> DataFrame:
    """T5. (page, url, anchor, doc_kind) of links in sections whose class, or under headings whose text, fits; without "#",
    empty, anchor-only and social ones; the first of each URL on a page."""
    links = tokens.where("tag = 'a' and href <> '' and not startswith(href, '#')").where(~F.col("href").rlike(SOCIAL))
    fits = [F.coalesce(F.col(c).rlike(FLAGS + p), F.lit(False)) for c, p in (("section", within), ("heading", heading)) if p]
    if fits:
        links = links.where(reduce(lambda a, b: a | b, fits))
    url = absolute(F.col("href"), base)
    kind = F.when(url.rlike("/statens-offentliga-utredningar/"), "sou").when(url.rlike("/kommittedirektiv/"), "directive").when(url.rlike("/propositioner?/"), "proposition").when(url.rlike("/remisser/"), "remiss").when(url.rlike("/lagradsremiss"), "lagradsremiss").when(url.rlike("/departementsserien"), "ds").otherwise("other")
    return links.withColumn("url", url).groupBy(key, "url").agg(F.min_by(F.struct(F.col("text").alias("anchor"), kind.alias("doc_kind")), "place").alias("r"), F.min("place").alias("place")).select(key, "url", "r.*", "place")


def score_attachments(tokens: DataFrame, documents: DataFrame, key: str = "page_id", top: int = 5) -> DataFrame:
    """T12. The top files of each page with score, signals, rank, and the best's confidence (twice the score within 0 and
    100). documents: page_id, doc_type, doc_number. Disqualified are other file types, other sites and covers."""
    links = tokens.where("tag = 'a' and href <> '' and href <> '#'").join(documents, key)
    url = absolute(F.col("href"))
    file = F.lower(F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.pdf$", ""))
    rows = links.withColumns({"url": url, "file": file, "words": F.lower("text"), "number": F.lower(F.regexp_replace("doc_number", r"\s+", "")), "downloads": F.coalesce(F.col("heading").rlike(FLAGS + "ladda ner"), F.lit(False)), "listed": F.coalesce(F.col("section").rlike(DOWNLOADS), F.lit(False))})
    c = F.col
    either = lambda *w: reduce(lambda a, b: a | b, (c(x).contains(v) for v in w for x in ("file", "words")))
    assets = c("url").rlike("contentassets|globalassets")
    signals = {
        "pdf_extension": (c("url").endswith(".pdf"), 10), "doc_number_match": (c("file").contains(c("number")) | c("words").contains(c("number")), 25), "file_size_indicator": (c("words").rlike(r"\([\d,.]+ ?mb\)"), 12),
        "ladda_ner_context": (c("downloads"), 15), "in_structured_section": (c("listed"), 8), "regeringen_cdn": (assets & (c("downloads") | c("listed")), 5), "global_fallback_contentassets": (assets & ~c("downloads") & ~c("listed"), 2),
        "explicit_pdf_indicator": (c("words").contains("pdf"), 3), "swedish_full_report": (~(either("kortversion", "sammanfattning", "summary") | c("file").contains("english")), 8), "kortversion": (either("kortversion"), -5),
        "sammanfattning": (either("sammanfattning"), -5), "english_version": (c("file").rlike("english|summary") | c("words").contains("english"), -5), "fact_sheet": (either("faktablad") | (c("file").contains("fact") & c("file").contains("sheet")), -7),
        "appendix": (~c("doc_type").contains("bilaga") & either("bilaga"), -3),
    }
    bad = c("url").rlike(r"(?i)\.(xlsx?|docx?|pptx?|csv|zip|rtf|odt)($|\?)") | ~c("url").rlike(r"regeringen\.se|contentassets") | c("words").rlike("omslag|cover")
    strong = c("words").rlike(r"pdf|\([\d,.]+ ?mb\)") | c("href").rlike(r"/contentassets/|/globalassets/|\.pdf")
    bad = bad | (~c("downloads") & ~c("listed") & ~strong & c("file").contains(c("number")))
    total = reduce(lambda a, b: a + b, (F.when(on, points).otherwise(0) for on, points in signals.values()))
    named = F.filter(F.array(*(F.when(on, F.lit(name)) for name, (on, _) in signals.items())), lambda x: x.isNotNull())
    rows = rows.where(~bad & (strong | c("downloads") | c("listed"))).select(key, "place", "url", "text", total.alias("score"), named.alias("signals"), file_kind(c("url"), c("text")).alias("file_kind"))
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "place")
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.withColumn("confidence", F.greatest(F.lit(0), F.least(F.lit(100), F.col("score") * 2)))


def parse_consultation_page(pages: DataFrame, tokens: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """T13. (page with title, deadline, invitee list; answers page, url, organisation, file_kind) of consultation pages."""
    plain = F.regexp_replace(decode_entities(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")), r"\s+", " ")
    day = r"(\d{1,2}\s+\p{L}+\s+\d{4})"
    deadlines = [rf"{FLAGS}sista\s+svarsdatum[:\s]+{day}", rf"{FLAGS}senast\s+{day}", rf"{FLAGS}sista\s+dag\s+att\s+svara[^0-9]*{day}", r"(\d{4}-\d{2}-\d{2})"]
    found = F.coalesce(*(F.nullif(F.regexp_extract(F.col("_text"), p, 1), F.lit("")) for p in deadlines))
    out = pages.select(key, plain.alias("_text")).select(key, swedish_date(found)["date"].alias("deadline"))
    # titles and links in one reading of the pages: a page's first title is its row without a URL
    linked = (F.col("tag") == "a") & F.col("href").rlike(r"\.pdf|contentdisposition=attachment|/download/|/contentassets/")
    rows = tokens.where((F.col("tag") == "h1") | linked).withColumn("url", F.when(linked, absolute(F.col("href"))))
    links = rows.groupBy(key, "url").agg(F.min_by(F.struct("text", "heading", "section", "place"), "place").alias("r")).select(key, "url", "r.*")
    links = links.withColumn("file", F.lower(F.regexp_replace(F.element_at(F.split("url", "/"), -1), r"\?.*$", "")))
    low = F.lower("text")
    headed = F.coalesce(F.lower("heading").contains("remissinstanser") & ~F.lower("heading").contains("remissvar"), F.lit(False))
    named = F.coalesce(low.contains("remissinstans") | F.col("file").contains("remissinstans") | low.contains("sändlista"), F.lit(False))
    # a page's list is marked where it stands: a join of the links with themselves would read all pages twice
    links = links.withColumns({"_listed": F.col("url").isNotNull() & (headed | named), "_headed": headed})
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_listed").desc(), F.col("_headed").desc(), "place")) == 1
    links = links.withColumn("_list", F.col("_listed") & first)
    facts = links.groupBy(key).agg(F.max(F.when(F.col("url").isNull(), F.col("text"))).alias("title"), F.max(F.when(F.col("_list"), F.col("url"))).alias("invitees_url"))
    cover = F.col("file").rlike("^remiss-av-|remissinstans|sandlista|remiss-och-") | F.lower("url").contains("remissinstans")
    answers = links.where(F.col("url").isNotNull() & ~F.col("_list")).where(~cover)
    answer = low.rlike("remissvar|yttrande") | F.col("file").contains("remissvar") | F.coalesce(F.col("section").contains("remissvar"), F.lit(False))
    kind = file_kind(F.col("url"), F.col("text"))
    organisation = normalize_org(F.regexp_replace(F.regexp_replace("text", r"(?i)^remissvar[-_\s]*", ""), "[-_]", " "))
    answers = answers.where(answer | (kind == "pdf")).select(key, "url", "text", F.nullif(organisation, F.lit("")).alias("organization"), kind.alias("file_kind"))
    # a size guessed from a small file would broadcast what all pages make of it, which is more than a driver holds
    return out.join(facts.hint("merge"), key, "left"), answers


def discover_listings(tokens: DataFrame, documents: DataFrame, key: str = "page_id", years: str = r"(19|20)\d{2}") -> tuple[DataFrame, DataFrame]:
    """T14. (matched, orphan) listing links: the report and directive numbers in a title, in order, and the first that
    documents (doc_id, doc_number) has; orphans with a reason and their year."""
    items = tokens.where("tag = 'a' and href <> '' and text <> ''").select(key, "place", absolute(F.col("href")).alias("url"), F.col("text").alias("title"))
    numbers = F.concat(F.transform(F.regexp_extract_all("title", F.lit(rf"(?i)\b(SOU|Dir\.?|Ds)\s*{years}\s*[:\-]\s*\d+"), F.lit(0)), lambda x: x))
    exploded = items.select("*", F.posexplode_outer(numbers).alias("nth", "raw")).withColumn("number", normal_number(document_number(F.col("raw"))["number"]))
    known = documents.groupBy(normal_number(F.col("doc_number")).alias("number")).agg(F.min("doc_id").alias("doc_id"))
    hits = exploded.join(known, "number", "left").groupBy(key, "place", "url", "title").agg(F.min_by(F.struct("doc_id", "number"), F.when(F.col("doc_id").isNotNull(), F.col("nth"))).alias("hit"), F.max("number").alias("any_number"))
    matched = hits.where("hit is not null").select(key, "place", "url", "title", "hit.doc_id", "hit.number")
    reason = F.when(F.col("any_number").isNull(), "no_number").otherwise("not_in_documents")
    orphan = hits.where("hit is null").select(key, "place", "url", "title", reason.alias("reason"), F.nullif(F.regexp_extract("any_number", years, 0), F.lit("")).alias("year"))
    return matched, orphan


def repeated_pages(tokens: DataFrame, listing: DataFrame, key: str = "page_id") -> DataFrame:
    """T14. Listing pages (listing: page, listing, number) whose links are the same as those of the page with the number
    before in their listing: where paging has run over the end. Pages meet by listing and number."""
    signature = tokens.where("tag = 'a'").groupBy(key).agg(F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "href"))), lambda x: x["href"]), "|")).alias("signature"))
    signed = listing.select(key, "listing", "number").join(signature, key)
    before = signed.select("listing", (F.col("number") + 1).alias("number"), F.col("signature").alias("_before")).groupBy("listing", "number").agg(F.max("_before").alias("_before"))
    return signed.join(before, ["listing", "number"], "left").select(key, "listing", "number", "signature", F.coalesce(F.col("_before") == F.col("signature"), F.lit(False)).alias("repeated"))


def find_consultation_link(documents: DataFrame, refs: DataFrame, tokens: DataFrame) -> DataFrame:
    """T15. Per document the consultation's URL: by a stored reference's URL (priority 1), a reference's text (2), or the
    page link of best score (3): 10 for its section, 3, 2 or 1 for its phrase. tokens have doc_id."""
    by_url = refs.where(F.col("target_url").rlike("/remisser/")).select("doc_id", F.col("target_url").alias("url"), F.lit(1).alias("priority"), F.lit(0).alias("points"))
    by_text = refs.where(F.col("target_number").rlike(FLAGS + r"\bremiss\b") & F.col("target_url").isNotNull()).select("doc_id", F.col("target_url").alias("url"), F.lit(2).alias("priority"), F.lit(0).alias("points"))
    low = F.lower("text")
    phrase = F.when(low.contains("remiss av"), 3).when(low.contains("remittering"), 2).when(low.contains("remiss"), 1).otherwise(0)
    points = F.when(F.coalesce(F.col("section").rlike(FLAGS + RELATED), F.lit(False)), 10).otherwise(0) + phrase
    by_page = tokens.where("tag = 'a'").where(F.col("href").rlike("/remisser/")).select("doc_id", absolute(F.col("href")).alias("url"), F.lit(3).alias("priority"), points.alias("points"))
    rows = by_url.unionByName(by_text).unionByName(by_page).join(documents.select("doc_id"), "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("url", "priority", "points"), F.struct("priority", -F.col("points"), "url")).alias("r")).select("doc_id", "r.*")


def parse_inquiries(tokens: DataFrame, key: str = "page_id", item: str = "li") -> DataFrame:
    """T16. (page, item, code, title, process_key, url) of list items with an inquiry code such as "Fi 2024:03"; of links
    a report's first, then a directive's; items without a document's link go."""
    order = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("tag") == item) | F.col("class").rlike("c-accordion-plain($| )")
    rows = tokens.withColumn("item", F.sum(starts.cast("int")).over(order)).where("item > 0")
    code = r"([A-ZÅÄÖa-zåäö]{1,3})\s+(\d{4}):(\d+)"
    url = absolute(F.col("href"))
    rank = F.when(url.rlike("/statens-offentliga-utredningar/.+"), 1).when(url.rlike("/kommittedirektiv/.+"), 2)
    per = rows.groupBy(key, "item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("_text"), F.min_by(F.struct(url.alias("url"), F.col("text").alias("anchor")), F.when(rank.isNotNull(), F.struct(rank, F.col("place")))).alias("r"), F.min_by("text", F.when(F.col("tag").isin("h1", "h2", "h3", "h4"), F.col("place"))).alias("_head"))
    part = lambda i: F.regexp_extract("_text", code, i)
    found = per.where(F.col("_text").rlike(code) & F.col("r").isNotNull())
    title = F.trim(F.regexp_replace(F.coalesce("_head", "r.anchor"), code, ""))
    return found.select(key, "item", F.concat(part(1), F.lit(" "), part(2), F.lit(":"), part(3)).alias("code"), F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Utredning "), part(0))).alias("title"), F.concat_ws("-", F.lower(part(1)), part(2), F.lpad(part(3), 2, "0")).alias("process_key"), F.col("r.url").alias("url"))


# Roles in contact blocks, the first that a text holds.
ROLES = (("särskild utredare", "sarskild_utredare"), ("huvudsekreterare", "huvudsekreterare"), ("sekreterare", "sekreterare"), ("expert", "expert"), ("sakkunnig", "sakkunnig"), ("kontaktperson", "kontaktperson"), ("kommitt", "kommitte"), ("ordförande", "ordforande"))


def parse_contacts(blocks: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """T17. (page, role, name) of lines "role: name" between <br> tags; links and one-letter names go."""
    lines = blocks.select(key, F.posexplode(F.split(html, r"(?i)<br\s*/?>|\n")).alias("line", "raw")).withColumn("raw", F.trim(decode_entities(F.regexp_replace("raw", "<[^>]*>", ""))))
    rows = lines.select(key, "line", F.trim(F.regexp_extract("raw", r"^([^:]+):\s*(.+)$", 1)).alias("_role"), F.trim(F.regexp_extract("raw", r"^([^:]+):\s*(.+)$", 2)).alias("name"))
    low = F.lower("_role")
    plain = F.translate(F.regexp_replace(low, r"\s+", "_"), "åäö", "aao")
    role = reduce(lambda w, r: w.when(low.contains(r[0]), r[1]), ROLES, F.when(F.lit(False), "")).otherwise(plain)
    return rows.where((F.length("name") > 1) & ~F.contains("name", F.lit("http")) & (F.col("_role") != "")).select(key, "line", role.alias("role"), "name")


def detect_document(pages: DataFrame, tokens: DataFrame, ministries: list[str], key: str = "page_id") -> DataFrame:
    """T18. Per page its document's type and number, the first ministry of the list that the text has, title and date."""
    plain = decode_entities(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " "))
    title = tokens.where("tag in ('h1', 'title')").groupBy(key).agg(F.min_by("text", F.struct(F.when(F.col("tag") == "h1", 0).otherwise(1), F.col("place"))).alias("title"))
    rows = pages.select(key, plain.alias("_text")).join(title, key, "left")
    number = F.coalesce(document_number(F.col("title")), document_number(F.col("_text")))
    rows = rows.withColumn("_n", number)
    kind = F.when(F.col("_n.number").startswith("SOU"), "sou").when(F.col("_n.number").startswith("Dir."), "directive").when(F.col("_n.number").startswith("Prop."), "proposition").when(F.col("_n.number").startswith("Ds"), "ds").otherwise("unknown")
    ministry = F.coalesce(*(F.when(F.contains(F.lower("_text"), F.lit(m.lower())), m) for m in ministries)) if ministries else F.lit(None).cast("string")
    return rows.select(key, kind.alias("doc_type"), F.col("_n.number").alias("doc_number"), "title", ministry.alias("ministry"), swedish_date(F.col("_text")).alias("published"))


def parse_numbered_list(texts: DataFrame, key: str = "id", text: str = "text", most: int = 300) -> tuple[DataFrame, DataFrame]:
    """T19. (organisations key, line, name; diagnostics) of texts with numbered lines: "1." "1)" "1:" "1-" "1 –" and a name,
    or a number alone and the name on the next line. Numbers over `most`, boilerplate and short names go; a name once."""
    lines = texts.select(key, F.posexplode_outer(F.split(text, "\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace(F.coalesce("raw", F.lit("")), r"^\s+|\s+$", "")))
    alone, numbered = F.col("raw").rlike(r"^\d+[.):\-–]?$"), r"^(\d+)\s*[.):\-–]\s*(.+)$"
    after = F.coalesce(F.lag(alone).over(Window.partitionBy(key).orderBy("line")), F.lit(False)) & (F.col("raw") != "") & ~alone
    single = F.col("raw").rlike(numbered) & ~alone & ~after
    rows = lines.withColumn("_alone", alone).withColumn("_single", single).withColumn("_raw", F.when(after, F.col("raw")).when(single & (F.regexp_extract("raw", numbered, 1).try_cast("int") <= most), F.regexp_extract("raw", numbered, 2)))
    # exploded arrays of one element: a condition on a column that is made in a select would make it anew
    raw = rows.select(key, "line", F.explode(F.filter(F.array("_raw"), lambda x: x.isNotNull())).alias("_raw"))
    names = raw.where(~is_boilerplate(F.col("_raw"))).select(key, "line", F.explode(F.array(normalize_org(F.col("_raw")))).alias("name"))
    names = names.where((F.length("name") >= 3) & ~F.col("name").rlike(r"^\d+$"))
    names = names.groupBy(key, "name").agg(F.min("line").alias("line"))
    counts = rows.groupBy(key).agg(F.count("*").alias("total_lines"), F.count_if(F.col("_alone") | F.col("_single")).alias("numbered_lines"), F.max(F.length("raw")).alias("_longest"))
    counts = counts.join(names.groupBy(key).agg(F.count("*").alias("organizations")), key, "left").withColumn("organizations", F.coalesce("organizations", F.lit(0)))
    status = F.when(F.col("organizations") > 0, "success").when(F.col("_longest") == 0, "extraction_failed").when(F.col("numbered_lines") == 0, "no_numbered_entries").otherwise("extraction_failed")
    return names, counts.withColumn("status", status).drop("_longest")


def key_sections(docs: DataFrame, key: str = "doc_id", text: str = "raw_content", most: int = 80_000) -> DataFrame:
    """T20. (key, text, strategy): the part of a document to summarise. Short ones whole (null is empty); directives, laws and committee
    reports cut; of others the longest summary section in the first 80 per cent with the table of contents, else the start."""
    base = docs.select(key, "doc_type", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    long = (F.length("_t") > most) & ~F.col("doc_type").isin("directive", "dir", "law", "committee_report", "bet")
    # each summary heading with what follows up to the next end mark, found by splitting the text behind headings. The longest
    # is sought within the row, the first of equals: a whole text is never exchanged
    mark = r"(?m)^(?:Författningsförslag|Förslag till riksdagsbeslut|Summary|1\s+[A-ZÅÄÖ])"
    body = lambda c: F.regexp_replace(F.get(F.split(F.regexp_extract(c, r"(?s)^[^\n]*\n(.*)$", 1), mark, 2), F.lit(0)), r"^\s+|\s+$", "")
    headed = lambda c: F.struct(F.length(c).cast("long").alias("n"), F.when(c.rlike(r"(?i)^(\d+\s+)?Sammanfattning\s*\n"), body(c)).alias("body"))
    pieces = F.when(long, F.transform(F.split("_t", r"(?mi)^(?=(?:\d+\s+)?Sammanfattning\s*$)"), headed))

    def longer(held: Column, piece: Column) -> Column:
        better = F.coalesce((F.length(piece["body"]) > held["size"]) & (held["start"] <= F.length("_t") * 0.8), F.lit(False))
        return F.struct((held["start"] + piece["n"]).alias("start"), F.when(better, F.length(piece["body"])).otherwise(held["size"]).alias("size"), F.when(better, piece["body"]).otherwise(held["body"]).alias("body"))

    none = F.struct(F.lit(0).cast("long").alias("start"), F.lit(500).alias("size"), F.lit(None).cast("string").alias("body"))
    best = F.substring(F.aggregate(pieces, none, longer)["body"], 1, 60_000)
    start = F.substring("_t", 1, 20_000)
    contents = F.regexp_extract(start, r"(?ms)^(?:Innehåll|Innehållsförteckning)\s*$(.*?)(?=^(?:Sammanfattning|Författningsförslag|1\s+[A-ZÅÄÖ])|\z)", 1)
    entries = F.filter(F.split(contents, "\n"), lambda x: F.trim(x).rlike(r"^\d+(\.\d+)*\s+|^[A-ZÅÄÖ]"))
    toc = F.when(F.size(entries) >= 3, F.substring(F.concat_ws("\n", entries), 1, 5_000))
    joined = base.withColumn("_summary", best).withColumn("_toc", F.when(F.col("_summary").isNotNull(), toc))
    both = F.concat(F.lit("[SAMMANFATTNING]\n"), F.col("_summary"), F.when(F.col("_toc").isNotNull(), F.concat(F.lit("\n\n[INNEHÅLLSFÖRTECKNING (för strukturell kontext)]\n"), F.col("_toc"))).otherwise(""))
    strategy = F.when(F.length("_t") <= most, "full_text").when(F.col("doc_type").isin("directive", "dir", "law"), "full_text_truncated").when(F.col("doc_type").isin("committee_report", "bet"), "first_80k").when(F.col("_summary").isNull(), "fallback_first_80k").when(F.length(both) <= most, "sammanfattning_with_toc").otherwise("sammanfattning_truncated")
    return joined.select(key, F.substring(F.when(strategy.startswith("sammanfattning"), both).otherwise(F.col("_t")), 1, most).alias("text"), strategy.alias("strategy"))


def stance_excerpt(docs: DataFrame, key: str = "id", text: str = "text", most: int = 4_000, summary: int = 1_500) -> DataFrame:
    """T21. (key, excerpt): up to `summary` characters of summary sections, then body, `most` together."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("_low", F.lower(F.trim("raw")))
    starts = F.col("_low").rlike("sammanfattning|ställningstagande|yttrande i korthet") & (F.length("_low") < 60)
    ends = (F.length("_low") < 50) & F.col("_low").rlike(r"^\d+\.\s")
    inside = F.last(F.when(starts, True).when(ends, False), ignorenulls=True).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("_in", F.coalesce(inside, F.lit(False)))
    part = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("line", "raw")))), lambda x: x["raw"]), "\n")
    out = lines.groupBy(key).agg(part(F.col("_in")).alias("_s"), part(~F.col("_in")).alias("_b"), part(F.lit(True)).alias("_all"))
    head = F.substring("_s", 1, summary)
    room = F.lit(most) - F.length(head)
    both = F.concat(head, F.when((room > 500) & (F.length("_b") > 0), F.concat(F.lit("\n\n---\n\n"), F.substring("_b", F.lit(1), (room - 100).cast("int")))).otherwise(""))
    return out.select(key, F.trim(F.when(F.trim("_s") != "", both).otherwise(F.substring("_all", 1, most))).alias("excerpt"))


def validate_extracted(people: DataFrame, most: int = 500) -> DataFrame:
    """T24. People (name, role, excerpt, page, doc_type) with a reason (ok, no_space, brackets, title_only, too_short) and
    excerpts cut. Ministers' titles count as names' parts in bills only."""
    name = F.trim(F.coalesce("name", F.lit("")))
    title = name.rlike(FLAGS + r"^(statsrådet|ministern?|statsminister\w*|generaldirektör\w*|utredaren|ordföranden|sekreteraren)\b") & ~F.coalesce(F.col("doc_type") == "proposition", F.lit(False))
    reason = F.when(F.length(name) < 3, "too_short").when(name.rlike(r"[\[\]{}<>]"), "brackets").when(~name.contains(" "), "no_space").when(title, "title_only").otherwise("ok")
    return people.withColumn("reason", reason).withColumn("excerpt", F.substring("excerpt", 1, most)).withColumn("page", F.coalesce("page", F.lit(1)))


def load_summaries(rows: DataFrame, key: str = "doc_id", col: str = "json") -> DataFrame:
    """T25. Model summaries from JSON text: the summary is required (invalid rows say so), lists default to empty, the
    outcome to unknown."""
    shape = "summary_text string, aim string, outcome string, keywords array<string>, policy_domains array<string>, key_actors array<struct<name:string,role:string>>"
    parsed = rows.withColumn("_j", F.from_json(col, shape))
    text = F.trim("_j.summary_text")
    outcome = F.when(F.col("_j.outcome").isin("approved", "rejected", "pending", "partially_approved"), F.col("_j.outcome")).otherwise("unknown")
    none = F.array().cast("array<string>")
    return parsed.select(key, text.alias("summary_text"), F.col("_j.aim").alias("aim"), outcome.alias("outcome"), F.coalesce("_j.keywords", none).alias("keywords"), F.coalesce("_j.policy_domains", none).alias("policy_domains"), F.coalesce("_j.key_actors", F.array().cast("array<struct<name:string,role:string>>")).alias("key_actors"), F.coalesce(F.length(text) > 0, F.lit(False)).alias("valid"))


def load_events(rows: DataFrame, key: str = "doc_id", col: str = "json") -> DataFrame:
    """T25. Model events from JSON text: one row an event; a month's date is its first day, confidence defaults to medium."""
    shape = "array<struct<event_type:string,event_date:string,description:string,confidence:string,source_page:int,source_excerpt:string,actors:array<struct<name:string,role:string>>>>"
    out = rows.select(key, F.explode(F.from_json(col, shape)).alias("e")).select(key, "e.*")
    full = F.when(F.col("event_date").rlike(r"^\d{4}-\d{2}$"), F.concat("event_date", F.lit("-01"))).otherwise(F.col("event_date"))
    return out.withColumn("event_date", F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).cast("date")).withColumn("confidence", F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("medium"))
