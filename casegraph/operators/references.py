"""Citations between documents: resolution, titles, typed relationships, and processes made of linked documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..functions.text import decode_entities, document_number, link_kind, normal_number
from .components import components

# Words that a title is not searched by, headings that are no titles, and the least length of a title.
STOP_WORDS = (
    "och", "för", "att", "med", "som", "till", "den", "det", "ett", "en", "av", "på",
    "har", "kan", "ska", "vid", "från", "eller", "inte", "nya", "om", "mot", "alla", "genom",
    "mellan", "utan", "vissa", "samt", "tilläggsdirektiv", "utredningen", "kommittédirektiv", "nationell", "remiss", "promemorian", "uppdrag",
)
HEADINGS = ("om lagstiftningen i sverige", "om lagstiftning i eu", "kommittédirektiv", "kommittedirektiv")

# Kinds of relationships by the two documents' types, with score and class.
RELATIONSHIPS = {
    ("proposition", "committee_report"): ("proposition_to_committee_report", 0.95, "high"),
    ("committee_report", "proposition"): ("committee_report_to_proposition", 0.95, "high"),
    ("sou", "proposition"): ("sou_to_proposition", 0.9, "high"),
    ("proposition", "sou"): ("sou_to_proposition", 0.9, "high"),
    ("directive", "sou"): ("directive_to_sou", 0.9, "high"),
    ("sou", "directive"): ("directive_to_sou", 0.9, "high"),
    ("proposition", "law"): ("proposition_to_law", 0.9, "high"),
}

# Rank, stage and explanation by a document's type.
STAGES = {
    "law": (6, "enacted", "Lag har antagits. Processen är fullbordad."),
    "committee_report": (4, "proposition", "Utskottsbetänkande finns – riksdagsbehandling pågår eller avslutad."),
    "proposition": (3, "proposition", "Regeringens proposition har lämnats till riksdagen."),
    "sou": (2, "published", "Utredning publicerad som SOU."),
    "directive": (1, "directive_issued", "Direktiv har utfärdats."),
}


def resolve_references(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """G1. refs (ref_id, source_id, target_number) with target_id, outcome (resolved, no_match, extraction_failed),
    evidence and the number that was looked up: first as it stands, then the number found in the text.
    documents: doc_id, doc_number; of documents with one number the least id."""
    known = documents.where("doc_number is not null").groupBy(normal_number(F.col("doc_number")).alias("_k")).agg(F.min("doc_id").alias("_d"))
    found = document_number(F.col("target_number"))
    asked = refs.withColumn("_direct", normal_number(F.col("target_number"))).withColumn("_found", found).withColumn("_extracted", normal_number(F.col("_found")["number"]))
    key = lambda name, d: known.select(F.col("_k").alias(name), F.col("_d").alias(d))
    both = asked.join(key("_direct", "_d1"), "_direct", "left").join(key("_extracted", "_d2"), "_extracted", "left")
    target = F.coalesce("_d1", "_d2")
    outcome = F.when(target.isNotNull(), "resolved").when(F.col("_found").isNotNull(), "no_match").otherwise("extraction_failed")
    evidence = F.when(F.col("_d1").isNotNull(), "direct_match").otherwise(F.col("_found")["evidence"])
    number = F.when(F.col("_d1").isNotNull(), F.col("target_number")).otherwise(F.col("_found")["number"])
    return both.select(*(both[c] for c in refs.columns), target.alias("target_id"), outcome.alias("outcome"), evidence.alias("evidence"), number.alias("clean_number"))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """G2. References by outcome and evidence."""
    return resolved.groupBy("outcome", F.coalesce("evidence", F.lit("none")).alias("evidence")).agg(F.count("*").alias("n"))


def resolution_samples(resolved: DataFrame, n: int = 20) -> DataFrame:
    """G2. The first n references of each outcome."""
    first = Window.partitionBy("outcome").orderBy("ref_id")
    return resolved.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_n")


def normal_title(c: Column) -> Column:
    """A title without "remiss av" and the like, lower case, single blanks."""
    t = F.trim(F.lower(decode_entities(c)))
    for lead in (r"^remiss\s+av\s+promemorian\s+", r"^remissinstanser\s+för\s+promemorian\s+", r"^remiss\s+av\s+"):
        t = F.regexp_replace(t, lead, "")
    return F.regexp_replace(t, r"\s+", " ")


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a text with two blanks before and one behind."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two texts."""
    ga, gb = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(ga, gb))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), both / (F.size(ga) + F.size(gb) - both)).otherwise(0.0)


def search_words(title: Column) -> Column:
    """The words of over four letters that aren't stop words, longest first, ties as they stand."""
    words = F.transform(F.filter(F.split(title, r"\s+"), lambda w: (F.length(w) > 4) & ~w.isin(*STOP_WORDS)), lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(words), lambda x: x["w"])


def match_titles(refs: DataFrame, documents: DataFrame, threshold: float = 0.35) -> DataFrame:
    """G3. Unresolved references that are titles (ref_id, source_id, target_number) with the most similar document:
    target_id, similarity, reason (matched, below_threshold, no_candidates, no_search_words).

    Distinct titles are matched once. Documents whose titles hold both of the two longest words are candidates, or else
    those that hold the longest. Titles meet documents on five letters in a row of the longest word, those that fewest documents
    have, then comes a containment test: never all with all, and not on the common start of many long words.
    """
    title = refs.withColumn("title", normal_title(F.col("target_number")))
    is_title = ~F.col("target_number").rlike(r"\d{4}[:/]\d+") & (F.length("target_number") > 10) & ~F.col("title").isin(*HEADINGS)
    titles = title.where(F.col("target_number").isNotNull() & is_title)
    asked = titles.select("title").distinct().withColumn("_w", search_words(F.col("title")))
    asked = asked.withColumn("w1", F.get("_w", F.lit(0))).withColumn("w2", F.get("_w", F.lit(1)))
    docs = documents.where("title is not null").select(F.col("doc_id"), normal_title(F.col("title")).alias("doc_title"), F.lower("title").alias("_low"))
    fives = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 4)), lambda i: F.substring(c, i, F.lit(5))))
    starts = docs.withColumn("_five", F.explode(fives("_low")))
    counts = starts.groupBy("_five").agg(F.count("*").alias("_n"))
    words = asked.select("w1").distinct().where("w1 is not null")
    rarest = words.withColumn("_five", F.explode(fives("w1"))).join(counts, "_five").groupBy("w1").agg(F.min_by("_five", F.struct("_n", "_five")).alias("_five"))
    pairs = asked.join(rarest, "w1").join(starts, "_five").where(F.contains("_low", "w1"))
    pairs = pairs.withColumn("_both", F.coalesce(F.contains("_low", "w2"), F.lit(False))).withColumn("similarity", trigram_similarity(F.col("title"), F.col("doc_title")))
    best = lambda c: F.min_by(F.struct("doc_id", "similarity"), F.when(c, F.struct(-F.col("similarity"), F.col("doc_id"))))
    found = pairs.groupBy("title").agg(best(F.col("_both")).alias("two"), best(F.lit(True)).alias("one")).select("title", F.coalesce("two", "one").alias("b"))
    judged = asked.join(found, "title", "left").select("title", "w1", F.col("b.doc_id").alias("_d"), F.col("b.similarity").alias("similarity"))
    good = F.col("similarity") >= threshold
    reason = F.when(F.col("w1").isNull(), "no_search_words").when(F.col("_d").isNull(), "no_candidates").when(good, "matched").otherwise("below_threshold")
    judged = judged.select("title", F.when(good, F.col("_d")).alias("target_id"), "similarity", reason.alias("reason"))
    return titles.join(judged, "title").select(*refs.columns, "title", "target_id", "similarity", "reason")


def title_relationships(matches: DataFrame) -> DataFrame:
    """G4. One "references" edge for each pair that titles matched, high from .7 on, else medium."""
    good = matches.where("target_id is not null and source_id <> target_id").groupBy("source_id", "target_id").agg(F.max("similarity").alias("confidence_score"))
    return good.withColumn("relationship_type", F.lit("references")).withColumn("confidence_class", F.when(F.col("confidence_score") >= 0.7, "high").otherwise("medium"))


def classify_relationships(refs: DataFrame, documents: DataFrame, consultation_parents: DataFrame | None = None) -> DataFrame:
    """G5. Distinct typed edges of resolved references (source_id, target_id): by the documents' types, consultation
    parents (source_id) to reports as remiss_to_sou, others as "references" from the smaller id. Self edges go."""
    rules = F.broadcast(refs.sparkSession.createDataFrame([(*k, *v) for k, v in RELATIONSHIPS.items()], "source_type string, target_type string, kind string, score double, class string"))
    kind = lambda side: documents.select(F.col("doc_id").alias(f"{side}_id"), F.col("doc_type").alias(f"{side}_type"))
    edges = refs.where("target_id is not null and source_id <> target_id").select("source_id", "target_id").distinct()
    edges = edges.join(kind("source"), "source_id").join(kind("target"), "target_id").join(rules, ["source_type", "target_type"], "left")
    if consultation_parents is None:
        parent = F.lit(False)
    else:
        edges = edges.join(consultation_parents.select("source_id").distinct().withColumn("_parent", F.lit(True)), "source_id", "left")
        parent = F.coalesce("_parent", F.lit(False)) & (F.col("target_type") == "sou")
    kind_of = F.when(parent, "remiss_to_sou").otherwise(F.coalesce("kind", F.lit("references")))
    edges = edges.select("source_id", "target_id", kind_of.alias("relationship_type"), F.when(parent, 0.85).otherwise(F.coalesce("score", F.lit(0.8))).alias("confidence_score"), F.when(parent, "high").otherwise(F.coalesce("class", F.lit("medium"))).alias("confidence_class"))
    swap = (F.col("relationship_type") == "references") & (F.col("source_id") > F.col("target_id"))
    edges = edges.select(F.when(swap, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"), F.when(swap, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"), "relationship_type", "confidence_score", "confidence_class")
    return edges.groupBy("source_id", "target_id", "relationship_type").agg(F.max("confidence_score").alias("confidence_score"), F.min("confidence_class").alias("confidence_class"))


def orphans(documents: DataFrame, process_documents: DataFrame) -> DataFrame:
    """G6. Documents in no process."""
    return documents.join(process_documents.select("doc_id"), "doc_id", "left_anti")


def adopt_orphans(edges: DataFrame, process_documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G7. (adoptions doc_id, process_id; undecided orphans with outcome). An orphan joins a process if its linked
    documents that are in exactly one process all are in the same one. Linked documents in several processes propose
    nothing; an orphan with no other proposal than those is ambiguous, one with different proposals is in conflict."""
    both = edges.select(F.col("source_id").alias("doc_id"), F.col("target_id").alias("other")).unionByName(edges.select(F.col("target_id").alias("doc_id"), F.col("source_id").alias("other"))).where("doc_id <> other").distinct()
    member = process_documents.select("doc_id", "process_id").distinct()
    home = member.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("process_id").alias("process_id")).select(F.col("doc_id").alias("other"), "n", "process_id")
    proposals = both.join(member.select("doc_id"), "doc_id", "left_anti").join(home, "other")
    judged = proposals.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("n") == 1, F.col("process_id"))).alias("proposed"), F.min(F.when(F.col("n") == 1, F.col("process_id"))).alias("process_id"))
    outcome = F.when(F.col("proposed") == 0, "ambiguous").otherwise("conflict")
    return judged.where("proposed = 1").select("doc_id", "process_id"), judged.where("proposed <> 1").select("doc_id", outcome.alias("outcome"))


def orphan_clusters(edges: DataFrame, orphan_docs: DataFrame, adopted: DataFrame) -> DataFrame:
    """G8. Components (node, component) of edges between orphans that no process has adopted."""
    free = orphan_docs.select("doc_id").join(adopted.select("doc_id"), "doc_id", "left_anti")
    end = lambda c: free.select(F.col("doc_id").alias(c))
    return components(edges.join(end("source_id"), "source_id", "left_semi").join(end("target_id"), "target_id", "left_semi"), "source_id", "target_id")


def _by_type(field: int, default):
    return reduce(lambda c, x: c.when(F.col("doc_type") == x[0], x[1][field]), STAGES.items(), F.when(F.lit(False), STAGES["law"][field])).otherwise(default)


def rolling_hash(c: Column) -> Column:
    """The 32-bit rolling hash (31 h + code, wrapping) of a text, as the first eight base-36 digits of its absolute value."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: F.length(x) > 0), lambda x: F.ascii(x).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + x, F.lit(1 << 32)))
    signed = F.when(wrapped >= (1 << 31), F.lit(1 << 32) - wrapped).otherwise(wrapped)
    return F.substring(F.lower(F.conv(signed.cast("string"), 10, 36)), 1, 8)


def clusters_to_processes(clusters: DataFrame, documents: DataFrame, existing_keys: DataFrame | None = None, most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G9. (processes, their documents with roles, clusters skipped as oversized) of components (node, component).
    Title, stage and anchor come from the document whose type ranks highest (ties: smaller id), the ministry from the
    first that has one. Sizes are counted before members are collected, so a list holds `most` entries at most."""
    size = clusters.groupBy("component").agg(F.count("*").alias("size"))
    docs = clusters.select(F.col("node").alias("doc_id"), "component").join(size.where(F.col("size") <= most), "component").join(documents.select("doc_id", "doc_number", "doc_type", "title", "ministry"), "doc_id")
    docs = docs.withColumn("rank", _by_type(0, 0))
    top = F.min_by(F.struct("title", "doc_type", "doc_number"), F.struct(-F.col("rank"), F.col("doc_id")))
    made = docs.groupBy("component").agg(F.max("size").alias("size"), top.alias("top"), F.min_by("ministry", F.when(F.col("ministry") != "", F.col("doc_id"))).alias("ministry"), F.array_join(F.sort_array(F.collect_list("doc_number")), "|").alias("numbers"))
    made = made.withColumn("doc_type", F.col("top.doc_type"))
    anchor = F.substring(F.regexp_replace("top.doc_number", r"[^a-zA-Z0-9.:/\-]", ""), 1, 30)
    key = F.concat(F.lit("auto-"), anchor, F.lit("-"), rolling_hash(F.col("numbers")))
    processes = made.select("component", key.alias("process_key"), F.col("top.title").alias("title"), "ministry", _by_type(1, "directive").alias("stage"), _by_type(2, "Process skapad från dokumentlänkar.").alias("stage_explanation"), "size")
    if existing_keys is not None:
        processes = processes.join(existing_keys.select("process_key"), "process_key", "left_anti")
    role = F.when(F.col("doc_type").isin(*STAGES), F.col("doc_type")).otherwise("related")
    members = docs.join(processes.select("component", "process_key"), "component").select("process_key", "doc_id", role.alias("role"))
    return processes, members, size.where(F.col("size") > most)


def size_histogram(clusters: DataFrame) -> DataFrame:
    """G10. Clusters by size: 1, 2, 3, 4-5, 6-10, 11-20, 21+."""
    n = F.col("n")
    label = F.when(n <= 3, n.cast("string")).when(n <= 5, "4-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")
    return clusters.groupBy("component").agg(F.count("*").alias("n")).groupBy(label.alias("bucket")).agg(F.count("*").alias("clusters"))


def linkage_manifest(orphan_docs: DataFrame, adopted: DataFrame, members: DataFrame) -> DataFrame:
    """G10. Orphans before and after, and by how many per cent they fell."""
    gone = adopted.select("doc_id").unionByName(members.select("doc_id")).distinct().withColumn("_in", F.lit(True))
    out = orphan_docs.select("doc_id").join(gone, "doc_id", "left").agg(F.count("*").alias("before"), F.count_if(F.col("_in").isNull()).alias("after"))
    return out.withColumn("reduction", F.coalesce(percent(F.col("before") - F.col("after"), F.col("before")), F.lit(0)))


def store_link_references(links: DataFrame, documents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """G15. Reference edges of page links (source_id, url, anchor): kind, number (the anchor's text where the URL has
    none) and target, one for each (source, number); those that exist are left out."""
    kinds = link_kind(F.col("_url"), F.col("_anchor"))
    # what is said of a link is said once a distinct one: patterns are dear, and pages link to the same places
    known = links.select(F.col("url").alias("_url"), F.col("anchor").alias("_anchor")).distinct().select("_url", "_anchor", *(c.alias(n) for n, c in kinds.items()))
    same = F.col("url").eqNullSafe(F.col("_url")) & F.col("anchor").eqNullSafe(F.col("_anchor"))
    rows = links.select("source_id", "url", "anchor").join(known, same).drop("_url", "_anchor")
    rows = rows.withColumn("target_number", F.coalesce("target_number", F.nullif(F.trim("anchor"), F.lit("")))).where("target_number is not null")
    rows = rows.groupBy("source_id", "target_number").agg(F.min(F.struct("url", "reference_type", "confidence", "external", "external_type")).alias("r")).select("source_id", "target_number", "r.*")
    known = documents.groupBy(normal_number(F.col("doc_number")).alias("_k")).agg(F.min("doc_id").alias("target_id"))
    rows = rows.withColumn("_k", normal_number(F.col("target_number"))).join(known, "_k", "left").drop("_k")
    return rows if existing is None else rows.join(existing.select("source_id", "target_number"), ["source_id", "target_number"], "left_anti")
