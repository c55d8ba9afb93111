"""Listings and status documents of the parliament's open data as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import one_or_many

SITE = "https://www.riksdagen.se/sv/dokument-och-lagar/dokument"
LISTING = "dok_id string, rm string, beteckning string, titel string, undertitel string, datum string, organ string"
# By kind the document type, lifecycle stage and folder of its page.
KINDS = {"prop": ("proposition", "proposition", "proposition/"), "bet": ("committee_report", "parliament", ""), "sfs": ("law", "law", "svensk-forfattningssamling/"), "dir": ("directive", "directive", "direktiv/")}
# How numbers of other documents begin.
PREFIXES = {"prop": "Prop.", "bet": "Bet.", "mot": "Mot.", "sou": "SOU", "dir": "Dir.", "sfs": "SFS"}


def ingest_listing(pages: DataFrame, kind: str, col: str = "json") -> DataFrame:
    """S2. Listing pages (JSON text with dokumentlista.dokument, one or many) as documents: number by kind, title, date,
    ministry, lifecycle stage, URL and the rest as metadata; rows without an id go."""
    doc_type, stage, folder = KINDS[kind]
    rows = pages.select(F.explode(one_or_many(F.get_json_object(col, "$.dokumentlista.dokument"), f"struct<{', '.join(f.replace(' ', ':') for f in LISTING.split(', '))}>")).alias("d")).select("d.*").where("dok_id is not null")
    number = {"prop": F.concat(F.lit("Prop. "), "rm", F.lit(":"), "beteckning"), "bet": F.col("dok_id"), "sfs": F.col("beteckning"), "dir": F.concat(F.lit("Dir. "), F.regexp_replace("beteckning", r"^(?i)dir\.?\s*", ""))}[kind]
    metadata = F.to_json(F.struct(F.col("dok_id").alias("riksdagen_id"), F.col("rm").alias("session"), F.col("beteckning").alias("designation"), F.lit("riksdagen").alias("source"), F.col("undertitel").alias("subtitle"), "organ"))
    ministry = F.lit(None).cast("string") if kind == "bet" else F.nullif("organ", F.lit(""))
    return rows.select(F.lit(doc_type).alias("doc_type"), number.alias("doc_number"), F.col("titel").alias("title"), F.try_to_timestamp("datum", F.lit("yyyy-MM-dd")).cast("date").alias("publication_date"), ministry.alias("ministry"), F.lit(stage).alias("lifecycle_stage"), F.concat(F.lit(f"{SITE}/{folder}"), "dok_id", F.lit("/")).alias("url"), metadata.alias("metadata"))


def reference_number(kind: Column, session: Column, designation: Column) -> Column:
    """A number such as "Prop. 2024/25:1" of a reference's three fields."""
    prefix = reduce(lambda w, x: w.when(kind == x[0], x[1]), PREFIXES.items(), F.when(F.lit(False), "")).otherwise(F.upper(kind))
    return F.concat(prefix, F.lit(" "), session, F.lit(":"), designation)


def extract_status(rows: DataFrame, key: str = "dok_id", col: str = "json") -> dict[str, DataFrame]:
    """S4. From status documents: facts (first PDF, committee), references (number, kind, target type) and events. A
    decision (BES) makes a parliament_decision; a vote (AVG) counts only without one; UTL is a committee_referral. The
    committee is the document's organ, else its subtype's, else the letters of its designation."""
    field = lambda path: F.get_json_object(col, f"$.dokumentstatus.{path}")
    files = one_or_many(field("dokbilaga.bilaga"), "struct<filtyp:string,fil_url:string>")
    pdf = F.get(F.filter(files, lambda x: F.lower(x["filtyp"]) == "pdf"), F.lit(0))["fil_url"]
    code = lambda path: F.nullif(F.trim(field(path)), F.lit(""))
    committee = F.coalesce(code("dokument.organ"), code("dokument.subtyp"), F.nullif(F.regexp_extract(field("dokument.beteckning"), r"^([A-Za-zÅÄÖåäö]+)", 1), F.lit("")))
    facts = rows.select(key, pdf.alias("pdf_url"), committee.alias("committee"))
    refs = rows.select(key, F.explode(one_or_many(field("dokreferens.referens"), "struct<referenstyp:string,ref_dok_id:string,ref_dok_typ:string,ref_dok_rm:string,ref_dok_bet:string>")).alias("r")).select(key, "r.*")
    kind = F.when(F.col("referenstyp") == "behandlar", "recommends").when(F.col("referenstyp") == "besvarar", "responds_to").when(F.col("referenstyp") == "hänvisar", "cites").when(F.col("ref_dok_typ") == "bet", "has_committee_report").when(F.col("ref_dok_typ") == "sfs", "results_in_law").otherwise("references")
    refs = refs.select(key, reference_number(F.col("ref_dok_typ"), F.col("ref_dok_rm"), F.col("ref_dok_bet")).alias("target_number"), kind.alias("reference_type"), F.col("ref_dok_typ").alias("target_type"), "ref_dok_id")
    acts = rows.select(key, one_or_many(field("dokaktivitet.aktivitet"), "struct<kod:string,datum:string,namn:string>").alias("acts"))
    acts = acts.select(key, F.exists("acts", lambda a: a["kod"] == "BES").alias("_decided"), F.explode("acts").alias("a")).select(key, "_decided", "a.*")
    event = F.when(F.col("kod") == "BES", "parliament_decision").when((F.col("kod") == "AVG") & ~F.col("_decided"), "parliament_vote").when(F.col("kod") == "UTL", "committee_referral")
    name = F.when(F.col("kod") == "BES", "Riksdagsbeslut").when(F.col("kod") == "AVG", "Omröstning").otherwise("Utskottsbehandling")
    events = acts.withColumn("event_type", event).where("event_type is not null").select(key, "event_type", F.try_to_timestamp(F.substring("datum", 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("event_date"), F.coalesce("namn", name).alias("description"))
    return {"facts": facts, "references": refs, "events": events}
