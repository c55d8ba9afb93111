"""Stages of processes from their documents and events, and events merged into what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import MONTHS

# Kinds of evidence, with the spellings that occur.
DOCUMENTS = {"directive": ("directive", "dir"), "sou": ("sou",), "remiss": ("remiss",), "proposition": ("proposition", "prop"), "law": ("law", "lag")}
EVENTS = {"directive_issued": ("directive_issued",), "sou_published": ("sou_published",), "remiss": ("remiss_start", "remiss_end", "remiss_started", "remiss_ended", "remiss_period_start", "remiss_period_end"), "proposition_submitted": ("proposition_submitted",), "law_enacted": ("law_enacted",)}
# Stages in their order, and what is said about them; {} is the report's date.
ORDER = ("directive", "directive_issued", "published", "remiss", "proposition", "enacted")
SAYS = {
    "enacted": "Lag har antagits och trätt i kraft. Processen är fullbordad.",
    "proposition": "Regeringens proposition har lämnats till riksdagen för behandling.",
    "remiss": "SOU:n är under remissbehandling. Remissinstanser lämnar synpunkter.",
    "published": "Utredningen har publicerats som SOU{}. Remissbehandling kan påbörjas.",
    "directive_issued": "Direktiv har utfärdats. Utredningsarbete kan påbörjas.",
    "directive": "Utredning planerad eller pågående. Väntar på direktiv eller mer information.",
}
# Kinds of events that a document's type can give.
ALLOWED = {"directive": ("directive_issued", "committee_formed"), "sou": ("sou_published", "directive_issued", "committee_formed", "remiss_period_start", "remiss_period_end"), "proposition": ("proposition_submitted", "proposition_referred_to_riksdagen", "proposition_published", "government_decision_date", "impact_analysis_date", "law_enacted")}


def evidence(processes: DataFrame, process_documents: DataFrame, events: DataFrame) -> DataFrame:
    """G11. Ten booleans per process: five of documents (process_id, doc_type), five of events (process_id, event_type),
    and the first report's date."""
    some = lambda col, names: F.coalesce(F.bool_or(F.col(col).isin(*names)), F.lit(False))
    docs = process_documents.groupBy("process_id").agg(*(some("doc_type", v).alias(f"has_{k}") for k, v in DOCUMENTS.items()))
    happened = events.groupBy("process_id").agg(*(some("event_type", v).alias(f"event_{k}") for k, v in EVENTS.items()), F.min(F.when(F.col("event_type") == "sou_published", F.col("event_date"))).alias("sou_date"))
    out = processes.join(docs, "process_id", "left").join(happened, "process_id", "left")
    flags = [f"has_{k}" for k in DOCUMENTS] + [f"event_{k}" for k in EVENTS]
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})


def stage(found: DataFrame) -> DataFrame:
    """G12. found (of evidence) with stage and explanation: the furthest that there is evidence for; a report counts as
    published only with both the document and the event."""
    c = F.col
    at = (
        F.when(c("has_law") | c("event_law_enacted"), "enacted").when(c("has_proposition") | c("event_proposition_submitted"), "proposition").when(c("has_remiss") | c("event_remiss"), "remiss")
        .when(c("has_sou") & c("event_sou_published"), "published").when(c("has_directive") | c("event_directive_issued"), "directive_issued").otherwise("directive")
    )
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("sou_date"))
    date = F.when(c("sou_date").isNotNull(), F.concat(F.lit(" ("), F.dayofmonth("sou_date").cast("string"), F.lit(" "), month, F.lit(" "), F.year("sou_date").cast("string"), F.lit(")"))).otherwise("")
    says = reduce(lambda w, s: w.when(c("stage") == s[0], F.replace(F.lit(s[1]), F.lit("{}"), date)), SAYS.items(), F.when(F.lit(False), ""))
    return found.withColumn("stage", at).withColumn("stage_explanation", says)


def stage_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), F.when(c == "law", "enacted").otherwise(c))


def verify_stages(staged: DataFrame, stored: str = "current_stage") -> DataFrame:
    """G13. Stored against computed stages: match, and whether the change goes forward; mismatches first."""
    old, new = stage_rank(F.col(stored)), stage_rank(F.col("stage"))
    out = staged.withColumn("match", F.coalesce(old == new, F.lit(False))).withColumn("valid_transition", F.coalesce(new >= old, F.lit(False)))
    return out.orderBy("match", "process_id")


def verification_summary(verified: DataFrame) -> DataFrame:
    """G13. How many match, how many may move, how many would go back."""
    return verified.agg(F.count("*").alias("total"), F.count_if("match").alias("matches"), F.count_if(~F.col("match") & F.col("valid_transition")).alias("forward"), F.count_if(~F.col("valid_transition")).alias("invalid"))


def merge_events(existing: DataFrame, new: DataFrame, doc_types: bool = False) -> DataFrame:
    """G14. existing with new events (process_id, event_type, event_date, person, metadata) and what was done with each row
    (kept, updated, inserted). Events are one by process, type and date, committees also by person; an event that is
    there gets the new metadata. With doc_types new events of a kind that their doc_type can't give are left out."""
    if doc_types:
        fits = reduce(lambda c, x: c | ((F.col("doc_type") == x[0]) & F.col("event_type").isin(*x[1])), ALLOWED.items(), F.lit(False))
        new = new.where(fits)
    person = F.when(F.col("event_type") == "committee_formed", F.lower(F.trim("person"))).otherwise("")
    keys = ["process_id", "event_type", F.coalesce(F.col("event_date").cast("string"), F.lit("")).alias("_date"), F.coalesce(person, F.lit("")).alias("_person")]
    columns = ["event_date", "person", "metadata"]
    rows = existing.select(*keys, *columns, F.lit(0).alias("_new")).unionByName(new.select(*keys, *columns, F.lit(1).alias("_new")))
    out = rows.groupBy("process_id", "event_type", "_date", "_person").agg(
        F.max_by(F.struct("event_date", "person"), -F.col("_new")).alias("first"), F.max_by("metadata", F.struct("_new", F.coalesce("metadata", F.lit("")))).alias("metadata"), F.min("_new").alias("lo"), F.max("_new").alias("hi"),
    )
    action = F.when(F.col("lo") == 1, "inserted").when(F.col("hi") == 1, "updated").otherwise("kept")
    return out.select("process_id", "event_type", "first.event_date", "first.person", "metadata", action.alias("action"))
