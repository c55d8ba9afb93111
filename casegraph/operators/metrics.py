"""Durations, participation, influence and coverage of cases and actors.

Tables have these columns where an operator needs them: responses and invites actor_id, case_id (responses also stance),
actors actor_id, name, events case_id, event_type, event_date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent, rounded, zero

#: The four kinds of influence and their weights in the composite.
INFLUENCE_WEIGHTS = {"remissvar_frequency": 0.35, "invitation_rate": 0.25, "stance_consistency": 0.15, "cross_case_breadth": 0.25}
NO_MINISTRY = "Okänt departement"


def velocity(events: DataFrame, start: str, end: str) -> DataFrame:
    """M1. Days from a case's earliest start event to its earliest end event, where both exist and days > 0."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("event_date")))
    spans = events.where(F.col("event_type").isin(start, end)).groupBy("case_id").agg(first(start).alias("start_date"), first(end).alias("end_date"))
    return spans.withColumn("days", F.datediff("end_date", "start_date")).where("days > 0")


def pick_by_priority(candidates: DataFrame, priorities: dict[str, int], key: str = "case_id", kind: str = "kind", value: str = "value", tie: str = "doc_id") -> DataFrame:
    """M2. Per key the non-empty value whose kind has the least priority number; ties go to the smaller `tie`."""
    rank = reduce(lambda c, p: c.when(F.col(kind) == p[0], p[1]), priorities.items(), F.when(F.lit(False), 0))
    good = candidates.withColumn("_rank", rank).where(F.col("_rank").isNotNull() & (F.trim(F.coalesce(value, F.lit(""))) != ""))
    return good.groupBy(key).agg(F.min_by(value, F.struct("_rank", tie)).alias(value))


def with_group(spans: DataFrame, picked: DataFrame, cases: DataFrame, key: str = "case_id", value: str = "value", fallback: str = "ministry", default: str = NO_MINISTRY) -> DataFrame:
    """M2. spans with their group: the picked value, else the case's own, else the default."""
    own = F.when(F.trim(F.col(fallback)) != "", F.col(fallback))
    joined = spans.join(picked, key, "left").join(cases.select(key, fallback), key, "left")
    return joined.withColumn("grouping", F.coalesce(value, own, F.lit(default))).drop(value, fallback)


def velocity_by_group(spans: DataFrame, group: str = "grouping") -> DataFrame:
    """M3. Count, rounded mean, least, most and rounded median of days per group, by count."""
    days = F.col("days")
    out = spans.groupBy(group).agg(F.count("*").alias("process_count"), rounded(F.avg(days)).alias("avg_days"), F.min(days).alias("min_days"), F.max(days).alias("max_days"), rounded(F.percentile(days, 0.5)).alias("median_days"))
    return out.orderBy(F.col("process_count").desc(), group)


def velocity_summary(spans: DataFrame) -> DataFrame:
    """M4. One row over all cases; zeros when there are none."""
    days = F.col("days")
    return spans.agg(F.count("*").alias("total_processes"), zero(rounded(F.avg(days))).alias("overall_avg_days"), zero(F.min(days)).alias("overall_min_days"), zero(F.max(days)).alias("overall_max_days"))


def participation(responses: DataFrame, invites: DataFrame, actors: DataFrame | None = None, unknown: str = "Unknown") -> DataFrame:
    """M5. Per actor: responses, invites, rate in per cent (null if never invited), cases answered without an invite.

    Both sides are summed per (actor, case) once; the pairs' full join then gives all four numbers, so one exchange by
    pair and one by actor is all there is. Rows without an actor are left out.
    """
    pairs = lambda df, name: df.where("actor_id is not null").groupBy("actor_id", "case_id").agg(F.count("*").alias(name))
    both = pairs(responses, "r").join(pairs(invites, "i"), ["actor_id", "case_id"], "full")
    counts = both.groupBy("actor_id").agg(zero(F.sum("r")).alias("response_count"), zero(F.sum("i")).alias("invite_count"), F.count_if(F.col("i").isNull() & F.col("case_id").isNotNull()).alias("uninvited_responses"))
    counts = counts.withColumn("response_rate", percent(F.col("response_count"), F.col("invite_count")))
    if actors is None:
        return counts
    named = counts.join(actors.select("actor_id", F.col("name").alias("_name")), "actor_id", "left").withColumn("name", F.coalesce("_name", F.lit(unknown))).drop("_name")
    return named.select("actor_id", "name", "response_count", "invite_count", "response_rate", "uninvited_responses")


def participation_summary(parts: DataFrame) -> DataFrame:
    """M6. Totals over M5 and the overall rate (0 without invites)."""
    r, i = F.sum("response_count"), F.sum("invite_count")
    return parts.agg(zero(r).alias("total_responses"), zero(i).alias("total_invites"), F.count("*").alias("total_entities"), zero(percent(r, i)).alias("overall_response_rate"))


def influence(responses: DataFrame, invites: DataFrame, date: Column) -> DataFrame:
    """M7. Four rows per actor: answers, invites and distinct cases as a share of the corpus maximum, and the share of
    the actor's commonest stance; per cent with two decimals and the evidence as JSON."""
    answers = responses.where("actor_id is not null").groupBy("actor_id").agg(F.count("*").alias("subs"), F.count_distinct("case_id").alias("cases"))
    stances = responses.where("actor_id is not null and stance is not null").groupBy("actor_id", "stance").agg(F.count("*").alias("n"))
    stances = stances.groupBy("actor_id").agg(F.max("n").alias("top"), F.sum("n").alias("all"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stance", "n"))))).alias("dist"))
    asked = invites.where("actor_id is not null").groupBy("actor_id").agg(F.count("*").alias("invs"))
    per = answers.join(asked, "actor_id", "full").join(stances, "actor_id", "left").select("actor_id", zero(F.col("subs")).alias("subs"), zero(F.col("cases")).alias("cases"), zero(F.col("invs")).alias("invs"), "top", "all", "dist")
    most = per.agg(*(F.greatest(F.lit(1), zero(F.max(c))).alias(f"max_{c}") for c in ("subs", "cases", "invs")))
    per = per.crossJoin(F.broadcast(most))  # one row
    nothing = F.lit(None).cast("long")

    def row(kind, score, subs, cases, evidence):
        return F.struct(F.lit(kind).alias("influence_type"), rounded(score, 2).alias("influence_score"), subs.alias("total_submissions"), cases.alias("case_count"), evidence.alias("evidence"))

    share = lambda c: F.col(c) / F.col(f"max_{c}") * 100
    json = lambda name, c: F.to_json(F.struct(F.col(c).alias(name), F.col(f"max_{c}").alias("max_in_corpus")))
    rows = F.explode(F.array(
        row("remissvar_frequency", share("subs"), F.col("subs"), nothing, json("raw_count", "subs")),
        row("invitation_rate", share("invs"), nothing, nothing, json("raw_count", "invs")),
        row("stance_consistency", F.coalesce(F.col("top") / F.col("all") * 100, F.lit(0.0)), F.col("subs"), nothing, F.concat(F.lit('{"stance_distribution":'), F.coalesce("dist", F.lit("{}")), F.lit("}"))),
        row("cross_case_breadth", share("cases"), nothing, F.col("cases"), json("distinct_remiss_processes", "cases")),
    ))
    return per.select("actor_id", rows.alias("r")).select("actor_id", "r.*", date.alias("calculation_date"))


def influence_composite(long: DataFrame, actors: DataFrame, unknown: str = "Okänd") -> DataFrame:
    """M8. One row per actor at the latest date: the four scores, their weighted mean, submissions and cases."""
    latest = long.agg(F.max("calculation_date").alias("_latest"))
    long = long.join(F.broadcast(latest), F.col("calculation_date") == F.col("_latest"), "left_semi")
    score = lambda k: F.coalesce(F.max(F.when(F.col("influence_type") == k, F.col("influence_score"))), F.lit(0.0))
    wide = long.groupBy("actor_id").agg(*(score(k).alias(k) for k in INFLUENCE_WEIGHTS), zero(F.max(F.when(F.col("influence_type") == "remissvar_frequency", F.col("total_submissions")))).alias("total_submissions"), zero(F.max("case_count")).alias("case_count"))
    mean = reduce(lambda a, b: a + b, (F.col(k) * w for k, w in INFLUENCE_WEIGHTS.items()))
    wide = wide.withColumn("composite_score", rounded(mean, 2))
    return wide.join(actors.select("actor_id", F.col("name").alias("_name")), "actor_id", "left").withColumn("name", F.coalesce("_name", F.lit(unknown))).drop("_name")


def top_influencers(long: DataFrame, actors: DataFrame, limit: int = 200) -> DataFrame:
    """M9. The rows of the latest date with their actors, by falling score."""
    latest = long.agg(F.max("calculation_date").alias("_latest"))
    rows = long.join(F.broadcast(latest), F.col("calculation_date") == F.col("_latest"), "left_semi").join(actors, "actor_id")
    return rows.orderBy(F.col("influence_score").desc(), "influence_type", "actor_id").limit(limit)


def influence_overview(wide: DataFrame, name_like: str | None = None) -> DataFrame:
    """M10. Actors, mean composite, sum of submissions and most cases, of actors whose name holds name_like."""
    if name_like:
        wide = wide.where(F.contains(F.lower("name"), F.lit(name_like.lower())))
    return wide.agg(F.count("*").alias("actors"), zero(rounded(F.avg("composite_score"), 2)).alias("avg_composite"), zero(F.sum("total_submissions")).alias("total_submissions"), zero(F.max("case_count")).alias("max_cases"))


def coverage(docs: DataFrame, kind: str, conditions: dict[str, Column]) -> DataFrame:
    """M24, M30. Per kind the rows and how many meet each condition, in one pass."""
    return docs.groupBy(kind).agg(F.count("*").alias("total"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def linked_average(docs: DataFrame, facts: DataFrame, key: str, kind: str) -> DataFrame:
    """M24. Per kind the mean number of facts a document, one decimal; documents without facts count as 0."""
    per = facts.groupBy(key).agg(F.count("*").alias("n"))
    return docs.join(per, key, "left").groupBy(kind).agg(F.count("*").alias("documents"), zero(F.sum("n")).alias("facts"), rounded(zero(F.sum("n")) / F.count("*"), 1).alias("per_document"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """M24. Rows of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in tables.items()))


def consultation_coverage(documents: DataFrame, consultations: DataFrame) -> DataFrame:
    """M25. Of all documents (doc_id): how many have a consultation (parent_id), the per cent, and all consultations."""
    has = documents.join(consultations.where("parent_id is not null").select(F.col("parent_id").alias("doc_id")).distinct().withColumn("_has", F.lit(True)), "doc_id", "left")
    out = has.agg(F.count("*").alias("documents"), F.count_if(F.col("_has")).alias("with_consultation"))
    return out.crossJoin(F.broadcast(consultations.agg(F.count("*").alias("consultations")))).withColumn("coverage", zero(percent(F.col("with_consultation"), F.col("documents"))))


def without_consultation(documents: DataFrame, consultations: DataFrame, limit: int = 15) -> DataFrame:
    """M25. The first documents that have none, by number."""
    return documents.join(consultations.select(F.col("parent_id").alias("doc_id")), "doc_id", "left_anti").orderBy("doc_number", "doc_id").limit(limit)


def by_method(consultations: DataFrame, path: str = "$.discovery_method") -> DataFrame:
    """M25. Consultations by how they were found, a field of their metadata."""
    return consultations.groupBy(F.coalesce(F.get_json_object("metadata", path), F.lit("unknown")).alias("method")).agg(F.count("*").alias("n"))


def distribution(rows: DataFrame, col: str, empty: str = "unknown") -> DataFrame:
    """M26, M29. Counts by value, null as `empty`, with the share of all rows."""
    from pyspark.sql import Window

    out = rows.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(empty)).alias(col)).agg(F.count("*").alias("n"))
    return out.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 2))


def with_counts(cases: DataFrame, bridge: DataFrame, key: str, order: str, name: str = "document_count") -> DataFrame:
    """M27. cases with how many bridge rows each has, newest first."""
    per = bridge.groupBy(key).agg(F.count("*").alias("_n"))
    return cases.join(per, key, "left").withColumn(name, zero(F.col("_n"))).drop("_n").orderBy(F.col(order).desc(), key)


def document_list(docs: DataFrame, kinds: list[str] | None = None, state: Column | None = None) -> DataFrame:
    """M27. Documents of the kinds and state asked for."""
    out = docs if kinds is None else docs.where(F.col("doc_type").isin(kinds))
    return out if state is None else out.where(state)


def facets(docs: DataFrame, columns: list[str]) -> DataFrame:
    """M28. The distinct non-empty values of each column: one explode and one aggregate, whatever the number of columns."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return docs.select(pairs.alias("p")).select("p.*").where("value is not null and value <> ''").distinct()


def task_stats(tasks: DataFrame) -> DataFrame:
    """M29. Tasks by type and status."""
    return tasks.groupBy("task_type", "status").agg(F.count("*").alias("n"))


def recent(rows: DataFrame, ts: str, key: str, n: int = 20) -> DataFrame:
    """M29. The latest n rows."""
    return rows.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def pipeline_counts(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """M30. Per doc_type: documents, with text, summarised, embedded, missing text."""
    done = summaries.groupBy("doc_id").agg(F.lit(True).alias("_summarised"), F.bool_or(F.col("embedding").isNotNull()).alias("_embedded"))
    text = F.coalesce(F.length("text") > 0, F.lit(False))
    return coverage(docs.join(done, "doc_id", "left"), "doc_type", {"with_text": text, "missing_text": ~text, "summarised": F.col("_summarised").isNotNull(), "embedded": F.coalesce("_embedded", F.lit(False))})
