"""Stances of consultation answers by rules, and their review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numbers import zero

MASK = "___MASKED___"


def sections(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """P1. (key, section, kind, weight, content): a summary heading starts a section of weight 2, so does one of stance
    or views; all else is body of weight 1. Sections without content go. One window by text, over its lines."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    low = F.lower(F.trim("content"))
    summary = low.contains("sammanfattning") & (F.length(low) < 50)
    stance = (low.contains("ställningstagande") | low.contains("yttrande") | low.contains("synpunkter")) & (F.length(low) < 60)
    lines = lines.withColumn("head", F.when(summary, "summary").when(stance, "stance"))
    lines = lines.withColumn("section", F.sum(F.col("head").isNotNull().cast("int")).over(Window.partitionBy(key).orderBy("line")))
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    out = lines.groupBy(key, "section").agg(F.coalesce(F.max("head"), F.lit("body")).alias("kind"), content.alias("content"))
    return out.where(F.trim(F.regexp_replace("content", r"\s", "")) != "").withColumn("weight", F.when(F.col("kind") == "body", 1.0).otherwise(2.0))


def rule_table(approved: DataFrame | None = None, most: int = 1_000) -> dict[str, tuple[str, ...]]:
    """P8. The stance rules, with approved keywords (keyword, category) as further ones: at most `most`, more raise an
    error, as each is a pattern that all texts are searched for."""
    found = dict(rules.STANCE)
    if approved is not None:
        rows = approved.select("category", "keyword").distinct().orderBy("category", "keyword").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} approved keywords")
        for row in rows:
            found[row["category"]] = (*found.get(row["category"], ()), r"\b" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in row["keyword"]) + r"\b")
    return found


def count_signals(text: Column, positive: dict[str, tuple[str, ...]] | None = None, negated: tuple[str, ...] = rules.STANCE_NEGATED, flags: str = rules.FLAGS) -> dict[str, Column]:
    """P2. Hits of each category and the hits themselves, lower-cased: negated phrases count as opposition and are masked
    before the others are counted."""
    positive = rules.STANCE if positive is None else positive
    hits = lambda c, pattern: F.regexp_extract_all(c, F.lit(f"{flags}({pattern})"), F.lit(1))
    every = lambda c, patterns: F.concat(*(hits(c, p) for p in patterns)) if patterns else F.array().cast("array<string>")
    masked = reduce(lambda c, p: F.regexp_replace(c, flags + p, MASK), negated, text)
    found = {k: every(masked, patterns) for k, patterns in positive.items()}
    found["oppose"] = F.concat(every(text, negated), found.get("oppose", F.array().cast("array<string>")))
    words = F.transform(F.concat(*found.values()), lambda x: F.trim(F.lower(x)))
    return {f"{k}_count": F.size(c) for k, c in found.items()} | {"keywords": words}


def decide(support: Column, oppose: Column, conditional: Column) -> Column:
    """P3. The stance that weighted scores add up to."""
    return (
        F.when((conditional > 0) & (conditional >= support) & (conditional >= oppose), "conditional")
        .when((support > 0) & (support > oppose * 2), "support").when((oppose > 0) & (oppose > support * 2), "oppose")
        .when((support > 0) & (oppose > 0), "mixed").otherwise("neutral")
    )


def stance(texts: DataFrame, key: str = "id", text: str = "text", least: int = 100, **signals) -> DataFrame:
    """P3. Per text: stance, counts, distinct keywords, section context, words. Texts under `least` characters are neutral."""
    base = texts.select(key, F.col(text).alias("_text"))
    long = base.where(F.length("_text") >= least)
    kinds = ("support", "oppose", "conditional", "no_opinion")
    per = sections(long, key, "_text")
    per = per.select(key, "kind", "weight", *(c.alias(n) for n, c in count_signals(F.col("content"), **signals).items()))
    sums = per.groupBy(key).agg(
        *(F.sum(F.col(f"{k}_count") * F.col("weight")).alias(k) for k in kinds), *(F.sum(f"{k}_count").alias(f"{k}_count") for k in kinds),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"), F.bool_or(F.col("kind") == "summary").alias("_summary"), F.bool_or(F.col("kind") == "stance").alias("_stance"),
    )
    out = base.join(sums, key, "left")
    context = F.when(F.col("_summary") & F.col("_stance"), "mixed").when(F.col("_summary"), "summary").when(F.col("_stance"), "stance").otherwise("body")
    words = F.when(F.length("_text") > 0, F.size(F.split("_text", r"\s+"))).otherwise(0)
    return out.select(
        key, F.coalesce(decide(F.col("support"), F.col("oppose"), F.col("conditional")), F.lit("neutral")).alias("stance"), *(zero(F.col(f"{k}_count")).alias(f"{k}_count") for k in kinds),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), context.alias("section_context"), words.alias("word_count"),
    )


def analyze_batch(answers: DataFrame, **signals) -> DataFrame:
    """P4. Answers (id, text, extraction_status, analysis_status) that await analysis, with stance and status: ok, or
    skipped where the text is missing or too short. What an analysis before has found is replaced."""
    waiting = answers.where((F.col("extraction_status") == "ok") & (F.col("analysis_status").isNull() | F.col("analysis_status").isin("not_started", "pending")))
    found = stance(waiting, **signals)
    status = F.when(F.length(F.coalesce("text", F.lit(""))) < 100, "skipped").otherwise("ok")
    return waiting.drop("analysis_status", *(c for c in found.columns if c != "id")).join(found, "id").withColumn("analysis_status", status)


def batch_summary(analyzed: DataFrame) -> DataFrame:
    """P4. Counts by status and stance."""
    return analyzed.groupBy("analysis_status", "stance").agg(F.count("*").alias("n"))


def review_candidates(answers: DataFrame, n: int | None = None) -> DataFrame:
    """P5. Answers for a second look, oldest first: mixed, or neutral without a keyword, and not reviewed yet."""
    some = (F.col("stance") == "mixed") | ((F.col("stance") == "neutral") & (F.size("keywords") <= 0))
    out = answers.where(some & F.col("ai_review").isNull()).orderBy("created_at", "id")
    return out if n is None else out.limit(n)


def review_telemetry(answers: DataFrame) -> DataFrame:
    """P5. How many answers each pool holds."""
    neutral = (F.col("stance") == "neutral") & (F.size("keywords") <= 0)
    return answers.agg(F.count_if((F.col("stance") == "mixed") & F.col("ai_review").isNull()).alias("mixed"), F.count_if(neutral & F.col("ai_review").isNull()).alias("neutral_without_keywords"), F.count_if(F.col("ai_review").isNotNull()).alias("reviewed"))


def apply_labels(answers: DataFrame, labels: DataFrame, threshold: str = "high") -> DataFrame:
    """P6. Labels (id, label, confidence, reason) put to answers: "no stance" phrases make no_position at once, others
    apply at the threshold's rank; lower ones are kept as ai_low_confidence. The audit column says what was there."""
    rank = lambda c: F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)
    none = F.coalesce(F.col("reason").rlike(rules.FLAGS + r"ingen ståndpunkt|tar inte ställning|inget ställningstagande|no (?:clear )?(?:stance|position)"), F.lit(False))
    joined = answers.join(labels.select("id", "label", "confidence", "reason"), "id", "left")
    label = F.when(none, "no_position").otherwise(F.col("label"))
    apply = F.col("label").isNotNull() & (none | (rank(F.col("confidence")) >= rank(F.lit(threshold))))
    audit = F.to_json(F.struct(F.col("stance").alias("previous"), label.alias("label"), F.col("confidence"), F.col("reason"), apply.alias("applied")))
    return joined.withColumn("ai_review", F.when(F.col("label").isNotNull(), audit).otherwise(F.col("ai_review"))).withColumn("analysis_status", F.when(apply, "ai_classified").when(F.col("label").isNotNull(), "ai_low_confidence").otherwise(F.col("analysis_status"))).withColumn("stance", F.when(apply, label).otherwise(F.col("stance"))).drop("label", "confidence", "reason")


def apply_reviews(answers: DataFrame, reviews: DataFrame) -> DataFrame:
    """P7. Manual decisions (id, decision): the corrected stance, or null to confirm the one that is there."""
    joined = answers.join(reviews.select("id", "decision", F.lit(True).alias("_seen")), "id", "left")
    return joined.withColumn("stance", F.coalesce("decision", "stance")).withColumn("analysis_status", F.when(F.col("_seen"), F.when(F.col("decision").isNotNull(), "corrected").otherwise("confirmed")).otherwise(F.col("analysis_status"))).drop("decision", "_seen")


def review_stats(answers: DataFrame) -> DataFrame:
    """P7. The review queue by what its labels' confidence was."""
    waiting = answers.where("analysis_status = 'ai_low_confidence'")
    return waiting.groupBy(F.coalesce(F.get_json_object("ai_review", "$.confidence"), F.lit("unknown")).alias("confidence")).agg(F.count("*").alias("n"))


def keyword_suggestions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """P8. Suggestions (keyword, category, status) with new ones, lower-cased; one that stands and isn't rejected is not added."""
    fresh = new.select(F.lower(F.trim("keyword")).alias("keyword"), "category").where("keyword <> ''").distinct().withColumn("status", F.lit("pending"))
    return existing.unionByName(fresh.join(existing.where("status <> 'rejected'").select("keyword", "category"), ["keyword", "category"], "left_anti"))
