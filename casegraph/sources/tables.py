"""Tables: reading, incremental writing, selection of work, repair and quality."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sanitize
from .scratch import replace

# Aliases of document types; others count as reports.
DOC_TYPES = {"prop": "proposition", "proposition": "proposition", "dir": "directive", "directive": "directive", "bet": "committee_report", "committee_report": "committee_report", "lag": "law", "law": "law"}


def load(spark: SparkSession, path: str, table: str, schema: T.StructType | str | None = None) -> DataFrame:
    """S1. A whole Parquet table below path; with a schema only its columns are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores: for small rows of which much is made, as a small file is read by few tasks."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def one_or_many(c: Column, element: str) -> Column:
    """S3. A JSON field that holds an object or an array of objects, as an array; null is empty."""
    return F.coalesce(F.from_json(c, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """S5. The new rows whose key is not there yet, one for each key (the least row). Null keys compare as equal."""
    first = new.groupBy(*keys).agg(F.min(F.struct(*[c for c in new.columns if c not in keys] or [F.lit(0).alias("_")])).alias("_r"))
    old = existing.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    fresh = first.join(old, same, "left_anti")
    return fresh.select(*(F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in new.columns))


def upsert(new: DataFrame, existing: DataFrame, keys: list[str], on_conflict: str = "update") -> DataFrame:
    """S6. existing with new rows; where keys meet the new row wins (update) or the old one (ignore). One exchange: both
    sides are summed per key with the winner's priority. Of new rows with one key the least counts."""
    wins = {"update": 0, "ignore": 2}[on_conflict]
    rest = [c for c in existing.columns if c not in keys]
    packed = lambda df, p: df.select(*keys, F.lit(p).alias("_p"), F.struct(*rest).alias("_r"))
    both = packed(existing, 1).unionByName(packed(new.select(existing.columns), wins))
    return both.groupBy(*keys).agg(F.min_by("_r", F.struct("_p", "_r")).alias("_r")).select(*(F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in existing.columns))


def full_refresh(df: DataFrame, path: str) -> None:
    """S7. Replaces the table at path, which df may read: df is written beside it, then the folders change places and the
    old one goes. If writing fails the table is as it was."""
    new = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    replace(df.sparkSession, new, path)


def pending(df: DataFrame, conditions: list[Column], order: list[str], limit: int | None = None) -> DataFrame:
    """S8. The rows that await work, in order: all of the conditions hold (null counts as no)."""
    out = df.where(reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions))).orderBy(*order)
    return out if limit is None else out.limit(limit)


def after_cursor(df: DataFrame, key: str, after, n: int) -> tuple[DataFrame, DataFrame]:
    """S9. (the next n rows by key behind `after`, a row with the next cursor)."""
    page = (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(n)
    return page, page.agg(F.max(key).alias("next_cursor"), (F.count("*") == n).alias("more"))


def backfill_text(docs: DataFrame, texts: DataFrame, least: int = 50) -> DataFrame:
    """S10. docs (doc_id, raw_content) with missing texts from texts (doc_id, text) and the reason for each row: kept,
    no_file, html_redirect, too_short, filled."""
    joined = docs.join(texts.select("doc_id", F.col("text").alias("_t")), "doc_id", "left")
    clean = sanitize(F.col("_t"))
    html = F.lower(F.ltrim("_t")).rlike("^(<!doctype html|<html)")
    reason = F.when(F.length("raw_content") > 0, "kept").when(F.col("_t").isNull(), "no_file").when(html, "html_redirect").when(F.length(clean) < least, "too_short").otherwise("filled")
    return joined.withColumn("reason", reason).withColumn("raw_content", F.when(F.col("reason") == "filled", clean).otherwise(F.col("raw_content"))).drop("_t")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """S10. (doc_id, text) of text files, the name without its ending as id."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def canonical_type(c: Column) -> Column:
    """S11. A document type without its aliases."""
    return reduce(lambda w, x: w.when(F.lower(c) == x[0], x[1]), DOC_TYPES.items(), F.when(F.lit(False), "")).otherwise("sou")


def balanced_batch(docs: DataFrame, done: DataFrame, n: int, types: list[str], key: str = "doc_id", kind: str = "doc_type", order: str = "created_at") -> DataFrame:
    """S11. n documents at most, an even quota for each of the types (the remainder to the first), oldest first, without
    those that are done. Each task keeps a type's quota before the exchange."""
    quota = reduce(lambda w, x: w.when(F.col(kind) == x[1], n // len(types) + (x[0] < n % len(types))), enumerate(types), F.when(F.lit(False), 0)).otherwise(0)
    left = docs.where(F.col(kind).isin(types)).join(done.select(key), key, "left_anti")
    turn = Window.partitionBy(kind).orderBy(order, key)
    return left.withColumn("_n", F.row_number().over(turn)).where((F.col("_n") <= n // len(types) + 1) & (F.col("_n") <= quota)).drop("_n")


def dedupe_keep_oldest(df: DataFrame, keys: list[str], ts: str, tie: list[str]) -> DataFrame:
    """S12. One row for each key, the oldest (then the least by tie); sums before the exchange, so hot keys stay small."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(ts, *tie)).alias("_r"))
    return first.select(*(F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns))


def integrity_report(edges: DataFrame, nodes: DataFrame, ends: tuple[str, str] = ("source_id", "target_id"), node: str = "id") -> DataFrame:
    """S13. For either end of the edges how many point to no node."""
    ids = nodes.select(F.col(node).alias("_id")).distinct()
    parts = [edges.where(F.col(e).isNotNull()).join(ids, F.col(e) == F.col("_id"), "left_anti").agg(F.lit(e).alias("end"), F.count("*").alias("dangling")) for e in ends]
    return reduce(DataFrame.unionByName, parts)


def citation_quality(tables: dict[str, DataFrame], page: str = "source_page", excerpt: str = "source_excerpt") -> DataFrame:
    """S14. Per table: rows, with page, with excerpt, coverage in per cent (2 decimals; null when empty), and rows with one
    of the two only."""
    has = lambda c: F.col(c).isNotNull()
    both = F.count_if(has(page) & has(excerpt))
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("total"), F.count_if(has(page)).alias("with_page"), F.count_if(has(excerpt)).alias("with_excerpt"), F.round(both * 100 / F.nullif(F.count("*"), F.lit(0)), 2).alias("coverage"), F.count_if(has(page) != has(excerpt)).alias("violations")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def backfill_const(df: DataFrame, target: str, condition: Column, value) -> DataFrame:
    """S15. df with value in target where the condition holds."""
    return df.withColumn(target, F.when(condition, F.lit(value)).otherwise(F.col(target)))


def apply_texts(docs: DataFrame, extracted: DataFrame, least: int = 100) -> DataFrame:
    """S16. docs (doc_id, doc_type, raw_content, metadata) with extraction results (doc_id, text, pages, bytes, error,
    file_kind): cleaned text, status ok, error, skipped (too short) or not_pdf, and counts in the metadata. A report
    whose text starts like a directive gets a contamination_warning."""
    r = extracted.select("doc_id", F.col("text").alias("_t"), "pages", "bytes", "error", "file_kind", F.lit(True).alias("_has"))
    joined = docs.join(r, "doc_id", "left").withColumn("_t", sanitize(F.col("_t")))
    status = F.when(F.col("_has").isNull(), None).when(F.col("file_kind") != "pdf", "not_pdf").when(F.col("error").isNotNull(), "error").when(F.length("_t") < least, "skipped").otherwise("ok")
    warning = (F.col("doc_type") == "sou") & F.lower("_t").rlike(r"^(dir\.|direktiv)")
    facts = F.to_json(F.struct(F.coalesce("metadata", F.lit("{}")).alias("previous"), F.length("_t").alias("characters"), "pages", "bytes", "error", F.when(warning, True).alias("contamination_warning")))
    joined = joined.withColumn("extraction_status", status)
    ok = F.col("extraction_status") == "ok"
    return joined.withColumn("raw_content", F.when(ok, F.col("_t")).otherwise(F.col("raw_content"))).withColumn("metadata", F.when(F.col("extraction_status").isNotNull(), facts).otherwise(F.col("metadata"))).drop("_t", "_has", "pages", "bytes", "error", "file_kind")
