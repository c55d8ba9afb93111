"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: A split between a word's end and the next word's start, for cutting a text behind its first words.
_BEFORE_WORD = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def n_words(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size): share of all sizes by weight, at most `most` times a source's size.

    Sources in code-point order, null last, take the weights in turn. What a source can't take goes to the others by
    weight until no target is above its limit; that is, every target is min(limit, level * weight) for one level, and
    in the order of limit / weight the level is known from sums over the sources before. One row per source; the
    table of sources is all that meets in one window. With share > most every target is its limit.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (k + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(order), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    # the level if the sources before are at their limits; the first that is below its limit has the true level
    found = weighed.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") < F.col("limit"))
    true_level = F.min(F.when(F.col("below"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level"))))
    return found.withColumn("true_level", true_level.over(every)["level"]).select(
        "source", "source_size", F.when(F.col("below") | (F.col("level").isNull()), F.least("limit", F.coalesce(F.col("true_level"), F.lit(0.0)) * F.col("weight"))).otherwise(F.col("limit")).alias("target")
    )


def _groups(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int, bucket_rows: int) -> DataFrame:
    """Rows that are equal in doc_id, text and source as one row with their number n, and what the mix takes of them:
    epochs times all of them, `whole` of them once more, and the first `part` words of a further one."""
    key = F.xxhash64(F.lit(seed), *(F.col(c) for c in ("doc_id", "text")))
    sized = written(docs.select("doc_id", "source", n_words("text").alias("size"), key.alias("key")), "mix")
    rows = sized.count()
    bits = max(0, (max(rows, 1) // bucket_rows).bit_length())
    bucket = F.shiftrightunsigned(F.col("key"), 64 - bits) if bits else F.lit(0).cast("long")
    sized = sized.withColumn("bucket", bucket)
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    # one row per source and bucket: few enough for a window by source
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    same = lambda a, b, *cs: [a[c].eqNullSafe(b[c]) for c in cs]
    plan = starts.join(targets, same(starts, targets, "source")).select(starts["source"].alias("of"), F.col("bucket").alias("at"), "bucket_start", "source_size", "target")
    equal = sized.groupBy("source", "bucket", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("inside", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)))
    placed = placed.join(plan, placed["source"].eqNullSafe(plan["of"]) & (placed["bucket"] == plan["at"])).drop("of", "at")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    room = F.greatest(F.lit(0), F.least(F.col("n") * F.col("size"), budget - F.col("epochs") * F.col("source_size") - F.col("bucket_start") - F.col("inside"))).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("room", room)
    placed = placed.withColumn("part", F.when(F.col("size") > 0, F.pmod("room", "size")).otherwise(F.lit(0)))
    placed = placed.withColumn("whole", F.when(F.col("size") > 0, F.expr("room div size")).otherwise(F.lit(0)))
    return placed.select("doc_id", "source", "key", "size", "n", "source_size", F.col("target").cast("double").alias("target"), "epochs", "whole", "part")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, bucket_rows: int = 2_000) -> DataFrame:
    """What a mix takes of every document: doc_id, source, key, size, source_size, target, taken, epochs, rest.

    Each document gets a hash-random key of (seed, doc_id, text); within a source the documents stand in key order, and
    prefix sums of their words say where the budget is cut. The key's range is divided into buckets of about
    bucket_rows documents: sums per (source, bucket) give each bucket's start, a window inside a bucket the rest, so a
    source that holds a third of all rows is spread over many tasks. A source gives floor(target) words: whole passes
    over it (epochs) and, of a further pass, the first words in key order; the document at the cut gives its first
    `rest` words. So taken = epochs * size + rest, and no document gives more than `most` times its size (rounded up
    to a whole number). Null or empty text has size 0 and gives nothing. Rows with equal doc_id, text and source are
    counted before they are exchanged, however many there are, and become rows again at the end, a thousand at a time.
    The same input gives the same mix, whatever its partitions.
    """
    groups = _groups(docs, weights, share, most, seed, bucket_rows)
    last = F.when(F.col("part") > 0, 1).otherwise(0).cast("long")
    kinds = ((F.col("size"), F.col("whole")), (F.col("part"), last), (F.lit(0), F.col("n") - F.col("whole") - last))
    rests = F.filter(F.array(*(F.struct(rest.cast("long").alias("rest"), rows.cast("long").alias("rows")) for rest, rows in kinds)), lambda x: x["rows"] > 0)
    each = groups.withColumn("of", F.explode(rests)).select("*", "of.rest", "of.rows")
    each = each.withColumn("thousand", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / 1000))))
    each = each.withColumn("row", F.explode(F.array_repeat(F.lit(True), F.least(F.lit(1000), F.col("rows") - F.col("thousand") * 1000).cast("int"))))
    return each.select("doc_id", "source", "key", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"), "epochs", "rest")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, bucket_rows: int = 2_000) -> DataFrame:
    """The mix itself, with the columns of docs: each document epochs times, and once more with its first `rest` words.

    A document of which nothing is taken is not in the mix. Rows that are equal in doc_id, source and text share their
    fate but for those at a source's cut, at most one group of each source: these are numbered, the first ones give whole
    texts, the next one the words at the cut. So the mix holds the words that mix_sources counts, repeated rows too. Such
    groups' hashes are broadcast, up to 10,000 of them, and only their rows are sorted, a group in one task, which
    spills; the join of all other texts with the plan is left to adaptive execution, which splits hot keys. Columns of
    docs may have any names. Empty docs give an empty mix.
    """
    groups = _groups(docs, weights, share, most, seed, bucket_rows)
    taken = groups.where("size > 0 and (epochs > 0 or whole > 0 or part > 0)")
    # texts meet the plan by two hashes
    same = lambda doc, source: F.xxhash64("key", doc.isNull(), doc, source.isNull(), source)
    cut = (F.col("n") > 1) & (F.col("whole") < F.col("n")) & (F.col("left_over") > 0)
    plan = written(taken.withColumn("left_over", F.col("whole") + F.col("part")).select("key", same(F.col("doc_id"), F.col("source")).alias("same"), "size", "epochs", "whole", "part", cut.alias("cut")), "plan")
    cuts = plan.where("cut")
    n_cuts = cuts.count()
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("key"))
    rows = rows.withColumn("same", same(F.col("row.doc_id"), F.col("row.source")))
    both = rows.join(plan.where(~F.col("cut")), ["key", "same"]).withColumn("nth", F.lit(1))
    if n_cuts:
        turn = F.xxhash64(*(F.col("row").getField(c) for c in hashed))
        several = rows.join(F.broadcast(cuts) if n_cuts <= 10_000 else cuts, ["key", "same"])
        both = both.unionByName(several.withColumn("nth", F.row_number().over(Window.partitionBy("key", "same").orderBy(turn))))
    # white space before the first word makes a part of its own
    text, rest = F.col("row.text"), F.when(F.col("nth") <= F.col("whole"), F.col("size")).when(F.col("nth") == F.col("whole") + 1, F.col("part")).otherwise(0)
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    first = F.concat_ws("", F.slice(F.split(text, _BEFORE_WORD), F.lit(1), (rest + lead).cast("int")))
    times = F.concat(F.array_repeat(F.lit(True), F.col("epochs").cast("int")), F.when(rest > 0, F.array(rest == F.col("size"))).otherwise(F.array().cast("array<boolean>")))
    out = both.select("row", F.explode(times).alias("all"), F.rtrim(first).alias("first")).select("row", F.when(F.col("all"), text).otherwise(F.col("first")).alias("taken"))
    new = {"text": F.col("taken")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("taken").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
