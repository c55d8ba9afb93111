"""The same jobs as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.entities import link_responses
from ..operators.stance import stance
from ..sources.scratch import written
from ..sources.stored import read_table, rows_beside, upsert_table
from ..sources.tables import dedupe_keep_oldest


def table_sink(path: str, source: str, on_conflict="update") -> Callable[[DataFrame, int], None]:
    """X1. Puts each batch of a stream into the stored table at path, once: see upsert_table."""
    return lambda df, number: None if upsert_table(df, path, on_conflict, source, number) else None


def stream_responses(answers: DataFrame, entities: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """X1. A stream of answers (id, responding_organization, entity_id, match_confidence, text): each batch is linked to
    entities, judged by its text, and handed to write(batch, number); a table_sink upserts it by id, and a batch that
    comes twice has no further effect. Returns the started query over what is there now."""

    def batch(df: DataFrame, number: int) -> None:
        linked = link_responses(df, entities)
        write(linked.join(stance(df.select("id", "text")), "id"), number)

    return answers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_events(events: DataFrame, delay: str = "7 days", keys: tuple[str, ...] = ("case_id", "event_type", "event_date")) -> DataFrame:
    """X2. Events once for each key within the watermark of ts; later ones are dropped and counted by the query."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_events_once(events: DataFrame, kept: str, late: str, counts: str, checkpoint: str, delay: str = "7 days", keys: tuple[str, ...] = ("case_id", "event_type", "event_date"), ts: str = "ts", id: str = "event_id"):
    """X2. A stream of events into three stored tables: kept (by keys, each once: the first by ts and id), late (by id), and
    counts (by batch: rows, late, added, duplicates, watermark).

    A batch's watermark is the latest ts of the batches before it less `delay`; rows older than it are late, whatever their
    key, and go to a table of their own where a rule that drops them would lose them. The others are kept unless their
    key is there. Each table takes a batch once, and the watermark stands in counts, so a batch that comes again after a
    failure between the tables is split as it was the first time. Returns the started query."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = written(df, "events")
        before = read_table(spark, counts).where(F.col("batch") < number).agg(F.max("latest").alias("latest"))
        split = rows.crossJoin(F.broadcast(before)).withColumn("_late", F.coalesce(F.col(ts) < F.col("latest") - F.expr(f"INTERVAL {delay}"), F.lit(False))).drop("latest")
        split = written(split, "split")
        first = dedupe_keep_oldest(split.where("not _late").drop("_late"), list(keys), ts, [id])
        known = rows_beside(first, kept).where(F.col("batch") < number).select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = reduce(lambda a, b: a & b, (first[k].eqNullSafe(known[f"_{k}"]) for k in keys))
        fresh = written(first.join(known, same, "left_anti").withColumn("batch", F.lit(number).cast("long")), "fresh")
        upsert_table(fresh, kept, "ignore", checkpoint, number)
        upsert_table(split.where("_late").drop("_late").withColumn("batch", F.lit(number).cast("long")), late, "update", checkpoint, number)
        n = split.agg(F.count("*").alias("rows"), F.count_if("_late").alias("late"), F.max(ts).alias("newest"))
        n = n.crossJoin(F.broadcast(fresh.agg(F.count("*").alias("added")))).crossJoin(F.broadcast(before))
        n = n.select(F.lit(number).cast("long").alias("batch"), "rows", "late", "added", (F.col("rows") - F.col("late") - F.col("added")).alias("duplicates"), F.greatest("newest", "latest").alias("latest"))
        upsert_table(n, counts, "update", checkpoint, number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def task_counts(events: DataFrame, kind: str = "event_type", window: str = "1 hour", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """X3. Counts by window of ts and kind; a slide makes windows overlap. In append mode a window is given out once, when the
    watermark (the latest ts less delay) has passed its end; rows of closed windows are dropped."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = events.withWatermark("ts", delay).groupBy(at.alias("w"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")


def stream_velocity(events: DataFrame, start: str, end: str, case: str = "case_id", kind: str = "event_type", delay: str = "1 day", keep: str = "7 days") -> DataFrame:
    """X4. The earliest start and end of each case so far and the days between, in update mode: a row whenever they change
    and a last one, closed, when the state goes. Columns: case_id, start_ts, end_ts, days, closed.

    State is two times a case. Of a case that has both it goes once the watermark (the latest ts less delay) is `keep` past its
    last event, so what stays is the open cases and the freshly ended ones. Events older than the watermark are dropped by
    Spark and counted in the query's progress: so is a start date that comes that late. An event of a case whose state
    has gone opens a new one; a sink that takes the least start and end of a case (earliest_span) is right all the same.
    The state is kept in RocksDB, to which the session's later streams are set too; a checkpoint of the earlier form of this
    stream can't be carried on.
    """
    import pandas as pd
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    far = 1 << 62  # no time yet

    class Spans(StatefulProcessor):
        # called for each case of a batch, so times are numbers here, and columns Spark's before and after
        def init(self, handle) -> None:
            self.handle = handle
            self.span = handle.getValueState("span", "start_us long, end_us long, last_us long, goes_ms long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            start_us, end_us, last_us, goes_ms = before = self.span.get() or (far, far, 0, 0)
            for r in rows:
                start_us, end_us = (start_us, min(end_us, r.us)) if r.ended else (min(start_us, r.us), end_us)
                last_us = max(last_us, r.us)
            goes = 0 if far in (start_us, end_us) else max(last_us // 1000 + keep_ms, timerValues.getCurrentWatermarkInMs() + 1)
            if goes != goes_ms:
                if goes_ms:
                    self.handle.deleteTimer(goes_ms)
                self.handle.registerTimer(goes)
            if (after := (start_us, end_us, last_us, goes)) != tuple(before):
                self.span.update(after)
            if (start_us, end_us) != tuple(before[:2]):
                yield Row(case_id=key[0], start_us=start_us, end_us=end_us, closed=False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            start_us, end_us, *_ = self.span.get()
            self.span.clear()
            yield Row(case_id=key[0], start_us=start_us, end_us=end_us, closed=True)

        def close(self) -> None:
            pass

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select(F.col(case).alias("case_id"), F.col(kind).alias("kind"), "ts").withWatermark("ts", delay).where(F.col("kind").isin(start, end))
    rows = rows.select("case_id", "ts", F.unix_micros("ts").alias("us"), (F.col("kind") != start).cast("int").alias("ended"))
    schema = f"case_id {rows.schema['case_id'].dataType.simpleString()}, start_us long, end_us long, closed boolean"
    out = rows.groupBy("case_id").transformWithState(Spans(), schema, "Update", "EventTime")
    at = lambda c: F.timestamp_micros(F.nullif(F.col(c), F.lit(far)))
    out = out.select("case_id", at("start_us").alias("start_ts"), at("end_us").alias("end_ts"), "closed")
    return out.select("case_id", "start_ts", "end_ts", F.datediff("end_ts", "start_ts").alias("days"), "closed")


def earliest_span(new: DataFrame, old: DataFrame) -> DataFrame:
    """X4. How rows of stream_velocity meet those of a stored table: the least start and end of each case, closed as the
    latest row says."""
    others = [c for c in old.columns if c not in ("start_ts", "end_ts", "days", "closed")]
    both = new.withColumn("_turn", F.lit(1)).unionByName(old.withColumn("_turn", F.lit(0)))
    least = both.groupBy(*others).agg(F.min("start_ts").alias("start_ts"), F.min("end_ts").alias("end_ts"), F.max(F.struct("_turn", "closed")).alias("_last"))
    return least.select(*others, "start_ts", "end_ts", F.datediff("end_ts", "start_ts").alias("days"), F.col("_last.closed").alias("closed"))
