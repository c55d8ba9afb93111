"""Stored tables and streams: replays, failures, late rows, state that goes, windows that close."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from casegraph.sources import stored
from casegraph.sources.scratch import new_path
from casegraph.streaming import streams


def files(path):
    return {os.path.join(top, n) for top, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, n=100):
    path = new_path(spark, "table")
    stored.create_table(spark.createDataFrame([(i, f"old {i}") for i in range(n)], "id long, v string"), path, ["id"], 16)
    return path


def test_upsert_rewrites_touched_buckets_only(spark):
    path = table(spark)
    before = files(path)
    new = spark.createDataFrame([(7, "new 7"), (1000, "new 1000"), (7, "other 7")], "id long, v string")
    assert stored.upsert_table(new, path)
    assert rows(stored.read_table(spark, path)) == sorted([(i, f"old {i}") for i in range(100) if i != 7] + [(7, "new 7"), (1000, "new 1000")], key=str)
    record = stored._record(spark, path)
    fresh = {b for b, folder in record["holds"].items() if folder != stored._record(spark, path, 0)["holds"].get(b)}
    assert len(fresh) <= 2 and before < files(path)
    assert rows(stored.read_table(spark, path, 0)) == sorted(((i, f"old {i}") for i in range(100)), key=str)
    gone = stored.keep_versions(spark, path, 1)
    assert gone == len(fresh & set(stored_buckets(before))) and len(files(path) & before) == len(before) - gone
    assert stored.read_table(spark, path).count() == 101 and stored.versions(spark, path) == [1]


def stored_buckets(paths):
    return [p.split("_bucket=")[1].split("/")[0] for p in paths]


def test_ignore_functions_nulls_and_empty_batches(spark):
    path = table(spark, 3)
    stored.upsert_table(spark.createDataFrame([(1, "no"), (None, "null id"), (5, None)], "id long, v string"), path, "ignore")
    stored.upsert_table(spark.createDataFrame([(None, "later")], "id long, v string"), path)
    stored.upsert_table(spark.createDataFrame([], "id long, v string"), path)
    assert rows(stored.read_table(spark, path)) == sorted([(0, "old 0"), (1, "old 1"), (2, "old 2"), (None, "later"), (5, None)], key=str)
    longest = lambda new, old: new.unionByName(old).groupBy("id").agg(F.max_by("v", F.length("v")).alias("v"))
    stored.upsert_table(spark.createDataFrame([(2, "x"), (0, "much longer"), (0, "y")], "v_ long, v string").withColumnRenamed("v_", "id"), path, lambda new, old: longest(new, old).withColumn(stored.BUCKET, F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")))
    assert dict(rows(stored.read_table(spark, path).where("id in (0, 2)"))) == {0: "much longer", 2: "old 2"}
    with pytest.raises(ValueError):
        stored.create_table(stored.read_table(spark, path), path, ["id"])


def test_a_batch_counts_once_whatever_fails(spark, monkeypatch):
    path, batch = table(spark, 4), spark.createDataFrame([(1, "a"), (9, "b")], "id long, v string")
    expected = sorted([(0, "old 0"), (1, "a"), (2, "old 2"), (3, "old 3"), (9, "b")], key=str)
    commit = stored._commit
    monkeypatch.setattr(stored, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost before the commit")))
    with pytest.raises(OSError):
        stored.upsert_table(batch, path, source="s", batch=0)
    monkeypatch.setattr(stored, "_commit", commit)
    assert stored.read_table(spark, path).count() == 4 and stored.last_batch(spark, path, "s") is None
    assert stored.upsert_table(batch, path, source="s", batch=0) and rows(stored.read_table(spark, path)) == expected
    after = files(path)
    assert not stored.upsert_table(spark.createDataFrame([(1, "again")], "id long, v string"), path, source="s", batch=0)
    assert files(path) == after and rows(stored.read_table(spark, path)) == expected
    assert stored.upsert_table(spark.createDataFrame([(1, "c")], "id long, v string"), path, source="other", batch=0)
    assert stored.last_batch(spark, path, "s") == 0 and stored.keep_versions(spark, path, 1) > 0  # the lost write's files too
    assert stored.read_table(spark, path).count() == 5


def test_the_slower_writer_fails(spark):
    path = table(spark, 2)
    record = stored._record(spark, path)
    stored._commit(spark, path, record | {"version": 1})
    with pytest.raises(RuntimeError):
        stored._commit(spark, path, record | {"version": 1, "holds": {}})
    assert stored.read_table(spark, path).count() == 2


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def stream(spark, batches, schema):
    base = new_path(spark, "in")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{base}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/*")


def test_late_events_are_kept_apart(spark):
    schema = "event_id long, case_id string, event_type string, event_date date, ts timestamp"
    event = lambda i, case, t: (i, case, "hearing", t.date(), t)
    batches = [[event(1, "a", at(2)), event(2, "a", at(2, 5)), event(3, "b", at(3))], [event(4, "a", at(12)), event(5, "b", at(1))], [event(6, "c", at(4)), event(7, "a", at(12, 3)), event(8, "d", at(8)), event(9, None, at(9)), event(10, None, at(9))]]
    base = new_path(spark, "out")
    names = {k: f"{base}/{k}" for k in ("kept", "late", "counts")}
    none = spark.createDataFrame([], schema + ", batch long")
    stored.create_table(none, names["kept"], ["case_id", "event_type", "event_date"], 4)
    stored.create_table(none, names["late"], ["event_id"], 4)
    stored.create_table(spark.createDataFrame([], "batch long, rows long, late long, added long, duplicates long, latest timestamp"), names["counts"], ["batch"], 1)
    rows_in = stream(spark, batches, schema)
    streams.stream_events_once(rows_in, *names.values(), f"{base}/state", "5 days").awaitTermination()
    assert sorted(r["event_id"] for r in stored.read_table(spark, names["kept"]).collect()) == [1, 3, 4, 5, 8, 9]
    assert [r["event_id"] for r in stored.read_table(spark, names["late"]).collect()] == [6]
    assert [tuple(r)[:5] for r in stored.read_table(spark, names["counts"]).orderBy("batch").collect()] == [(0, 3, 0, 2, 1), (1, 2, 0, 2, 0), (2, 5, 1, 2, 2)]


def test_a_batch_that_comes_again_is_split_as_before(spark):
    schema = "event_id long, case_id string, event_type string, event_date date, ts timestamp"
    base = new_path(spark, "out")
    names = {k: f"{base}/{k}" for k in ("kept", "late", "counts")}
    none = spark.createDataFrame([], schema + ", batch long")
    stored.create_table(none, names["kept"], ["case_id", "event_type", "event_date"], 4)
    stored.create_table(none, names["late"], ["event_id"], 4)
    stored.create_table(spark.createDataFrame([], "batch long, rows long, late long, added long, duplicates long, latest timestamp"), names["counts"], ["batch"], 1)
    rows_in = stream(spark, [[(1, "a", "x", at(9).date(), at(9))], [(2, "a", "x", at(2).date(), at(2)), (3, "b", "x", at(9).date(), at(9))]], schema)
    upsert = streams.upsert_table

    def failing(df, path, *a):
        if path == names["late"] and a[-1] == 1 and not failing.done:
            failing.done = True
            raise OSError("lost between two tables")
        return upsert(df, path, *a)

    failing.done = False
    streams.upsert_table = failing
    try:
        query = streams.stream_events_once(rows_in, *names.values(), f"{base}/state", "5 days")
        with pytest.raises(Exception, match="lost between"):
            query.awaitTermination()
        assert stored.read_table(spark, names["kept"]).count() == 2 and stored.read_table(spark, names["late"]).count() == 0
        streams.stream_events_once(rows_in, *names.values(), f"{base}/state", "5 days").awaitTermination()
    finally:
        streams.upsert_table = upsert
    assert sorted(r["event_id"] for r in stored.read_table(spark, names["kept"]).collect()) == [1, 3]
    assert [r["event_id"] for r in stored.read_table(spark, names["late"]).collect()] == [2]
    assert [tuple(r)[:5] for r in stored.read_table(spark, names["counts"]).orderBy("batch").collect()] == [(0, 1, 0, 1, 0), (1, 2, 1, 1, 0)]


def test_state_of_ended_cases_goes(spark):
    schema = "case_id long, event_type string, ts timestamp"
    batches = [[(1, "start", at(1)), (2, "start", at(1)), (3, "start", at(2)), (3, "other", at(1))], [(1, "end", at(3)), (1, "start", at(2)), (2, "end", at(1))], [(3, "start", at(20))], [(3, "start", at(21)), (2, "start", at(2)), (4, "end", at(22))], [(1, "end", at(23))]]
    out, base = [], new_path(spark, "state")
    spans = streams.stream_velocity(stream(spark, batches, schema), "start", "end", delay="1 day", keep="3 days")
    path = f"{base}/cases"
    stored.create_table(spark.createDataFrame([], spans.schema), path, ["case_id"], 2)
    sink = streams.table_sink(path, "spans", streams.earliest_span)

    def batch(df, n):
        out.extend((n, r["case_id"], r["days"], r["closed"]) for r in df.collect())
        sink(df, n)

    query = spans.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(c, d, x) for _, c, d, x in out if x} == {(1, 2, True), (2, 0, True)}  # both ended long before the watermark
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert held[3] * 3 == held[0] * 2 and held[-1] == held[0]  # cases 1 to 3; then 3 and 4; then 1, come again, too
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress) > 0  # case 2's late start
    got = {r["case_id"]: (r["days"], r["closed"]) for r in stored.read_table(spark, path).collect()}
    assert got == {1: (2, False), 2: (0, True), 3: (None, False), 4: (None, False)}


def test_sliding_windows_are_given_out_once(spark):
    schema = "event_type string, ts timestamp"
    batches = [[("a", at(1, h)) for h in range(6)], [("a", at(1, 5)), ("b", at(2, 12))], [("a", at(4))]]
    out = []
    counts = streams.task_counts(stream(spark, batches, schema), window="2 hours", slide="1 hour", delay="6 hours")
    query = counts.writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend((r["window_start"], r["event_type"], r["n"]) for r in df.collect())).option("checkpointLocation", new_path(spark, "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    expected = {}
    for kind, t in [x for b in batches for x in b]:
        for k in (0, 1):
            w = t.replace(minute=0) - dt.timedelta(hours=k)
            if w + dt.timedelta(hours=2) <= at(4) - dt.timedelta(hours=6):
                expected[w, kind] = expected.get((w, kind), 0) + 1
    assert len(out) == len({o[:2] for o in out}) and {o[:2]: o[2] for o in out} == expected


def test_a_case_is_no_frame(spark):
    """Spans come from a state of rows, a case's values in one; a data frame for each case of a batch took most of the time."""
    schema, base = "case_id long, event_type string, ts timestamp", new_path(spark, "state")
    spans = streams.stream_velocity(stream(spark, [[(1, "start", at(1)), (1, "end", at(3, 5)), (1, "start", at(2)), (None, "end", at(1)), (2, "other", at(1))]], schema), "start", "end")
    out = []
    query = spans.writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(out, key=str) == sorted([(1, at(1), at(3, 5), 2, False), (None, None, at(1), None, False)], key=str)
    assert all(s.operatorName.startswith("transformWithState") for p in query.recentProgress for s in p.stateOperators)
