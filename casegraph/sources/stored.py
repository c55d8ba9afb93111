"""Stored tables: rows bucketed by key, upserts that rewrite touched buckets only, and commits that a replay leaves alone.

A table is a folder. Rows lie in data/<write>/_bucket=<number>; a commit is one small record, commits/<version>.json, that
says for each bucket which write holds it and which batch of each source came last. A version stands once its record
has its name, so readers see whole versions, and what a failed write left behind belongs to none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written
from .tables import upsert

BUCKET = "_bucket"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _fs(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, from the first to the last."""
    files, make = _fs(spark, path)
    folder = make(f"{path}/commits")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _record(spark: SparkSession, path: str, version: int | None = None) -> dict:
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no table, or no version {version}, at {path}")
    files, make = _fs(spark, path)
    stream = files.open(make(f"{path}/commits/{known[-1] if version is None else version}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, record: dict) -> None:
    """Gives the record its name; of two writers of one version the second fails, and its rows belong to no version."""
    files, make = _fs(spark, path)
    files.mkdirs(make(f"{path}/commits"))
    new, name = make(f"{path}/commits/{uuid.uuid4().hex}.tmp"), make(f"{path}/commits/{record['version']}.json")
    out = files.create(new, False)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    if files.exists(name) or not files.rename(new, name):
        files.delete(new, False)
        raise RuntimeError(f"version {record['version']} of {path} is there already: another writer was faster")


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)


def _write(df: DataFrame, path: str) -> str:
    """Writes rows with their bucket to a folder of their own; a bucket is one task's, so it is one file."""
    folder = f"data/{uuid.uuid4().hex}"
    df.write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    return folder


def create_table(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Stores df, with one row for each key, as version 0 of a new table. A bucket is rewritten by one task: take as many
    buckets as give about 128 MB each. The commit record has a line for each."""
    spark = df.sparkSession
    if versions(spark, path):
        raise ValueError(f"there is a table at {path}")
    none = df.limit(0)
    rows = upsert(df, none, keys).select("*", _bucket(keys, buckets)).repartition(F.col(BUCKET))
    folder = _write(rows.select(*df.columns, BUCKET), path)
    held = spark.read.schema(T.StructType([T.StructField(BUCKET, T.IntegerType())])).parquet(f"{path}/{folder}").distinct().collect()
    _commit(spark, path, {"version": 0, "keys": keys, "buckets": buckets, "schema": df.schema.jsonValue(), "holds": {str(r[BUCKET]): folder for r in held}, "batches": {}})


def _of(spark: SparkSession, path: str, record: dict, only: list[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets, with their bucket."""
    schema = T.StructType.fromJson(record["schema"])
    at = {int(b): folder for b, folder in record["holds"].items() if only is None or int(b) in only}
    empty = spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0))
    if not at:
        return empty
    rows = spark.read.schema(schema).parquet(*(f"{path}/{folder}/{BUCKET}={b}" for b, folder in sorted(at.items())))
    return rows.select("*", _bucket(record["keys"], record["buckets"]))


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the last or the given version."""
    return _of(spark, path, _record(spark, path, version)).drop(BUCKET)


def rows_beside(new: DataFrame, path: str) -> DataFrame:
    """The rows of the buckets that rows of new (with the table's keys) fall into: all that may share a key with them."""
    spark = new.sparkSession
    record = _record(spark, path)
    touched = [r[BUCKET] for r in new.select(_bucket(record["keys"], record["buckets"])).distinct().collect()]
    return _of(spark, path, record, touched).drop(BUCKET)


def last_batch(spark: SparkSession, path: str, source: str) -> int | None:
    """The number of the last batch of a source that the table holds."""
    return _record(spark, path)["batches"].get(source)


def upsert_table(new: DataFrame, path: str, on_conflict: str | Merge = "update", source: str | None = None, batch: int | None = None) -> bool:
    """S6. Puts new rows into the table at path; whether it did.

    Where keys meet the new row wins (update), the old one (ignore), or both are given to a function (new, old) -> rows
    with one row for each key. Of new rows with one key the least counts, for a function all do. Only buckets that a new
    row falls into are read and written; the files of the others stay as they are. With a source and a batch number the
    call has no effect if that batch, or a later one, of the source is there: a stream may give a batch twice and may
    start again after a failure at any point, as rows and batch number become visible together, by one rename.
    """
    spark = new.sparkSession
    record = _record(spark, path)
    if source is not None and record["batches"].get(source, -1) >= batch:
        return False
    keys, buckets = record["keys"], record["buckets"]
    columns = [f["name"] for f in record["schema"]["fields"]]
    rows = written(new.select(*columns).select("*", _bucket(keys, buckets)), "batch")
    touched = sorted(r[BUCKET] for r in rows.select(BUCKET).distinct().collect())
    holds = dict(record["holds"])
    if touched:
        old = _of(spark, path, record, touched).repartition(F.col(BUCKET))
        rows = rows.repartition(F.col(BUCKET))
        # the bucket is a key too, so rows that are together by bucket are not dealt out again
        merged = on_conflict(rows, old) if callable(on_conflict) else upsert(rows, old, [BUCKET, *keys], on_conflict)
        folder = _write(merged.select(*columns, BUCKET), path)
        holds |= {str(b): folder for b in touched}
    batches = record["batches"] | ({source: batch} if source is not None else {})
    _commit(spark, path, record | {"version": record["version"] + 1, "holds": holds, "batches": batches})
    return True


def keep_versions(spark: SparkSession, path: str, n: int = 2) -> int:
    """Removes all versions but the last n, and files that none of these holds: also what failed writes left. How many
    folders went. No writer may be at work."""
    files, make = _fs(spark, path)
    known = versions(spark, path)
    records = [_record(spark, path, v) for v in known[-n:]]
    used = {f"{folder}/{BUCKET}={b}" for r in records for b, folder in r["holds"].items()}
    for v in known[:-n]:
        files.delete(make(f"{path}/commits/{v}.json"), False)
    gone = 0
    for write in files.listStatus(make(f"{path}/data")):
        name, left = write.getPath().getName(), 0
        for part in files.listStatus(write.getPath()):
            here = f"data/{name}/{part.getPath().getName()}"
            if part.isDirectory() and here not in used:
                files.delete(part.getPath(), True)
                gone += 1
            left += here in used
        if not left:
            files.delete(write.getPath(), True)
    return gone
