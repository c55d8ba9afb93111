"""WARC files of pages, and their index merged from sorted capture runs."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path

_ENTRY = "run string, seq long, urlkey string, ts string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long"
END = "\r\n\r\n"


def url_key(url: Column) -> Column:
    """A key that sorts pages by site: the host's labels from the last to the first, ")", path and query; lower case,
    without scheme, user, port, leading www and fragment. Null gives an empty key."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), r"^www\d*\.", "")
    path = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def capture_time(page_id: Column, first: str = "2024-01-01 00:00:00") -> Column:
    """When a page counts as captured: page_id seconds after `first`, as pages have no time of their own."""
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(first)) + F.coalesce(page_id, F.lit(0)) % (1 << 31)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 1_000, file_bytes: int = 12 << 20) -> None:
    """Writes a WARC 1.1 record for each row of pages (page_id, url, html) to gzip files below path.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least least_bytes bytes, that
    with the largest page_id is a response; the others are revisit records, which name it and have no block. Each file
    is a run: its records are in the order of URL key, time and page_id. Rows that share page_id are records of their
    own (revisits refer to the id): each is a revisit or a response by its own payload. A null page_id is less than all
    others and never refers to another. Files hold about file_bytes of payload, by the mean of the rows; other columns
    are not read.

    Digests meet without payloads, and their largest page_id is found with sums before the exchange. Which rows are
    revisits is a table of page_id and digest, and a payload moves at most once, to meet it. Where a third of the rows share
    page_id and payload adaptive execution splits the join, and each part makes runs of its own.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    page = page.withColumn("digest", F.sha1(F.encode("payload", "utf-8"))).withColumn("bytes", F.octet_length("payload"))
    own = page.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("page_id", "digest").agg(F.lit(True).alias("large"))
    last = own.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    revisits = own.join(last, "digest").where("page_id < last").select("page_id", "digest", F.col("last").alias("refers_to"))
    size = page.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    file_rows = max(1, size["n"] * file_bytes // max(size["bytes"], 1))
    page = page.join(revisits, ["page_id", "digest"], "left").withColumn("again", F.col("refers_to").isNotNull())
    page = page.withColumn("key", url_key(F.col("url"))).withColumn("ts", capture_time(F.col("page_id")))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), line("WARC-Record-ID", name("page_id")), line("WARC-Date", F.col("ts")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", safe)).otherwise(""), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(F.col("again"), "0").otherwise(F.col("bytes").cast("string"))),
    )
    record = F.concat(head, F.lit(END), F.when(F.col("again"), "").otherwise(F.col("payload")))
    page.sortWithinPartitions("key", "ts", "page_id").select(record.alias("value")).write.option("maxRecordsPerFile", file_rows).text(path, compression="gzip", lineSep=END)


_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r]*)")


def parse_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes, int]]:
    """(headers, block, offset) of each record of a WARC file; blocks are as long as Content-Length says."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        stop = data.index(b"\r\n\r\n", at)
        headers = dict(_HEADER.findall(data[at:stop]))
        size = int(headers[b"Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, block, at
        at = stop + 4 + size + 4


def read_runs(spark, path: str) -> DataFrame:
    """The index entries of the files below path, in each file's order. A response's bytes and digest are taken from its
    block and held against its headers; a revisit's come from its headers, as its payload stands in another record."""
    import pyarrow as pa

    def entries(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out: dict[str, list] = {c.split()[0]: [] for c in _ENTRY.split(", ")}
                number = lambda x: None if x in (b"none", None) else int(x)
                for seq, (h, block, offset) in enumerate(parse_records(gzip.decompress(content.as_py()))):
                    digest, size = h[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), int(h[b"WARC-Payload-Length"])
                    kind = h[b"WARC-Type"].decode()
                    if kind == "response":
                        if hashlib.sha1(block).hexdigest() != digest or len(block) != size:
                            raise ValueError(f"{file}: the payload at byte {offset} is not what its headers say")
                    refers = h.get(b"WARC-Refers-To")
                    values = (file, seq, h.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), h[b"WARC-Date"].decode(), number(h[b"WARC-Record-ID"][12:-1]), kind, size, digest, number(refers[12:-1]) if refers else None, offset)
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, {"run": pa.string(), "urlkey": pa.string(), "ts": pa.string(), "record_type": pa.string(), "payload_digest": pa.string()}.get(k, pa.int64())) for k, v in out.items()], list(out))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(entries, _ENTRY).withColumn("urlkey", url_key(F.col("urlkey")))


def merge_runs(runs: list[Iterator]) -> Iterator:
    """The items of sorted runs in order, by a loser tree: each inner node holds the loser of its match, so an item
    that leaves costs one match on each level of its path. Equal items leave in the order of their runs."""
    runs = [iter(r) for r in runs]
    k = len(runs)
    done = object()
    heads = [next(r, done) for r in runs]

    def beats(i: int, j: int) -> bool:
        if heads[i] is done or heads[j] is done:
            return heads[j] is done and (heads[i] is not done or i < j)
        return heads[i] < heads[j] or heads[i] == heads[j] and i < j

    losers = [-1] * max(k, 1)

    def play(node: int) -> int:
        """The winner below a node; leaves are k to 2k - 1."""
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (a, b) if beats(a, b) else (b, a)
        return winner

    if not k:
        return
    winner = play(1) if k > 1 else 0
    while heads[winner] is not done:
        yield heads[winner]
        heads[winner] = next(runs[winner], done)
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def merged_index(runs: DataFrame, part_rows: int = 50_000) -> DataFrame:
    """The entries of all runs in one order of URL key, time and page_id: each site's and page's capture history.

    The keys are range-partitioned, so each task gets the slices of all runs that lie in its range, and merges these.
    A URL that a third of the captures have is spread by time and page_id, captures that are equal in these by their places in the runs. The result's partitions follow one another
    in order; `place` numbers the rows of each.
    """
    rows = runs.count()
    n = max(1, -(-rows // part_rows))
    ranged = runs.repartitionByRange(n, "urlkey", "ts", "page_id", "run", "seq").sortWithinPartitions("run", "seq")
    names = [c.split()[0] for c in _ENTRY.split(", ")]

    def merge(batches):
        import pyarrow as pa

        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        by_run: dict[str, list] = {}
        columns = [table.column(c).to_pylist() for c in ("run", "urlkey", "ts", "page_id")]
        for i, (run, key, ts, page) in enumerate(zip(*columns, strict=True)):
            by_run.setdefault(run, []).append((key, ts, page is not None, page or 0, i))
        order = [item[-1] for item in merge_runs(list(by_run.values()))]
        out = table.take(pa.array(order, pa.int64())).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from out.combine_chunks().to_batches()

    return ranged.select(*names).mapInArrow(merge, _ENTRY + ", place long")


def archive(pages: DataFrame, least_bytes: int = 1_000) -> DataFrame:
    """Writes pages into WARC files in the shared folder, reads them back and merges their index; see write_warc.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, then urlkey, ts, run, offset, place. An
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, least_bytes)
    index = merged_index(read_runs(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "run", "offset", "place")
