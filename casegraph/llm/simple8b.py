"""Token ids in Simple-8b words: an encoder and a decoder over whole arrays, and block files that Spark writes and reads."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, total_bytes
from .tokens import WordTokenizer
from .words import slices

#: Values in a word, and bits of each, for the selectors 0 to 14. Selector 15 is the escape: the next
#: word is one value as it is.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (1, 60))
#: Values in a block; every block starts at a word of its own.
BLOCK = 512


def _width(bits: int) -> int:
    """The width of the narrowest selector that holds so many bits, 64 for none."""
    return min((w for _, w in SELECTORS if w >= bits), default=64)


_WIDTHS = np.array([_width(b) for b in range(18)], np.uint8)[np.frexp(np.arange(1 << 17))[1]]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offsets of the blocks and the end) of unsigned 64-bit values; all blocks advance together."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    padded = np.zeros(blocks * block + 256, np.uint64)
    padded[:n] = values
    bits = _WIDTHS[np.minimum(padded, np.uint64(len(_WIDTHS) - 1))]
    large = np.flatnonzero(padded >= len(_WIDTHS))
    size = np.frexp(padded[large].astype(np.float64))[1]
    huge = np.flatnonzero(size > 50)  # doubles may round these up
    size[huge] = [int(x).bit_length() for x in padded[large[huge]].tolist()]
    bits[large] = np.array([_width(b) for b in range(65)], np.uint8)[size]
    # the selector for each place: the first that holds as many values as stand there
    choice = np.full(len(padded), 15, np.uint8)
    reach = {1: bits}  # reach[c]: the most bits among the c values from each place on, the places themselves at the end
    for c in range(2, 8):
        reach[c] = reach[c - 1].copy()
        np.maximum(reach[c][: 1 - c], bits[c - 1 :], out=reach[c][: 1 - c])
    for k in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[k]
        if count in reach:
            np.putmask(choice, reach[count] <= width, k)
    # selectors of more values are for narrow ones, which are rare: only where seven of them stand
    narrow = np.flatnonzero(reach[7] <= max(w for c, w in SELECTORS if c > 7))
    for k in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[k]
        if count > 7 and len(narrow):
            wide = np.append(np.flatnonzero(bits > width), len(bits) + 240)
            choice[narrow[wide[np.searchsorted(wide, narrow)] - narrow >= count]] = k
    counts = np.array([c for c, _ in SELECTORS] + [1], np.int64)
    at = np.arange(blocks, dtype=np.int64) * block
    ends = np.minimum(at + block, n)
    left = np.arange(blocks, dtype=np.int64)
    pieces = []
    while len(left):
        here = at[left]
        s = choice[here].astype(np.int64)
        pieces.append((left, here, s))
        at[left] = here + counts[s]
        left = left[at[left] < ends[left]]
    which = np.concatenate([p[0] for p in pieces])
    order = np.argsort(which, kind="stable")
    which, here, s = which[order], np.concatenate([p[1] for p in pieces])[order], np.concatenate([p[2] for p in pieces])[order]
    places = np.cumsum(1 + (s == 15)) - 1 - (s == 15)
    words = np.zeros(int(places[-1]) + 1 + int(s[-1] == 15), np.uint64)
    words[places] = s.astype(np.uint64) << np.uint64(60)
    for k, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(s == k)
        if len(own) and width:
            stop = ends[which[own]]
            for j in range(count):
                place = here[own] + j
                words[places[own]] |= np.where(place < stop, padded[place], np.uint64(0)) << np.uint64(j * width)
    own = np.flatnonzero(s == 15)
    words[places[own] + 1] = padded[here[own]]
    per_block = np.bincount(which, weights=1 + (s == 15), minlength=blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_block)])


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values that encode() packed."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    words = np.ascontiguousarray(words, dtype=np.uint64)
    s = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (s == 15).any():  # a word behind an escape is no selector; escapes may follow one another
        i = 0
        marks = np.flatnonzero(s == 15)
        for m in marks.tolist():
            if m >= i:
                raw[m + 1] = True
                i = m + 2
    heads = np.flatnonzero(~raw)
    s = s[heads]
    which = np.searchsorted(offsets, heads, side="right") - 1
    counts = np.array([c for c, _ in SELECTORS] + [1], np.int64)[s]
    run = np.cumsum(counts) - counts
    first = np.searchsorted(which, np.arange(len(offsets) - 1))
    start = run - run[first][which] + which * block
    stop = np.minimum((which + 1) * block, n)
    for k, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(s == k)
        if len(own) and width:
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                place = start[own] + j
                ok = place < stop[own]
                out[place[ok]] = (words[heads[own[ok]]] >> np.uint64(j * width)) & mask
    own = np.flatnonzero(s == 15)
    out[start[own]] = words[heads[own] + 1]
    return out


#: A file row: documents in doc_id order, how many ids each has, and their ids in Simple-8b words with block offsets.
FILE_SCHEMA = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("chunk", T.IntegerType()),
    T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("block_offsets", T.ArrayType(T.IntegerType())),
    T.StructField("words", T.BinaryType()),
])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, shard_bytes: int = 24 << 20) -> None:
    """Writes the ids of every document (doc_id, text), end_id behind each, in ascending doc_id order.

    The documents are range-partitioned by (doc_id, text) into shards of about shard_bytes of text; each is a file of
    rows FILE_SCHEMA, a row for about 4 MB of text (a longer document is a row of its own). Null text has end_id
    alone; a null doc_id stands first; rows with equal doc_id each keep their place. Other columns aren't read.
    """
    import pyarrow as pa

    docs = docs.select("doc_id", "text")
    shards = max(1, -(-total_bytes(docs, "text") // shard_bytes))
    ordered = docs.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def blocks(batches):
        from pyspark import TaskContext

        codec, shard, chunk = WordTokenizer.at(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 4 << 20):
            ids, offsets = codec.encode(batch.column("text"))
            lengths = np.diff(offsets) + 1
            values = np.insert(ids, offsets[1:], np.uint32(end_id))
            words, at = encode(values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(values)], pa.int64()),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([words.astype("<u8").tobytes()], pa.binary()),
                ],
                FILE_SCHEMA.names,
            )
            chunk += 1

    ordered.mapInArrow(blocks, FILE_SCHEMA).write.parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of files by write_tokens: doc_id, start (ids before it in all files), n_tokens, ids_crc32 (, ids).

    The start is the document's place in its row plus prefix sums over the rows' counts, which are sums within a shard
    and then over the shards, one row a file.
    """
    import pyarrow as pa
    from pyspark.sql import Window

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    rows = files.select("shard", "chunk", "n_ids")
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("shard_start", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "shard_start")
    before = rows.withColumn("row_start", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")).join(shards, "shard").select("shard", "chunk", (F.col("shard_start") + F.col("row_start")).alias("base"))
    schema = "shard int, chunk int, doc_id long, place long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values = decode(np.frombuffer(row["words"], "<u8"), np.array(row["block_offsets"], np.int64), row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - np.array(row["lengths"])
                parts = [values[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(parts)
                out = [
                    pa.array([row["shard"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                ]
                if with_ids:
                    out.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])

    read = files.mapInArrow(documents, schema)
    return read.join(before, ["shard", "chunk"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the token files into a new folder of the shared directory and returns what read_tokens reads from them."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(spark, path)
