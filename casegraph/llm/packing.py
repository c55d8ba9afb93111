"""Sum-of-squares packing of token sequences into fixed-length training sequences."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import WordTokenizer
from .words import slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most length ids of every document (doc_id, text): its ids, then end_id.

    Only documents of more than length ids are cut, every length ids; the last piece may be shorter. Null text is
    empty and gives one piece that holds end_id alone. Rows with equal doc_id are pieces of their own. No column but
    doc_id and text is read. with_ids adds the ids themselves.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches):
        import pyarrow as pa

        codec = WordTokenizer.at(tokenizer)
        for batch in slices(batches, "text", 4 << 20):
            ids, offsets = codec.encode(batch.column("text"))
            out: dict[str, list] = {k.split()[0]: [] for k in schema.split(", ")}
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(own), length)):
                    part = own[start : start + length]
                    for name, value in zip(out, (doc, k, start, len(part), zlib.crc32(part), part), strict=False):
                        out[name].append(value)
            kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size by the sum-of-squares rule, larger sizes first.

    counts[g] is the number of open bins with gap g. A size goes into the open bin, of those it fits in, that makes the
    sum of the squared counts smallest (counts[g] falls, counts[g - size] rises); a new bin opens only where none fits,
    which with larger sizes first needs fewer bins than the rule that weighs a new bin too. A closed bin (gap 0) is in
    no count. Ties go to the smallest gap.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    n_bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        # the change of the sum of squares: 2 - 2 counts[g] for the gap that goes, 1 + 2 counts[g - size] for the new one
        rise = 1 + 2 * counts[: capacity + 1 - size]
        rise[0] = 0  # a bin that is full leaves the counts
        change = rise + 1 - 2 * counts[size:]
        change[counts[size:] == 0] = np.iinfo(np.int64).max
        at = int(np.argmin(change))
        if counts[at + size]:
            gap = at + size
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            open_bins[gap - size].append(b)
    return bins, offsets


def pack(pieces: DataFrame, length: int = 2048, shard_rows: int = 40_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...): sequences of at most length ids.

    Full pieces are sequences of their own. The others go to shards of about shard_rows by a hash of their place in the
    written table of pieces, so a task holds bounded rows even if all rows share their doc_id, or are equal; each shard
    is packed alone by sum_of_squares, and leaves a few sequences open at most. sequence_id is the shard's number times 2^32 plus the
    sequence's number there; full pieces take numbers from the upper half. Equal rows are packed each for itself.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    rows = pieces.where(F.col("length") < length).count()
    shards = max(1, -(-rows // shard_rows))
    kept = [f.name for f in pieces.schema.fields]
    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def one(pdf):
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", na_position="last").reset_index(drop=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), length)
        base = int(pdf["shard"].iloc[0]) << 32 if len(pdf) else 0
        return pdf[kept].assign(sequence_id=bins + base, offset=offsets)

    small = keyed.where(F.col("length") < length).groupBy("shard").applyInPandas(one, schema)
    full = keyed.where(F.col("length") >= length).select(*kept, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return small.unionByName(full)


def best_fit_packing(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most length ids; see token_pieces and pack."""
    return pack(token_pieces(docs, tokenizer, length, end_id), length)
