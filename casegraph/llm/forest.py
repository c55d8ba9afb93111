"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .dense import best_of_each, dimension, each, finite, inner_products, matrix, top

_INDEX = "shard long, tree int, hashes binary, places binary, ids binary, vectors binary"
BITS = 32


def _planes(dim: int, trees: int, seed: int) -> np.ndarray:
    """The directions whose signs make the hash strings: BITS for each tree, over dim components and one for the norm."""
    return np.random.default_rng(seed).standard_normal((dim + 1, trees * BITS))


def hash_strings(x: np.ndarray, planes: np.ndarray, norm: float | None) -> np.ndarray:
    """Rows of BITS-bit strings, a column per tree, first bit highest.

    Inner products become angles: a row counts as (x / norm, sqrt(1 - |x|^2 / norm^2)), norm being the largest of all
    rows; a query (norm None) as (x / |x|, 0).
    """
    if norm is None:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.hstack([unit, np.zeros((len(x), 1))])
    else:
        unit = x / norm
        unit = np.hstack([unit, np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1, keepdims=True)))])
    out = np.zeros((len(x), planes.shape[1] // BITS), np.uint32)
    for t in range(out.shape[1]):
        signs = unit @ planes[:, t * BITS : (t + 1) * BITS] > 0
        out[:, t] = signs @ (np.uint32(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint32))
    return out


class Forest:
    """The trees of one shard: for each the sorted hash strings and the places of their rows."""

    def __init__(self, table, dim: int):
        rows = {r["tree"]: r for r in table.to_pylist()}
        data = rows.pop(-1)
        self.ids = np.frombuffer(data["ids"], "<i8")
        self.vectors = np.frombuffer(data["vectors"], "<f8").reshape(len(self.ids), dim)
        distinct, self.number = np.unique(self.ids, return_inverse=True)
        self.distinct = len(distinct)
        self.single = self.vectors.astype(np.float32)
        self.hashes = [np.frombuffer(rows[t]["hashes"], "<u4") for t in range(len(rows))]
        self.places = [np.frombuffer(rows[t]["places"], "<i4") for t in range(len(rows))]

    def prefix_ranges(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the range of the strings that share its first `level` bits."""
        low = np.uint32((1 << (BITS - level)) - 1)
        first = np.empty(strings.shape, np.int32)
        last = np.empty(strings.shape, np.int32)
        for t, h in enumerate(self.hashes):
            first[:, t] = np.searchsorted(h, strings[:, t] & ~low, side="left")
            last[:, t] = np.searchsorted(h, strings[:, t] | low, side="right")
        return first, last

    def candidates(self, strings: np.ndarray, wanted: int):
        """(query, places) of each query's candidates: from the longest matches on, all trees ascend a bit at a time
        until their matches number `wanted` together or the root is reached."""
        left = np.arange(len(strings))
        for level in range(BITS, -1, -1):
            first, last = self.prefix_ranges(strings[left], level)
            done = (last - first).sum(axis=1) >= wanted if level else np.ones(len(left), dtype=bool)
            for i in np.flatnonzero(done):
                found = np.zeros(len(self.ids), dtype=bool)
                for places, a, b in zip(self.places, first[i].tolist(), last[i].tolist(), strict=True):
                    found[places[a:b]] = True
                yield int(left[i]), np.flatnonzero(found)
            left = left[~done]
            if not len(left):
                return

    def nearest(self, query_id: int, query: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k highest inner products of different ids among the places, in double precision."""
        repeated = self.distinct < len(self.ids)
        places = places[self.ids[places] != query_id]
        if len(places) > 8 * k:  # single precision sorts out what can't be among the k
            rough = self.single[places] @ query.astype(np.float32)
            error = 1e-5 * float(np.linalg.norm(query)) * self.norm
            if np.isfinite(rough).all() and np.isfinite(error):
                most = rough
                if repeated:  # the kth of different ids
                    most = np.full(self.distinct, -np.inf, np.float32)
                    np.maximum.at(most, self.number[places], rough)
                kth = np.partition(most, len(most) - k)[len(most) - k] if len(most) >= k else -np.inf
                places = places[rough >= kth - 2 * error]
        scores = inner_products(self.vectors[places], query)
        if repeated:
            once = best_of_each(scores, self.ids[places])
            places, scores = places[once], scores[once]
        best = top(scores, self.ids[places], k)
        return self.ids[places][best], scores[best]

    @property
    def norm(self) -> float:
        if not hasattr(self, "_norm"):
            self._norm = float(np.sqrt((self.vectors * self.vectors).sum(axis=1).max(initial=0.0)))
        return self._norm


def hash_prefix_forest(vectors: DataFrame, is_query, k: int = 20, trees: int = 64, share: float = 0.7, least: int = 2_000, shard_rows: int = 16_384, query_rows: int = 2_048, seed: int = 11) -> DataFrame:
    """The k nearest found for each query among all other rows of vectors (vec_id, embedding): largest inner product.

    Rows are dealt by a hash of vec_id into shards of about shard_rows; in each, every tree is a sorted array of
    32-bit hash strings (signs of random directions). A query descends in every tree to its longest prefix matches
    and ascends in all trees together, a bit at a time, until the matches number max(least, share * rows of the shard);
    whole levels are taken, nothing is capped. Candidates are scored on the original vectors in double precision, summed
    from the first component to the last. The share is what vectors without structure need for a recall of 0.9: it is
    measured in the README, and clustered vectors do with less.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; a query with fewer candidates has
    fewer rows. Vectors that are null, zero, or hold null, NaN or infinite components take no part, nor do rows with
    a null vec_id; shorter vectors end in zeros. Of candidates with equal vec_id the best counts; queries with equal
    vec_id are one query if their vectors are equal and else share one list. Other columns are not read.

    A task holds one shard and one block of queries; the driver gets three numbers (rows, dimension, largest norm).
    """
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & finite("vector"))
    good = good.withColumn("square", square).where(F.exists("vector", lambda x: x != 0))
    facts = good.agg(F.count("*").alias("n"), F.max("square").alias("s")).first()
    dim, norm = dimension(good, "vector"), float(np.sqrt(facts["s"] or 1.0)) or 1.0
    shards = max(1, -(-facts["n"] // shard_rows))

    def build(key, table):
        import pyarrow as pa

        x, ids = matrix(table.column("vector"), dim), table.column("vec_id").to_numpy()
        if len(np.unique(ids)) < len(ids):  # equal rows are one, or they would fill the matches that an ascent counts
            kept = np.sort(np.unique(np.column_stack([ids.view(np.float64), x]).view(f"V{8 * (dim + 1)}").ravel(), return_index=True)[1])
            x, ids = x[kept], ids[kept]
        strings = hash_strings(x, _planes(dim, trees, seed), norm)
        rows = [(-1, None, None, ids.astype("<i8").tobytes(), x.astype("<f8").tobytes())]
        for t in range(trees):
            order = np.argsort(strings[:, t], kind="stable")
            rows.append((t, strings[order, t].astype("<u4").tobytes(), order.astype("<i4").tobytes(), None, None))
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4)], names=[c.split()[0] for c in _INDEX.split(", ")])

    dealt = good.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), "vec_id", "vector")
    index = written(dealt.groupBy("shard").applyInArrow(build, _INDEX), "forest")
    asked = good.where("is_query").select(F.col("vec_id").alias("q"), F.col("vector").alias("query")).distinct()
    parts = max(1, -(-good.where("is_query").count() // query_rows))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("q", F.lit(1)), F.lit(parts)))
    asked = asked.withColumn("shard", each(shards))
    copies = index.withColumn("part", each(parts))

    def search(key, trees_of_shard, queries):
        import pyarrow as pa

        out: list[list] = [[], [], []]
        if len(trees_of_shard) and len(queries):
            forest, q, ids = Forest(trees_of_shard, dim), matrix(queries.column("query"), dim), queries.column("q").to_pylist()
            wanted = max(least, int(np.ceil(share * len(forest.ids))))
            for i, places in forest.candidates(hash_strings(q, _planes(dim, trees, seed), None), wanted):
                found, scores = forest.nearest(ids[i], q[i], places, k)
                out[0] += [ids[i]] * len(found)
                out[1] += found.tolist()
                out[2] += scores.tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = copies.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
