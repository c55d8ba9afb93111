"""Exact top-k search by integer inner product with block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .dense import best_of_each, dimension, each, finite, matrix, top

_INDEX = "shard long, block int, ids array<long>, weights binary, most binary, least binary"
_FOUND = "query_id long, vec_id long, score long, scored long"


def _packed(w: np.ndarray) -> bytes:
    """Whole numbers as 32-bit ones where all fit, else as doubles, which hold floor(scale * x) of a double as it is."""
    return w.astype("<i4" if np.abs(w).max(initial=0) < 2**31 else "<f8").tobytes()


def _unpacked(raw: bytes, dim: int, rows: int | None = None) -> np.ndarray:
    """What _packed() held, as rows of dim doubles; without rows it is one."""
    n = dim * (1 if rows is None else rows)
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * n else "<f8").astype(np.float64).reshape((dim,) if rows is None else (rows, dim))


def _exact_scores(w: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers too large for doubles: by 64-bit or by Python numbers."""
    if np.abs(w).max(initial=0) * np.abs(query).max(initial=0) * max(len(query), 1) < 2.0**62:
        return w.astype(np.int64) @ query.astype(np.int64)
    q = [int(x) for x in query.tolist()]
    sums = [sum(int(x) * y for x, y in zip(row, q, strict=True)) for row in w.tolist()]
    if any(abs(x) >= 1 << 63 for x in sums):
        raise OverflowError("a score does not fit 64 bits")
    return np.array(sums, np.int64)


def block_index(vectors: DataFrame, dim: int, scale: float, shard_rows: int, block_rows: int) -> DataFrame:
    """The index of (vec_id, vector): a row per block of a document range, with its forward index and term maxima.

    Documents are ordered by the signs of their vectors under a fixed random rotation and then by id, range-partitioned
    into shards of about shard_rows and cut into blocks of block_rows; near vectors so share blocks, as far as signs tell.
    A row holds the ids, the forward index (a 32-bit number for each document and term, a double where one is larger),
    and each term's largest and smallest weight in the block.
    """
    rows = vectors.count()
    shards = max(1, -(-rows // shard_rows))
    planes = np.random.default_rng(5).standard_normal((24, max(dim, 1)))

    def with_code(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column("vector"), dim)
            w = np.floor(x * scale)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            signs = (x / np.where(np.isfinite(norm) & (norm > 0), norm, 1.0)) @ planes[:, :dim].T > 0
            code = signs @ (1 << np.arange(len(planes), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(code, pa.int64()), pa.array([_packed(r) for r in w], pa.binary())], ["vec_id", "code", "weights"])

    coded = vectors.mapInArrow(with_code, "vec_id long, code long, weights binary")
    ranged = coded.repartitionByRange(shards, "code", "vec_id").sortWithinPartitions("code", "vec_id")

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, n, ids, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), np.zeros((0, dim))

        def row(ids, w):
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([n], pa.int32()), pa.array([ids], pa.list_(pa.int64()))] + [pa.array([_packed(m)], pa.binary()) for m in (w, w.max(axis=0), w.min(axis=0))],
                [c.split()[0] for c in _INDEX.split(", ")],
            )

        for batch in batches:
            ids = np.concatenate([ids, batch.column("vec_id").to_numpy()])
            held = np.concatenate([held, *(_unpacked(r, dim)[None, :] for r in batch.column("weights").to_pylist())])
            while len(ids) >= block_rows:
                yield row(ids[:block_rows], held[:block_rows])
                ids, held, n = ids[block_rows:], held[block_rows:], n + 1
        if len(ids):
            yield row(ids, held)

    return written(ranged.mapInArrow(blocks, _INDEX), "blocks")


class Shard:
    """Blocks of one shard, as a task holds them."""

    def __init__(self, table, dim: int):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        self.ids = [np.array(r["ids"], np.int64) for r in rows]
        self.weights = [_unpacked(r["weights"], dim, len(r["ids"])) for r in rows]
        self.most = np.array([_unpacked(r["most"], dim) for r in rows]).reshape(len(rows), dim)
        self.least = np.array([_unpacked(r["least"], dim) for r in rows]).reshape(len(rows), dim)
        ids = np.concatenate([np.zeros(0, np.int64), *self.ids])
        self.repeated = len(np.unique(ids)) < len(ids)
        self.largest = max([0.0, *(np.abs(w).max(initial=0) for w in self.weights)])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and block the sum over the terms of the largest product that the block allows."""
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: int | None):
        """The k best (scores, ids) of different ids, or as many as can reach floor, and how many blocks were scored.
        Blocks go by falling bound until it is below the kth."""
        size = self.largest * np.abs(query).max(initial=0) * max(len(query), 1)
        exact = size < 2.0**52  # then doubles hold every sum
        slack = 0.0 if exact else size * 1e-9 + 1
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kth, scored = floor, 0
        for b in np.argsort(-bounds, kind="stable").tolist():
            if kth is not None and bounds[b] + slack < kth:
                break
            scored += 1
            others = np.flatnonzero(self.ids[b] != query_id)
            s = (self.weights[b] @ query)[others].astype(np.int64) if exact else _exact_scores(self.weights[b][others], query)
            if kth is not None:
                others, s = others[s >= kth], s[s >= kth]
            if len(others):
                scores, ids = np.concatenate([scores, s]), np.concatenate([ids, self.ids[b][others]])
                if self.repeated:
                    once = best_of_each(scores, ids)
                    scores, ids = scores[once], ids[once]
                best = top(scores, ids, k)
                scores, ids = scores[best], ids[best]
                if len(scores) == k:
                    kth = int(scores[-1]) if kth is None else max(kth, int(scores[-1]))
        return scores, ids, scored


def _search(vectors: DataFrame, is_query, k: int, scale: float, shard_rows: int, block_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """(candidates query_id, vec_id, score, scored of all shards that may hold one of the k best; the index)."""
    import pyarrow as pa

    good = vectors.select("vec_id", F.col("embedding").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & finite("vector"))
    dim = dimension(good, "vector")
    index = block_index(good.select("vec_id", "vector"), dim, scale, shard_rows, block_rows)
    chosen = good.where("is_query").select(F.col("vec_id").alias("q"))
    located = index.select(F.col("shard").alias("home"), F.col("block").alias("in_block"), F.posexplode("ids").alias("place", "q")).join(chosen.distinct(), "q", "left_semi")
    longs = pa.list_(pa.int64())

    def home(key, blocks, queries):
        shard = Shard(blocks, dim)
        at = {b: i for i, b in enumerate(sorted(blocks.column("block").to_pylist()))}
        rows = queries.to_pylist()
        vectors = np.array([shard.weights[at[r["in_block"]]][r["place"]] for r in rows], np.float64).reshape(len(rows), dim)
        bounds, out = shard.bounds(vectors), [[], [], [], []]
        for i, r in enumerate(rows):
            scores, ids, scored = shard.search(r["q"], vectors[i], bounds[i], k, None)
            for column, value in zip(out, (_packed(vectors[i]), ids, scores, scored), strict=True):
                column.append(value)
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int64()), queries.column("q"), pa.array(out[0], pa.binary()), pa.array(out[1], longs), pa.array(out[2], longs), pa.array(out[3], pa.int64())], names=["home", "q", "weights", "ids", "scores", "scored"])

    first = written(index.groupBy("shard").cogroup(located.groupBy("home")).applyInArrow(home, "home long, q long, weights binary, ids array<long>, scores array<long>, scored long"), "home")
    # term maxima of whole shards: (block of shards, block of queries) pairs give the pairs of shard and query that may
    # hold one of the k best; nothing else is copied
    queries = first.count()
    parts = max(1, -(-queries // query_rows))
    asked = first.withColumn("part", F.pmod(F.xxhash64("q", "home"), F.lit(parts))).withColumn("floor", F.when(F.size("scores") == k, F.element_at("scores", -1))).select("part", "home", "q", "weights", "floor")
    last = index.agg(F.max("shard").alias("m")).first()["m"]
    groups = 0 if last is None else last // query_rows + 1

    def of_shard(_, table):
        most = np.max([_unpacked(r, dim) for r in table.column("most").to_pylist()], axis=0)
        least = np.min([_unpacked(r, dim) for r in table.column("least").to_pylist()], axis=0)
        return pa.table([table.column("shard").slice(0, 1), pa.array([_packed(most)], pa.binary()), pa.array([_packed(least)], pa.binary())], names=["shard", "most", "least"])

    shards = index.select("shard", "most", "least").groupBy("shard").applyInArrow(of_shard, "shard long, most binary, least binary")
    shards = shards.withColumn("group", F.floor(F.col("shard") / query_rows)).withColumn("part", each(parts))

    def may_hold(_, shards, queries):
        out = [[], [], [], [], []]
        if len(shards) and len(queries):
            most, least = (np.array([_unpacked(r, dim) for r in shards.column(c).to_pylist()]) for c in ("most", "least"))
            numbers = shards.column("shard").to_numpy()
            for r in queries.to_pylist():
                q = _unpacked(r["weights"], dim)
                bound = most @ np.maximum(q, 0) + least @ np.minimum(q, 0)
                slack = 1 + 1e-9 * (np.maximum(np.abs(most), np.abs(least)) @ np.abs(q))
                good = numbers != r["home"]
                if r["floor"] is not None:
                    good &= bound + slack >= r["floor"]
                found = numbers[good].tolist()
                for column, value in zip(out, (found, *([r[c]] * len(found) for c in ("part", "q", "weights", "floor"))), strict=True):
                    column += value
        return pa.table([pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["shard", "part", "q", "weights", "floor"])

    visits = shards.groupBy("group", "part").cogroup(asked.withColumn("group", each(groups)).groupBy("group", "part")).applyInArrow(may_hold, "shard long, part long, q long, weights binary, floor long")
    visits = written(visits, "visits")
    wanted = visits.select(F.col("shard").alias("at"), F.col("part").alias("of")).distinct()
    copies = index.join(wanted, F.col("shard") == F.col("at")).select(*index.columns, F.col("of").alias("part"))

    def elsewhere(key, blocks, queries):
        if not len(blocks) or not len(queries):
            return pa.table([pa.array([], pa.int64())] * 4, names=["query_id", "vec_id", "score", "scored"])
        shard, rows, out = Shard(blocks, dim), queries.to_pylist(), [[], [], [], []]
        vectors = np.array([_unpacked(r["weights"], dim) for r in rows])
        bounds = shard.bounds(vectors)
        for i, r in enumerate(rows):
            scores, ids, scored = shard.search(r["q"], vectors[i], bounds[i], k, r["floor"])
            out[0] += [r["q"]] * (len(ids) + 1)
            out[1] += [*ids.tolist(), None]
            out[2] += [*scores.tolist(), None]
            out[3] += [*[0] * len(ids), scored]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score", "scored"])

    second = copies.groupBy("shard", "part").cogroup(visits.groupBy("shard", "part")).applyInArrow(elsewhere, _FOUND)
    pairs = F.explode_outer(F.arrays_zip("ids", "scores"))
    found = first.select(F.col("q").alias("query_id"), pairs.alias("p")).select("query_id", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"), F.lit(0).cast("long").alias("scored"))
    at_home = first.select(F.col("q").alias("query_id"), *(F.lit(None).cast("long").alias(c) for c in ("vec_id", "score")), "scored")
    return found.unionByName(at_home).unionByName(second), index


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, shard_rows: int = 16_384, block_rows: int = 256, query_rows: int = 4_096) -> DataFrame:
    """The k highest integer inner products of each query among all other rows of vectors (vec_id, embedding).

    Weights are floor(scale * x) of every component, whatever their size; a score beyond 64 bits raises an error. is_query
    is a condition on the rows. Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and a query with fewer candidates has fewer
    rows. Vectors that are null or hold null, NaN or infinite components take no part; shorter vectors end in zeros;
    a null vec_id takes no part. A query never finds a row with its own id; of candidates
    with equal vec_id the best counts, and queries with equal vec_id share one list. Other columns are not read.

    Two passes over an index of document-range blocks (see block_index). In the first every query searches the shard
    that it lies in, among its likeliest neighbours; its kth score there is a floor for the second. There the term maxima
    of whole shards tell which shards a query has to visit; blocks of queries meet those shards and score only blocks
    whose bound reaches the floor. A task holds one shard and one
    block of queries, whatever the size of either side, and returns k rows a query at most.
    """
    found = _search(vectors, is_query, k, scale, shard_rows, block_rows, query_rows)[0].where("vec_id is not null")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def pruning_report(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, shard_rows: int = 16_384, block_rows: int = 256, query_rows: int = 4_096) -> DataFrame:
    """What exact_top_k has to score: a row of queries, blocks and scored (pairs of query and block, out of queries * blocks)."""
    found, index = _search(vectors, is_query, k, scale, shard_rows, block_rows, query_rows)
    return found.agg(F.count_distinct("query_id").alias("queries"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored")).withColumn("blocks", F.lit(index.count()))
