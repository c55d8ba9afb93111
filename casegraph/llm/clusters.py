"""Centroid clustering of vectors in exact integers, with bounds that spare most distances (Shallot search)."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import remove
from .common import new_path
from .dense import finite

#: Integers up to this size, and centroids of them, have squared distances of 64 components in 64 bits.
NARROW = 1 << 26
#: Distances beyond this are taken as infinite where they are upper bounds and as this where they are lower bounds.
FAR = 1e300
#: Bits of one part of a sum: parts are summed by Spark as longs and put together on the driver.
PART = 32
#: A block of vectors as one row: ids, components (int16, int32, int64, or text of longer integers), number of the nearest
#: and the second nearest centroid, upper bound of the distance to the nearest, lower bound of that to any other, the sums
#: of the components by cluster in parts, counts, and how many distances were taken.
_BLOCK = "ids binary, width int, vectors binary, nearest binary, second binary, upper binary, lower binary, sums array<struct<cluster:int,dim:int,part:int,value:long>>, taken long"


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: int64 where it is small, else Python integers."""
    x = vectors.astype(np.float64)
    if not len(x) or np.abs(x).max() * scale < NARROW:
        return np.floor(x * scale).astype(np.int64)
    exact = np.empty(x.shape, object)
    exact.flat = [int(Fraction(v) * scale // 1) for v in x.ravel().tolist()]
    return exact


def pack(x: np.ndarray) -> tuple[int, bytes]:
    """(width, bytes) of whole numbers in the narrowest form; width 0 is text."""
    if x.dtype == object:
        return 0, ",".join(map(str, x.ravel().tolist())).encode()
    most = int(np.abs(x).max()) if x.size else 0
    width = 2 if most < 1 << 15 else 4
    return width, x.astype(f"<i{width}").tobytes()


def unpack(width: int, data: bytes, dim: int) -> np.ndarray:
    """What pack() packed."""
    if width:
        return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(-1, dim)
    parts = data.split(b",")
    out = np.empty((len(parts) // dim, dim), object)
    out.flat = [int(p) for p in parts]
    return out


def _roots(squared) -> np.ndarray:
    """Square roots of whole numbers in floating point; beyond FAR they are infinite."""
    if isinstance(squared, np.ndarray) and squared.dtype != object:
        return np.sqrt(squared.astype(np.float64))
    return np.array([math.sqrt(v) if v < 10**300 else float(r) if (r := math.isqrt(v)) < FAR else np.inf for v in squared], np.float64)


class Centroids:
    """The centroids of one round, the distances between them, and how far each moved since the round before."""

    def __init__(self, rows: list[list[int]], before: Centroids | None = None):
        self.rows = rows
        narrow = all(abs(v) < NARROW for r in rows for v in r)
        k, dim = len(rows), len(rows[0]) if rows else 0
        self.narrow = np.array(rows, np.int64).reshape(k, dim) if narrow else None
        self.wide = np.array(rows, object).reshape(k, dim)
        apart = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
        self.between = _roots([apart(p, q) for p in rows for q in rows]).reshape(k, k)
        self.order = np.argsort(self.between, axis=1, kind="stable")
        # a centroid stands first in its own list even if another is equal to it
        for i in range(k):
            own = self.order[i].tolist()
            own.remove(i)
            self.order[i] = [i, *own]
        self.half = np.array([min(FAR, self.between[i][self.order[i, 1]]) / 2 if k > 1 else FAR for i in range(k)])
        self.moved = np.zeros(k) if before is None else _roots([apart(p, q) for p, q in zip(rows, before.rows, strict=True)])

    def others_moved(self) -> np.ndarray:
        """For each centroid the farthest that any other moved."""
        k = len(self.moved)
        return np.array([max((self.moved[j] for j in range(k) if j != i), default=0.0) for i in range(k)])

    def squared(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of x to a centroid each."""
        if x.dtype != object and self.narrow is not None and x.shape[1] <= 128:
            d = x - self.narrow[which]
            return np.einsum("ij,ij->i", d, d)
        d = x.astype(object) - self.wide[which]
        return (d * d).sum(axis=1) if len(d) else np.zeros(0, object)


#: Bounds are taken this much wider than floating point computes them, so that rounding never spares a needed distance.
_SLACK = 1e-9


def search(x: np.ndarray, c: Centroids, nearest: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Brings each row's nearest and second nearest centroid and its bounds up to date, in place; how many distances it took.

    A row is settled while its upper bound lies below its lower bound or below half the way to the next centroid. Else its
    distances to both remembered centroids are taken, and the search starts from the closer one: through the others in the
    order of their distance from it, within a ball of the row's distance to it plus that to the second nearest so far,
    which shrinks whenever a nearer second is found. Who is nearer is decided on integers, ties to the smaller number.
    """
    k = len(c.rows)
    if k < 2:
        return 0
    sure = lambda own, rows: own * (1 + _SLACK) + _SLACK < np.maximum(lower[rows] * (1 - _SLACK) - _SLACK, c.half[nearest[rows]])
    rows = np.flatnonzero(~sure(upper, slice(None)))
    if not len(rows):
        return 0
    near = c.squared(x[rows], nearest[rows])
    taken = len(rows)
    upper[rows] = _roots(near)
    open_ = ~sure(upper[rows], rows)
    rows, near = rows[open_], near[open_]
    if not len(rows):
        return taken
    a, b = nearest[rows].copy(), second[rows].copy()
    next_ = c.squared(x[rows], b)
    taken += len(rows)
    swap = (next_ < near) | ((next_ == near) & (b < a))
    a[swap], b[swap] = b[swap], a[swap]
    near[swap], next_[swap] = next_[swap], near[swap]
    start, known = a.copy(), b.copy()
    away = _roots(near)
    ball = away + _roots(next_)
    live = np.arange(len(rows))
    for step in range(1, k):
        j = c.order[start[live], step]
        live = live[c.between[start[live], j] <= ball[live] * (1 + _SLACK) + _SLACK]
        if not len(live):
            break
        j = c.order[start[live], step]
        fresh = j != known[live]
        at, j = live[fresh], j[fresh]
        d = c.squared(x[rows[at]], j)
        taken += len(at)
        first = (d < near[at]) | ((d == near[at]) & (j < a[at]))
        then = ~first & ((d < next_[at]) | ((d == next_[at]) & (j < b[at])))
        up, to = at[first], at[then]
        b[up], next_[up] = a[up], near[up]
        a[up], near[up] = j[first], d[first]
        b[to], next_[to] = j[then], d[then]
        for changed in (up, to):
            ball[changed] = away[changed] + _roots(next_[changed])
    nearest[rows], second[rows], upper[rows], lower[rows] = a, b, _roots(near), np.minimum(_roots(next_), FAR)
    return taken


def _sums(x: np.ndarray, nearest: np.ndarray, k: int) -> list[dict]:
    """The exact sums of the components of each cluster, and its count as component -1, in parts of PART bits."""
    out = []
    for cluster in range(k):
        own = x[nearest == cluster]
        if not len(own):
            continue
        for dim, total in enumerate([len(own), *own.sum(axis=0).tolist()], -1):
            sign, total, part = (-1 if total < 0 else 1), abs(int(total)), 0
            while total:
                out.append({"cluster": cluster, "dim": dim, "part": part, "value": sign * (total & (1 << PART) - 1)})
                total, part = total >> PART, part + 1
    return out


def _assign(blocks, c: Centroids, dim: int):
    """Blocks with the state of this round."""
    import pyarrow as pa

    k = len(c.rows)
    others = c.others_moved()
    for batch in blocks:
        for row in batch.to_pylist():
            x = unpack(row["width"], row["vectors"], dim)
            n = len(x)
            if row["nearest"] is None:  # the first round: nothing is known
                nearest, second = np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32)
                upper, lower = np.full(n, np.inf), np.zeros(n)
            else:
                nearest, second = (np.frombuffer(row[s], np.int32).copy() for s in ("nearest", "second"))
                upper, lower = (np.frombuffer(row[s], np.float64).copy() for s in ("upper", "lower"))
                upper += c.moved[nearest]
                lower -= others[nearest]
            row["taken"] = search(x, c, nearest, second, upper, lower)
            row |= {"nearest": nearest.tobytes(), "second": second.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "sums": _sums(x, nearest, k)}
            yield pa.RecordBatch.from_pylist([row], _schema())


def _schema():
    import pyarrow as pa

    part = pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("part", pa.int32()), ("value", pa.int64())])
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(f.split()[0], kinds.get(f.split()[1], pa.list_(part))) for f in _BLOCK.split(", ")])


def _blocks(kept: DataFrame, id: str, vector: str, dim: int, scale: int, block_rows: int) -> DataFrame:
    def make(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, len(batch), block_rows):
                part = batch.slice(a, block_rows)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                width, data = pack(whole_numbers(flat.reshape(-1, dim), scale))
                row = {"ids": part.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), "width": width, "vectors": data, "taken": 0}
                yield pa.RecordBatch.from_pylist([row], _schema())

    return kept.select(F.col(id).cast("long"), F.col(vector)).mapInArrow(make, _BLOCK)


def _means(state: DataFrame, c: Centroids) -> list[list[int]]:
    """The floor of each cluster's mean, or its centroid if it is empty: at most k * (dim + 1) sums of a few parts come to the driver."""
    sums: dict[tuple[int, int], int] = {}
    for r in state.select(F.explode("sums").alias("s")).groupBy("s.cluster", "s.dim", "s.part").agg(F.sum("s.value").cast("decimal(38,0)").alias("value")).collect():
        sums[r["cluster"], r["dim"]] = sums.get((r["cluster"], r["dim"]), 0) + (int(r["value"]) << PART * r["part"])
    return [[sums.get((i, d), 0) // sums[i, -1] for d in range(len(row))] if (i, -1) in sums else row for i, row in enumerate(c.rows)]


def start_rows(kept: DataFrame, id: str, vector: str, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors whose `<seed>:<id>` has the smallest sha256, in the order of these; of equal ids the smaller vector first."""
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")), 256).alias("h"), F.col(vector).alias("v")).orderBy("h", "v").limit(k).collect()
    return [[int(v) for v in whole_numbers(np.array([r["v"]]), scale)[0]] for r in sorted(first, key=lambda r: (r["h"], r["v"]))]


def cluster_rounds(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id: str = "vec_id", vector: str = "embedding", block_rows: int = 4096) -> tuple[DataFrame, Centroids, list[int]]:
    """(the blocks after the last assignment, the last centroids, the distances taken in each assignment).

    A round is one job over the blocks of the round before and the k centroids: it writes the blocks with their new state
    to the shared folder, and the sums, which lie in columns of their own, are read from there. So nothing is shuffled but
    the sums, no lineage grows, a task that is lost is done again from written blocks, and the blocks of the round before
    are removed once the next ones stand."""
    spark = vectors.sparkSession
    kept = vectors.select(id, vector).where(F.col(id).isNotNull() & finite(vector) & (F.size(vector) == dim))
    c = Centroids(start_rows(kept, id, vector, k, seed, scale))
    path = new_path(spark, "blocks")
    _blocks(kept, id, vector, dim, scale, block_rows).write.parquet(path)
    taken = []
    for turn in range(rounds + 1):
        state, now = spark.read.schema(_BLOCK).parquet(path), c
        following = new_path(spark, "blocks")
        if c.rows:
            state.mapInArrow(lambda batches: _assign(batches, now, dim), _BLOCK).write.parquet(following)  # noqa: B023
            remove(spark, path)
            path, state = following, spark.read.schema(_BLOCK).parquet(following)
        taken.append(state.agg(F.sum("taken").alias("n")).first()["n"] or 0)
        if turn < rounds and c.rows:
            c = Centroids(_means(state, c), c)
    return spark.read.schema(_BLOCK).parquet(path), c, taken


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id: str = "vec_id", vector: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x). The k first centroids are vectors chosen by hash; each round assigns every vector
    to the nearest centroid (ties: the smaller number) and moves each centroid that has vectors to the floor of their mean.
    After `rounds` rounds vectors are assigned once more. All is exact, whatever the size of the components; a distance or
    sum of distances beyond 64 bits is null. Rows without id, and vectors that are null, not of `dim` components or not
    finite, take no part and give no row. Repeated rows count each. With fewer than k vectors there are fewer centroids;
    an empty table gives no rows. Other columns are not read.
    """
    state, c, _ = cluster_rounds(vectors, k, rounds, dim, scale, seed, id, vector, block_rows)
    names = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.rows]

    def rows(blocks):
        import pyarrow as pa

        for batch in blocks:
            for row in batch.to_pylist():
                x, nearest = unpack(row["width"], row["vectors"], dim), np.frombuffer(row["nearest"], np.int32)
                d = c.squared(x, nearest)
                distance = pa.array([v if v < 1 << 63 else None for v in d.tolist()] if d.dtype == object else d, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["ids"], "<i8"), pa.int64()), pa.array(nearest), distance, pa.array([names[i] for i in nearest.tolist()], pa.string())], ["vec_id", "cluster", "distance", "centroid_sha256"])

    found = state.select("ids", "width", "vectors", "nearest").mapInArrow(rows, "vec_id long, cluster int, distance long, centroid_sha256 string")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = found.groupBy("cluster").agg(total.alias("d"), F.count(F.when(F.col("distance").isNull(), 1)).alias("gaps")).collect()
    fits = lambda gaps, d: int(d) if not gaps and int(d) < 1 << 63 else None
    gaps, all_d = sum(r["gaps"] for r in sums), sum(int(r["d"] or 0) for r in sums)
    known = vectors.sparkSession.createDataFrame([(r["cluster"], fits(r["gaps"], r["d"] or 0), fits(gaps, all_d)) for r in sums], "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
