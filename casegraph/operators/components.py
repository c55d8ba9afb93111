"""Connected components of an edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_path, remove, written


def _joined(pairs: DataFrame) -> DataFrame:
    """(x, root) of the nodes of a small edge list (x, y), by union-find in one task."""

    def join(batches):
        import pyarrow as pa

        root: dict = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        kind = None
        for batch in batches:
            kind = batch.schema.field("x").type
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = sorted((find(x), find(y)))
                root[q] = p
        if kind is not None:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(v) for v in nodes], kind)], ["x", "root"])

    kind = pairs.schema["x"].dataType.simpleString()
    return pairs.coalesce(1).mapInArrow(join, f"x {kind}, root {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = 200_000, max_rounds: int = 60) -> DataFrame:
    """G8. (node, component): the smallest node id that edges reach. Self edges go; a node without others has no row.

    Each round a node hooks to the neighbour (or itself) whose hash is least, then to where that one hooks, and the edges
    are renamed; those inside one node and repeated ones go, so a round leaves less than half of the nodes that still have
    edges, also of long chains and stars. Once no more than `small` edges are left one task joins them: that is all it
    holds, whatever the size of the input. Nodes are summed on the map side, and a hot name is met by a broadcast while
    the table of names is small, else adaptive execution splits its partition. The driver sees how many edges are left.
    Names are then followed back from the last round to the first, and the least id of each component is found by an
    aggregate. Tables of the rounds are removed when the result has been written. Too many rounds raise an error.
    """
    spark = edges.sparkSession
    folder = new_path(spark, "rounds")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct()

    pairs = kept(ordered(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))), "edges")
    names: list[DataFrame] = []
    while pairs.count() > small:
        n = len(names)
        if n == max_rounds:
            raise RuntimeError(f"components: not settled after {max_rounds} rounds")
        order = lambda c: F.xxhash64(F.col(c), F.lit(n))  # noqa: B023, E731
        near = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy("x").agg(F.min_by("y", order("y")).alias("y"))
        hooks = near.select("x", F.when(order("y") < order("x"), F.col("y")).otherwise(F.col("x")).alias("to"))
        onward = hooks.select(F.col("x").alias("to"), F.col("to").alias("root"))
        name = kept(hooks.join(onward, "to").select("x", "root"), f"names-{n}")
        names.append(name)
        of = lambda end: name.select(F.col("x").alias(end), F.col("root").alias(f"{end}_root"))  # noqa: B023, E731
        pairs = kept(ordered(pairs.join(of("x"), "x").join(of("y"), "y").select(F.col("x_root").alias("x"), F.col("y_root").alias("y"))), f"edges-{n}")
    labels = kept(_joined(pairs), "joined")
    while names:
        later = labels.select(F.col("x").alias("root"), F.col("root").alias("last"))
        labels = kept(names.pop().join(later, "root", "left").select("x", F.coalesce("last", "root").alias("root")), f"labels-{len(names)}")
    least = labels.groupBy("root").agg(F.min("x").alias("component"))
    found = written(labels.join(least, "root").select(F.col("x").alias("node"), "component"), "components")
    remove(spark, folder)
    return found
