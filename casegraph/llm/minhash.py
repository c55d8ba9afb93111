"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, mix, release_memory, total_bytes, written
from .shingles import shingle_sets
from .words import row_ranges, slices

_SIGNED = "doc_id long, print long, n_shingles long, set_a long, set_b long, bands array<long>"
_rng = np.random.default_rng(7)
#: Values of the hash that tells which texts a join may need.
SPOTS = 1 << 20


def min_max_bands(sets: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (a row for each set, bands columns) of non-empty sets.

    Each of bands * rows / 2 permutations gives two values, the smallest and the largest image of the set, so half the
    hash evaluations give the same number of unbiased values. A band's key is a hash of its values and its number.
    """
    n = -(-bands * rows // 2)
    rng = np.random.default_rng(99)
    flips, factors = rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    sizes = np.diff(offsets)
    low = (sets >> np.uint64(32)).astype(np.uint32)
    values = np.empty((len(sizes), 2 * n), np.uint32)
    for a, b in row_ranges(sizes, 1 << 15):
        part, at = low[offsets[a] : offsets[b]], (offsets[a:b] - offsets[a]).astype(np.int64)
        for k in range(n):
            image = (part ^ flips[k]) * factors[k]
            values[a:b, k] = np.minimum.reduceat(image, at)
            values[a:b, n + k] = np.maximum.reduceat(image, at)
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(sizes), axis=0)
    shaped = values[:, : bands * rows].reshape(len(sizes), bands, rows).astype(np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + shaped[:, :, r])
    return keys.view(np.int64)


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per document: a hash of its text, size of its set, a 128-bit identity of the set, and its band keys (none for an empty set)."""

    def sign(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", 1 << 20):
            sets, offsets = shingle_sets(batch.column("text"), words)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            ids, keys = np.zeros((2, len(sizes)), np.int64), [[]] * len(sizes)
            if len(full):
                for k, salt in enumerate((np.uint64(0x1234567), np.uint64(0x89ABCDEF0123))):
                    ids[k, full] = np.add.reduceat(mix(sets ^ salt), offsets[full]).view(np.int64)
                found = min_max_bands(sets, np.append(offsets[full], offsets[-1]), bands, rows)
                for i, row in zip(full.tolist(), found, strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(sizes), pa.array(ids[0]), pa.array(ids[1]), pa.array(keys, pa.list_(pa.int64()))], [c.split()[0] for c in _SIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print")).mapInArrow(sign, _SIGNED)


def link_sets(sets: list[np.ndarray], labels: list, percent: int, asked: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the documents of a unit as all links 100 * |both| >= percent * |either| would.

    Documents with equal labels count as joined. Intersections are exact: a document's shingles look up the others that
    have them. Any two documents that are not joined in the end have been compared, as at least one of them is outside
    the largest part, and each document outside it is compared with all. If `asked` is given, each asked document is
    compared with each that is not asked, and no others are.
    """
    n = len(sets)
    terms, sizes = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(terms, kind="stable")
    by_term = owner[order]
    fresh = np.ones(len(terms), dtype=bool)
    fresh[1:] = terms[order][1:] != terms[order][:-1]
    number = np.empty(len(terms), np.int64)
    number[order] = np.cumsum(fresh) - 1
    left = np.ones(n, dtype=bool) if asked is None else np.array(asked)
    found = np.ones(len(terms), dtype=bool) if asked is None else ~left[by_term]  # what a look-up finds
    starts = np.concatenate([[0], np.cumsum(np.bincount(number[order][found], minlength=int(fresh.sum())))])
    by_term = by_term[found]
    at = np.concatenate([[0], np.cumsum(sizes)])
    part = np.unique(np.array(labels), return_inverse=True)[1].astype(np.int64)
    links = []
    while left.any():
        if asked is None:
            outside = left & (part != np.argmax(np.bincount(part)))
            if not outside.any():
                break
            i = int(np.flatnonzero(outside)[0])
        else:
            i = int(np.flatnonzero(left)[0])
        left[i] = False
        own = number[at[i] : at[i + 1]]
        lengths = starts[own + 1] - starts[own]
        several = lengths > (1 if asked is None else 0)
        own, lengths = own[several], lengths[several]
        if not len(own):
            continue
        shift = np.cumsum(lengths) - lengths
        both = np.bincount(by_term[np.arange(int(lengths.sum())) + np.repeat(starts[own] - shift, lengths)], minlength=n)
        linked = (both > 0) & (100 * both >= percent * (sizes + sizes[i] - both)) & (part != part[i])
        for p in np.unique(part[linked]).tolist():
            links.append((i, int(np.flatnonzero(linked & (part == p))[0])))
            part[part == p] = part[i]
    return links


def _unit(own, against) -> Column:
    """A unit of a cluster: the block `own` alone, if `against` is the same, else each of its documents against another block."""
    return F.struct("cluster", own.cast("long").alias("own"), against.cast("long").alias("against"))


def _block_pairs(large: DataFrame, unit_docs: int, unit_shingles: int) -> DataFrame:
    """Members (rep, doc, print, unit, label, asked) of the second round of large (rep, doc, print, cluster, n_shingles, label, asked).

    The asked classes of a cluster and the others are dealt by hash into blocks of about unit_docs classes or unit_shingles
    shingles at most. Each block of asked classes meets itself, each later one and each block of the others, so a unit is
    two blocks and two classes meet once, unless neither is asked."""
    blocks = lambda of: F.ceil(F.greatest(F.sum(of.cast("long")) / unit_docs, F.sum(F.when(of, F.col("n_shingles")).otherwise(0)) / unit_shingles))
    counts = large.groupBy("cluster").agg(blocks(F.col("asked")).alias("asked_blocks"), blocks(~F.col("asked")).alias("other_blocks")).where("asked_blocks > 0")
    dealt = large.join(counts, "cluster").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.when(F.col("asked"), F.col("asked_blocks")).otherwise(F.col("other_blocks"))))
    each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
    meets = lambda own, against, asked: F.struct(_unit(own, against).alias("unit"), asked.alias("asked"))
    block = F.col("block")
    as_asked = F.concat(
        each("other_blocks", lambda j: meets(block, -1 - j, F.lit(True))),
        each("asked_blocks", lambda j: meets(F.least(block, j), F.greatest(block, j), block <= j)),
    )
    as_other = each("asked_blocks", lambda j: meets(j, -1 - block, F.lit(False)))
    return dealt.select("rep", "doc", "print", "label", F.explode(F.when(F.col("asked"), as_asked).otherwise(as_other)).alias("m")).select("rep", "doc", "print", "m.unit", "label", "m.asked")


def _confirm(members: DataFrame, docs: DataFrame, words: int, percent: int, first: bool) -> DataFrame:
    """Links (a, b) of members (rep, doc, print, unit, label, asked), confirmed on full sets within each unit.

    doc and print say where the text of a class's first row stands. Units are whole. Those of the first round, members (rep, doc, print, cluster, own), share task groups of about 8 MB of text; else
    each is a group of its own."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("print"), "text")
    # a text moves only if a member has its spot: a table of at most SPOTS numbers, whatever the size of the corpus
    spot = F.pmod(F.xxhash64("doc", "print"), F.lit(SPOTS)).alias("spot")
    texts = texts.select("*", spot).join(F.broadcast(members.select(spot).distinct()), "spot", "left_semi").drop("spot")
    held = members.join(texts, ["doc", "print"])
    g = F.xxhash64("unit")
    if first:  # the rest of the columns after the join, as it may broadcast the members
        held = held.select("rep", "text", _unit(F.col("own"), F.col("own")).alias("unit"), F.col("rep").alias("label"), F.lit(True).alias("asked"))
        g = F.pmod(g, F.lit(max(64, total_bytes(docs, "text") // (4 << 20))))
    held = held.withColumn("g", g)

    def confirm(key, table):
        import pyarrow as pa

        out: list[list] = [[], []]
        rows = table.select(["rep", "unit", "label", "asked"]).to_pylist()
        sets: list = [None] * len(rows)
        data = table.column("text").combine_chunks()
        sizes = np.array([len(x) if x else 0 for x in data.to_pylist()])
        for a, b in row_ranges(sizes, 1 << 20):
            found, offsets = shingle_sets(data.slice(a, b - a), words)
            for i in range(a, b):
                sets[i] = found[offsets[i - a] : offsets[i - a + 1]]
        units: dict = {}
        for i, r in enumerate(rows):
            units.setdefault((r["unit"]["cluster"], r["unit"]["own"], r["unit"]["against"]), []).append(i)
        for (_, block, against), own in units.items():
            own.sort(key=lambda i: rows[i]["rep"])
            asked = [rows[i]["asked"] for i in own] if block != against else None
            for i, j in link_sets([sets[i] for i in own], [rows[i]["label"] for i in own], percent, asked):
                out[0].append(rows[own[i]]["rep"])
                out[1].append(rows[own[j]]["rep"])
        release_memory()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return written(held.groupBy("g").applyInArrow(confirm, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 50, rows: int = 5, unit_docs: int = 3_000, unit_shingles: int = 2_000_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |both| >= percent * |either| of their shingle sets. component_id is the smallest
    doc_id that links reach, kept tells whether it is the document's own. Empty or null text has an empty set and no
    link; a text of fewer words than a shingle has its whole sequence as one shingle. Texts alone link: rows that share a
    doc_id with different texts are told apart and each is in the component of its own text. A row with a null doc_id has
    no link, a null component_id and is kept. Other columns are not read.

    1. Min-max signatures give each document its band keys; documents with equal sets become one class, for which the number
       of its first row (by doc_id) stands. 2. The classes of a band bucket are joined to the bucket's smallest, its hub, giving candidate
       clusters: whatever the size of a bucket, a class makes one row for each band, and of these one edge to the least
       of its hubs and one to each other hub. Repeated edges go, so a large group has about one a class. 3. A cluster's texts meet once and
       links are confirmed on full sets; only links that join parts are kept. A cluster of over unit_docs classes or
       unit_shingles shingles is dealt over several units by hash; after a first round inside them, the classes outside
       the cluster's largest part are dealt into blocks anew, and these meet each other and blocks of the rest two by
       two, so every pair that may still link is compared and no unit holds more than two blocks. 4. Components of the
       links, and the least doc_id of each. Two documents at the threshold share no bucket with a chance of (1 - 0.75^rows)^bands, 1.3e-6.
    """
    out = labelled(docs, words, percent, bands, rows, unit_docs, unit_shingles)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def labelled(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 50, rows: int = 5, unit_docs: int = 3_000, unit_shingles: int = 2_000_000) -> DataFrame:
    """Per row of docs: doc_id, print (a hash of the text), n_shingles, part (a number of the component, as components of
    different texts may share their least doc_id; null without words), component_id; see near_duplicates."""
    signs = written(signed(docs, words, bands, rows).withColumn("node", F.monotonically_increasing_id()), "signed")
    full = signs.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "print", "node", "bands")).alias("first"))
    names = {"rep": "node", "doc": "doc_id", "print": "print", "bands": "bands"}
    classes = written(classes.select("set_a", "set_b", "n_shingles", *(F.col(f"first.{c}").alias(n) for n, c in names.items())), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = written(keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("key", "hub"), "buckets")
    # an edge from each class to the least of its hubs and one from that to each other hub that it shares a class with:
    # the same clusters as all edges from classes to hubs, with about one edge a class
    hubs = keys.join(buckets, "key").groupBy("rep").agg(F.min("hub").alias("least"), F.collect_set("hub").alias("hubs"))
    edges = hubs.select(F.col("least").alias("b"), F.explode(F.array_union(F.array("rep"), "hubs")).alias("a")).where("a <> b").distinct()
    clusters = components(edges).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    sized = clusters.join(classes.select("rep", "doc", "print", "n_shingles"), "rep")
    units = sized.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / unit_docs, F.sum("n_shingles") / unit_shingles)).alias("units"))
    sized = sized.join(units, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("units")))
    members = written(sized, "members")
    links = _confirm(members.select("rep", "doc", "print", "cluster", "own"), docs, words, percent, first=True)
    large = members.where("units > 1")
    if large.limit(1).count():
        labels = components(links)
        large = large.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
        large = written(large.select("rep", "doc", "print", "cluster", "n_shingles", F.coalesce("component", "rep").alias("label")), "large")
        counts = large.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        largest = counts.groupBy("cluster").agg(F.max_by("label", "n").alias("largest"))
        large = written(large.join(largest, "cluster").select("rep", "doc", "print", "cluster", "n_shingles", "label", (F.col("label") != F.col("largest")).alias("asked")), "asked")
        links = links.unionByName(_confirm(_block_pairs(large, unit_docs, unit_shingles), docs, words, percent, first=False))
    found = components(links)
    named = classes.select("set_a", "set_b", "n_shingles", "rep", "doc").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    least = named.groupBy("part").agg(F.min("doc").alias("class_component"))
    named = written(named.join(least, "part").select("set_a", "set_b", "n_shingles", "part", "class_component"), "named")
    out = signs.select("doc_id", "print", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class_component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "print", "n_shingles", "part", component.alias("component_id"))


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the near-duplicates for which another row of their component stands: of each component the row of
    least doc_id stays, of several texts of that doc_id the one of least hash, and of equal rows one. Rows without words and
    rows with a null doc_id all stay. Columns of docs may have any names."""
    rows = written(labelled(docs, **parameters).where("n_shingles > 0 and doc_id is not null").groupBy("part", "doc_id", "print").agg(F.count("*").alias("n")), "labelled")
    stays = rows.groupBy("part").agg(F.min(F.struct("doc_id", "print")).alias("s")).select(F.col("s.doc_id").alias("doc_id"), F.col("s.print").alias("print"))
    gone = rows.join(stays, ["doc_id", "print"], "left_anti").select(F.col("doc_id").alias("_doc"), F.col("print").alias("_print"))
    same = lambda of: (docs["doc_id"] == of["_doc"]) & (F.xxhash64(docs["text"]) == of["_print"])
    kept = docs.join(gone, same(gone), "left_anti")
    several = rows.where("n > 1").join(stays, ["doc_id", "print"]).select(F.col("doc_id").alias("_doc"), F.col("print").alias("_print"))
    if not several.limit(1).count():
        return kept
    row = F.struct(*(docs[c] for c in docs.columns))
    repeated = docs.join(several, same(several), "left_semi").groupBy(docs["doc_id"].alias("_doc"), F.xxhash64(docs["text"]).alias("_print")).agg(F.first(row).alias("row"))
    return kept.join(several, same(several), "left_anti").unionByName(repeated.select("row.*"))
