"""Removal of repeated passages by longest-previous-factor arrays over suffixes of candidate passages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, mix, release_memory, total_bytes, written
from .shingles import powers
from .words import slices

_rng = np.random.default_rng(31)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
#: Bytes of the grams whose smallest hash names a window.
GRAM = 24


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every gram of a text: hashes of powers of two by doubling, joined to the gram's length."""
    power, size, out, done = _BYTE[text], 1, None, 0
    while gram:
        if gram & 1:
            n = len(text) - done - size + 1
            out = power[done : done + n] if out is None else out[:n] * np.uint64(pow(_BASE, size, 2**64)) + power[done : done + n]
            done += size
        gram >>= 1
        if gram:
            power = power[:-size] * np.uint64(pow(_BASE, size, 2**64)) + power[size:]
            size *= 2
    return mix(out)


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` values in a row, from minima to the left and right of block borders."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def window_runs(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first windows, windows) of the runs of windows of `length` bytes that have the same gram as their least.

    Equal windows have equal keys, wherever they stand; two windows of a text that are equal lie in different runs.
    """
    n = len(text) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, firsts, step = [], [], 1 << 22
    for a in range(0, n, step):  # a place takes 23 bits
        part = text[a : min(a + step, n) + length - 1]
        h = _gram_hashes(part, GRAM)
        placed = (h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_minimum(placed, length - GRAM + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        keys.append(h[place[first]].view(np.int64))
        firsts.append(first + a)
    firsts = np.concatenate(firsts)
    return np.concatenate(keys), firsts, np.diff(np.append(firsts, n))


def snippet_prints(text: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the texts text[first : first + size], from sums over the whole text."""
    up, down = powers(len(text))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * up[: len(text)], out=sums[1:])
    return mix((sums[firsts + sizes] - sums[firsts]) * down[firsts] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, equal): the suffixes at starts in the order of their first `length` bytes, and for each in that order
    whether it has those bytes in common with the one before. Bytes are compared eight at a time, from the first on;
    only suffixes that still tie are sorted again."""
    order = np.arange(len(starts))
    if not len(starts):
        return order, np.zeros(0, dtype=bool)
    group = np.zeros(len(starts), np.int64)  # suffixes in one group tie so far
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    tied = np.arange(len(starts))
    for a in range(0, length, 8):
        width = min(8, length - a)
        word = np.zeros(len(tied), np.uint64)
        at = starts[order[tied]] + a
        for k in range(width):
            word = (word << np.uint64(8)) | padded[at + k].astype(np.uint64)
        by = np.lexsort((word, group[tied]))
        order[tied] = order[tied[by]]
        word, old = word[by], group[tied]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (word[1:] != word[:-1]) | (old[1:] != old[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        group[tied] = tied[head]
        last = np.append(new[1:], True)
        tied = tied[~(new & last)]
        if not len(tied):
            break
    equal = np.zeros(len(starts), dtype=bool)
    equal[1:] = group[1:] == group[:-1]
    return order, equal


def smaller_neighbours(order: np.ndarray, equal: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next): for each place in suffix order the nearest place before and behind it with a smaller position,
    among the suffixes that share all bytes with it; -1 where there is none.

    All places jump at once: one whose neighbour is not smaller goes on to that neighbour's own, so what it skips is larger.
    """
    n = len(order)
    place = position[order]
    found = []
    for step, joined in ((-1, equal), (1, np.append(equal[1:], False))):
        near = np.where(joined, np.arange(n) + step, -1)
        left = np.flatnonzero(near >= 0)
        while len(left):
            left = left[place[near[left]] >= place[left]]
            near[left] = near[near[left]]
            left = left[near[left] >= 0]
        found.append(near)
    return found[0], found[1]


def has_previous_factor(order: np.ndarray, equal: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Which suffixes have a longest previous factor of the full length: the factor is the longer of those at the previous
    and at the next smaller position in suffix order, so one of them must share all bytes."""
    out = np.zeros(len(order), dtype=bool)
    if len(order):
        before, after = smaller_neighbours(order, equal, position)
        out[order] = (before >= 0) | (after >= 0)
    return out


def longest_previous_factors(text: bytes) -> list[int]:
    """The whole longest-previous-factor array of a small text, from its suffix array: for each place the longest match
    that starts earlier, found at the previous and the next smaller position in suffix order."""
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:])
    before, after = [-1] * n, [-1] * n
    stack: list[int] = []
    for i in order:
        while stack and stack[-1] > i:
            after[stack.pop()] = i
        before[i] = stack[-1] if stack else -1
        stack.append(i)

    def common(i: int, j: int) -> int:
        k = 0
        while max(i, j) + k < n and text[i + k] == text[j + k]:
            k += 1
        return k

    return [max([common(i, j) for j in (before[i], after[i]) if j >= 0], default=0) for i in range(n)]


def _spans(table, length: int) -> tuple[tuple[np.ndarray, np.ndarray], list[tuple[int, int, int]]]:
    """(survivors, spans) of the snippets of a table (key, doc, first, text).

    A span (row, skip, bytes) covers windows of a snippet that have an earlier equal window among the snippets; skip is
    counted from the snippet's start. Survivors (rows, skips) are the windows without one: they stand for all when parts
    of a key meet in a further round. Only those of rows with several salts are told. Snippets with equal text are one, the earliest: every window of the
    others repeats. The rest go through the suffix array."""
    docs, firsts, keys = (table.column(c).to_numpy() for c in ("doc", "first", "key"))
    data, offsets = binary_column(table.column("text"))
    rows = np.lexsort((firsts, docs))
    rank = np.empty(len(rows), np.int64)
    rank[rows] = np.arange(len(rows))  # windows of two snippets of a text don't interleave: ranks order them all
    sizes = np.diff(offsets)
    same = table.column("text").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    best = np.full(int(same.max(initial=-1)) + 1, len(rows), np.int64)
    np.minimum.at(best, same, rank)
    head = rank == best[same]
    chosen = np.flatnonzero(head)
    # a key that only one of the chosen has needs no suffixes
    _, inverse, counts = np.unique(keys[chosen], return_inverse=True, return_counts=True)
    compared = chosen[counts[inverse] > 1]
    windows = sizes[compared] - length + 1
    shift = np.cumsum(windows) - windows
    inner = np.arange(int(windows.sum()), dtype=np.int64) - np.repeat(shift, windows)
    order, equal = suffix_order(data, np.repeat(offsets[compared], windows) + inner, length)
    again = has_previous_factor(order, equal, np.repeat(rank[compared], windows) * (1 << 32) + inner)
    spans = [(int(i), 0, int(sizes[i])) for i in np.flatnonzero(~head)]
    # windows that have an earlier one, of the chosen snippets of names with several salts
    open_rows = chosen[table.column("salts").to_numpy()[chosen] > 1]
    counts = sizes[open_rows] - length + 1
    rows_of = np.repeat(open_rows, counts)
    skips = np.arange(len(rows_of), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
    if len(again) and len(rows_of):
        begins = np.full(len(sizes), -1, np.int64)
        begins[compared] = shift
        at = begins[rows_of]
        fresh = (at < 0) | ~again[np.where(at < 0, 0, at + skips)]
        rows_of, skips = rows_of[fresh], skips[fresh]
    if len(again):
        border = np.zeros(len(again) + 1, dtype=bool)
        border[shift] = border[-1] = True
        starts = np.flatnonzero(again & (border[:-1] | ~np.append(False, again[:-1])))
        stops = np.flatnonzero(again & (border[1:] | ~np.append(again[1:], False))) + 1
        of = np.searchsorted(shift, starts, side="right") - 1
        spans += list(zip(compared[of].tolist(), (starts - shift[of]).tolist(), (stops - starts + length - 1).tolist(), strict=True))
    return (rows_of, skips), spans


def window_rows(table, rows: np.ndarray, skips: np.ndarray, length: int):
    """The windows that start at skips in the snippets of rows, as snippets of one window: the name is a hash of all their
    bytes, so that those of a frequent name scatter and equal ones still meet."""
    import pyarrow as pa

    data, offsets = binary_column(table.column("text"))
    columns = {c: table.column(c).to_numpy() for c in ("doc", "first")}
    out = []
    for a in range(0, len(rows), 1 << 15):
        row, skip = rows[a : a + (1 << 15)], skips[a : a + (1 << 15)]
        text = np.lib.stride_tricks.sliding_window_view(data, length)[offsets[row] + skip]
        key = np.zeros(len(row), np.uint64)
        for k in range(length):
            key = key * np.uint64(_BASE) + _BYTE[text[:, k]]
        bounds = np.arange(len(row) + 1, dtype=np.int32) * np.int32(length)
        texts = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(text.tobytes())])
        n = np.zeros(len(row), np.int64)
        out.append(pa.table({"key": mix(key).view(np.int64), "doc": columns["doc"][row], "first": columns["first"][row] + skip, "salts": (n + 1).astype(np.int32), "bytes": n, "text": texts}))
    return out


def numbered(texts: DataFrame, groups: int) -> DataFrame:
    """texts (row, doc, text) with a doc of its own for each row, in the order of doc. If no doc is there twice these are
    texts themselves. Else the rows are written in the order of doc, the first 100 characters, a hash of the text and
    where they stood, dealt by range, so that not even equal rows need be in one task, and their places are the new docs."""
    if not texts.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return texts
    order = ["doc", "_head", "_hash", "_turn"]
    placed = texts.withColumns({"_head": F.left("text", F.lit(100)), "_hash": F.xxhash64("text"), "_turn": F.monotonically_increasing_id()})
    placed = placed.repartitionByRange(groups, *order).sortWithinPartitions(*order)
    return written(placed.select("row", F.monotonically_increasing_id().alias("doc"), "text"), "numbered")


_SNIPPETS = "key long, doc long, first long, salts int, bytes long, text binary"


def _table(columns: dict):
    import pyarrow as pa

    kinds = {"salts": pa.int32(), "text": pa.binary()}
    return pa.table({n.split()[0]: pa.array(columns[n.split()[0]], kinds.get(n.split()[0], pa.int64())) for n in _SNIPPETS.split(", ")})


def without_repeats(docs: DataFrame, length: int = 100, group_bytes: int = 5 << 20, salt_rows: int = 20_000, frequent: int = 20_000, as_text: bool = False) -> DataFrame:
    """docs with, for each row, its UTF-8 text without the bytes that a string of `length` bytes covers which also
    starts earlier: in a row of a smaller doc_id, or in the same text at a smaller place.

    Returns row (a struct of all columns of docs but text), kept (binary; with as_text a string without the bytes of
    characters that were cut in two), n_bytes, n_removed, n_spans (maximal removed
    runs). Strings are judged on the input. Null text is empty. A null doc_id counts as smaller than all; rows with
    equal doc_id stand in the order of their first 100 characters, then of a hash of their texts, and are dealt out
    as any others (see numbered). Any other columns, of any name, come back in row.

    1. Each window of `length` bytes is named by the 24-byte gram in it whose hash is least, so equal windows have equal
       names; neighbouring windows share them, about one name for 34 bytes, and make a snippet that holds them all.
    2. Snippets meet by name as a name, a 64-bit print and a place. Of snippets with one name and print all but the
       earliest repeat as a whole, within each task (which remembers `frequent` of those that it has met twice) before
       they are exchanged and then among all. A name with a single print has no other repeat. 3. For the others the first of each
       print comes with its bytes, from the texts dealt by document. In each task group a suffix array of their windows
       gives previous and next smaller positions among suffixes that share `length` bytes, so the longest previous factor
       tells the later ones. A name with over salt_rows prints is dealt over several groups; the windows that are the first of
       their kind there meet in a second round, by a hash of all their bytes: a frequent line in many contexts scatters,
       and equal windows number one for each group. 4. Spans return to the documents. The texts are exchanged once, as both
       joins use one partitioning. Two snippets are taken for equal wrongly with a chance of about 2^-64.
    """
    extra = [c for c in docs.columns if c != "text"]
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)))
    texts = docs.select(F.struct(*(docs[c] for c in extra)).alias("row"), doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    groups = max(8, -(-total_bytes(texts, "text") // group_bytes))
    texts = numbered(texts, groups)
    g = F.pmod(F.xxhash64("doc"), F.lit(groups)).alias("g")

    def first_of_each(met, keys, prints, docs, first, size):
        """The columns and whether a row has an earlier one of its name and print here. Such a row repeats for certain:
        it takes a name of its own. What a batch has twice is noted in met for the task's later batches, so a passage
        that very many texts have sends about one row from each task to its name's."""
        order = np.lexsort((first, docs, prints, keys))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (prints[order][1:] != prints[order][:-1])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        known = np.empty(len(order), dtype=bool)
        known[order] = (docs[order] != docs[head]) | (first[order] != first[head])
        heads = order[new]
        if met:
            for i in heads[np.isin(prints[heads], np.fromiter((p for _, p in met), np.int64, len(met)))].tolist():
                known[i] = met.get((keys[i], prints[i]), (docs[i], first[i])) < (docs[i], first[i])
        several = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
        for i in heads[several & ~known[heads]].tolist():
            if len(met) < frequent:
                met[int(keys[i]), int(prints[i])] = (int(docs[i]), int(first[i]))
        own = mix(docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64)).view(np.int64)
        return np.where(known, own, keys), prints, docs, first, size, known

    def names(batches):
        import pyarrow as pa

        met: dict[tuple[int, int], tuple[int, int]] = {}
        for batch in slices(batches, "text"):
            data, offsets = binary_column(batch.column("text"))
            found: list[list[np.ndarray]] = [[], [], [], [], []]
            for d, a, b in zip(batch.column("doc").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = data[a:b]
                keys, first, windows = window_runs(text, length)
                size = windows + length - 1
                for column, values in zip(found, (keys, snippet_prints(text, first, size), np.full(len(keys), d), first, size), strict=True):
                    column.append(values)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in first_of_each(met, *map(np.concatenate, found))], ["key", "print", "doc", "first", "bytes", "known"])

    def by_doc(table, names) -> dict:
        columns = {n: table.column(n).to_numpy() for n in names}
        order = np.argsort(columns["doc"], kind="stable")
        return {n: c[order] for n, c in columns.items()}

    def snippets(_, table, wanted):
        out: dict[str, list] = {n.split()[0]: [] for n in _SNIPPETS.split(", ")}
        if len(wanted) and len(table):
            own = by_doc(wanted, ("doc", "key", "print", "first", "bytes", "salts"))
            data, offsets = binary_column(table.column("text"))
            for i, d in enumerate(table.column("doc").to_pylist()):
                a, b = np.searchsorted(own["doc"], [d, d + 1]).tolist()
                if a == b:
                    continue
                text = data[offsets[i] : offsets[i + 1]]
                at = slice(a, b)
                raw, count = text.tobytes(), b - a
                out["key"] += own["key"][at].tolist()
                out["doc"] += [d] * count
                out["first"] += own["first"][at].tolist()
                out["salts"] += own["salts"][at].tolist()
                out["bytes"] += [0] * count
                out["text"] += [raw[f : f + k] for f, k in zip(own["first"][at].tolist(), own["bytes"][at].tolist(), strict=True)]
        release_memory()
        return _table(out)

    def compare(_, table):
        """Snippets (bytes 0) to spans (bytes over 0, without text) and, of keys with several salts, the surviving windows."""
        import pyarrow as pa
        import pyarrow.compute as pc

        done = table.filter(pc.greater(table.column("bytes"), 0))
        table = table.filter(pc.equal(table.column("bytes"), 0))
        survivors, spans = _spans(table, length)
        of = np.array([s[0] for s in spans], np.int64)
        columns = {c: table.column(c).to_numpy()[of] for c in ("key", "doc")}
        columns |= {"first": table.column("first").to_numpy()[of] + np.array([s[1] for s in spans], np.int64), "salts": np.ones(len(of), np.int32), "bytes": np.array([s[2] for s in spans], np.int64), "text": [None] * len(of)}
        cast = _table(columns).schema
        release_memory()
        return pa.concat_tables([_table(columns), *(w.select(cast.names).cast(cast) for w in window_rows(table, *survivors, length)), done.select(cast.names).cast(cast)])

    def finish(_, table, spans):
        import pyarrow as pa

        own = by_doc(spans, ("doc", "first", "bytes"))
        data, offsets = binary_column(table.column("text"))
        kept, facts = [], np.zeros((3, len(table)), np.int64)
        for i, d in enumerate(table.column("doc").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            facts[0, i] = len(text)
            a, b = np.searchsorted(own["doc"], [d, d + 1]).tolist()
            if a < b:
                at = slice(a, b)
                marks = np.zeros(len(text) + 1, np.int64)
                np.add.at(marks, own["first"][at], 1)
                np.subtract.at(marks, own["first"][at] + own["bytes"][at], 1)
                gone = np.cumsum(marks[:-1]) > 0
                facts[1, i], facts[2, i] = gone.sum(), (np.diff(gone.astype(np.int8), prepend=0) == 1).sum()
                text = text[~gone]
            kept.append(text.tobytes().decode("utf-8", "ignore") if as_text else text.tobytes())
        release_memory()
        return pa.table([table.column("row"), pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(f) for f in facts)], names=["row", "kept", "n_bytes", "n_removed", "n_spans"])

    # one exchange by name: the ranks and the counts use its order
    named = texts.select("doc", "text").mapInArrow(names, "key long, print long, doc long, first long, bytes long, known boolean").repartition(F.col("key"))
    ranked = named.withColumn("again", F.col("known") | (F.rank().over(Window.partitionBy("key", "print").orderBy("doc", "first")) > 1))
    prints = F.sum(F.when(F.col("again"), 0).otherwise(1)).over(Window.partitionBy("key"))
    wanted = ranked.withColumn("n", prints).where("not again and n > 1").select("key", "print", "doc", "first", "bytes", F.ceil(F.col("n") / F.lit(salt_rows)).cast("int").alias("salts"), g)
    whole = ranked.where("again").select("doc", "first", "bytes", g)
    texts = texts.withColumn("g", F.pmod(F.xxhash64("doc"), F.lit(groups)))
    cut = texts.groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(snippets, _SNIPPETS)
    salt = F.pmod(F.xxhash64("doc", "first"), F.greatest("salts", F.lit(1)))
    first = cut.withColumn("part", F.pmod(F.xxhash64("key", salt), F.lit(groups * 2))).groupBy("part").applyInArrow(compare, _SNIPPETS)
    meet = F.when(F.col("bytes") > 0, F.xxhash64("doc", "first")).otherwise(F.xxhash64("key"))
    second = first.withColumn("part", F.pmod(meet, F.lit(groups * 2))).groupBy("part").applyInArrow(compare, _SNIPPETS)
    spans = second.where("bytes > 0").select("doc", "first", "bytes", g).unionByName(whole)
    row = docs.select(F.struct(*(docs[c] for c in extra)).alias("row")).schema["row"].dataType.simpleString()
    return texts.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(finish, f"row {row}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")


def repeat_report(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256, the lower-case SHA-256 of the bytes that are kept."""
    out = without_repeats(docs.select("doc_id", "text"), length)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with their texts cut; n_chars, if there, follows. Bytes of a character that was cut in two are left out."""
    out = without_repeats(docs, length, as_text=True)
    sizes = {"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*((F.col("kept") if c == "text" else sizes.get(c, F.col("row").getField(c))).alias(c) for c in docs.columns))
