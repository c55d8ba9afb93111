"""Search of documents and actors, and similar documents by their vectors."""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded, zero
from ..sources.scratch import written


def like(c: Column, text: str) -> Column:
    """Whether c holds text without case; % and _ in it stand for themselves."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def search_documents(docs: DataFrame, q: str, fields: tuple[str, ...] = ("title", "doc_number"), filters: dict[str, list] | None = None, since=None, until=None, page: int = 1, per_page: int = 20, date: str = "publication_date", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Q1. (a page of hits, newest first; total and pages). All filters, the stage's too, hold before paging."""
    hits = docs.where(reduce(lambda a, b: a | b, (F.coalesce(like(F.col(f), q), F.lit(False)) for f in fields)))
    for col, values in (filters or {}).items():
        hits = hits.where(F.col(col).isin(values))
    if since is not None:
        hits = hits.where(F.col(date) >= F.lit(since))
    if until is not None:
        hits = hits.where(F.col(date) <= F.lit(until))
    per_page = max(1, min(100, per_page))
    total = hits.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / per_page))
    return hits.orderBy(F.col(date).desc_nulls_last(), key).offset((max(1, page) - 1) * per_page).limit(per_page), total


def highlight(text: Column, q: str, width: int = 300, before: int = 100, within: int = 5_000) -> Column:
    """Q2. An excerpt from a little before the first place of the first term of over two letters that a text's start has."""
    start = F.substring(text, 1, within)
    places = [F.nullif(F.instr(F.lower(start), F.lit(t)), F.lit(0)) for t in q.lower().split() if len(t) > 2]
    at = F.greatest(F.lit(0), F.coalesce(*places, F.lit(1)) - 1 - before) if places else F.lit(0)
    return F.concat(F.when(at > 0, "...").otherwise(""), F.substring(start, at + 1, F.lit(width)), F.lit("..."))


def _exact(weights: list[float]) -> tuple[list, int, int]:
    """Weights as decimals with the digits and the scale that hold each of them, so that sums of hits are exact and equal ones tie.
    Weights that take over 27 digits together stay doubles, and digits are 0."""
    exact = [Decimal(str(w)).normalize() for w in weights]
    if not all(w.is_finite() for w in exact):
        return weights, 0, 0
    scale = max(0, *(-w.as_tuple().exponent for w in exact))
    digits = max(1, *(w.adjusted() + 1 + scale for w in exact))
    return (exact, digits, scale) if digits <= 27 else (weights, 0, 0)


def token_index(docs: DataFrame, weights: dict[str, float], key: str = "doc_id", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Q3. (token, key, weight): each token's hits in the fields times their weights, summed exactly. Tokens are runs of letters
    and digits, lower case."""
    exact, digits, scale = _exact(list(weights.values()))
    kind = f"decimal({digits},{scale})" if digits else "double"
    parts = [docs.select(key, F.explode(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)).alias("token"), F.lit(w).cast(kind).alias("w")) for c, w in zip(weights, exact, strict=True)]
    rows = reduce(DataFrame.unionByName, parts)
    if stop_words:
        rows = rows.where(~F.col("token").isin(*stop_words))
    return rows.groupBy("token", key).agg(F.sum("w").alias("weight"))


def ranked_search(index: DataFrame, terms: list[str], key: str = "doc_id", k: int = 20) -> DataFrame:
    """Q3. The k documents whose tokens for the terms weigh most, with how many terms they have. Decimal weights are summed
    before they become a double."""
    hits = index.where(F.col("token").isin([t.lower() for t in terms]))
    return hits.groupBy(key).agg(F.sum("weight").cast("double").alias("score"), F.count("*").alias("terms")).orderBy(F.col("terms").desc(), F.col("score").desc(), key).limit(k)


#: What a hit in a title, a number and the text of a document weighs.
FIELD_WEIGHTS = {"title": 1.0, "doc_number": 0.4, "raw_content": 0.2}


def _part(token: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(parts)).cast("int")


#: Bytes of text whose postings make a file of a part, and the most words that a task groups at once.
_FILE_BYTES, _GROUP_WORDS = 8 << 20, 1 << 20


def _postings(weights: list[float], key: str):
    """For batches of (key, the words of each field): (token, keys, weights, places), a row for each word of some documents.
    Words are grouped by their numbers, many documents at once. Weights are decimals with room for 10^10 words of a document."""
    import pyarrow as pa
    import pyarrow.compute as pc

    exact, digits, scale = _exact(weights)
    total = pa.decimal128(digits + 10, scale) if digits else pa.float64()

    def lists(start: np.ndarray, values) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(start, len(values)), pa.int32()), values)

    def grouped(batch) -> pa.RecordBatch:
        words, rows, places = [], [], []
        for i, column in enumerate(batch.columns[1:]):
            row = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
            column = column.flatten()
            word = pc.binary_length(column).to_numpy(zero_copy_only=False) > 0  # a text may start and end with what is no word
            row = row[word]
            count = np.bincount(row, minlength=len(batch))
            words.append(column.filter(pa.array(word)))
            rows.append(row)
            places.append((i << 32) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        coded, place = pa.concat_arrays(words).dictionary_encode(), np.concatenate(places)
        bits = len(place).bit_length()  # sorted with its number, a word keeps the order of its places
        order = np.sort((coded.indices.to_numpy() * np.int64(len(batch)) + np.concatenate(rows) << bits) + np.arange(len(place)))
        place = place[order & (1 << bits) - 1]
        order >>= bits
        start = np.flatnonzero(np.diff(order, prepend=-1))
        kind, row = np.divmod(order[start], max(1, len(batch)))
        counts = [np.add.reduceat((place >> 32 == i).astype(np.int64), start) if len(start) else start for i in range(len(weights))]
        if digits:
            times = [pc.multiply(pa.array(n, pa.int32()).cast(pa.decimal128(10)), pa.scalar(w, pa.decimal128(digits, scale))).cast(total) for n, w in zip(counts, exact, strict=True)]
            weight = reduce(lambda a, b: pc.add(a, b).cast(total), times)
        else:
            weight = pa.array(sum(n * w for n, w in zip(counts, weights, strict=True)), total)
        first = np.flatnonzero(np.diff(kind, prepend=-1))
        held = (batch.column(0).take(pa.array(row)), weight, lists(start, pa.array(place)))
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(kind[first])), *(lists(first, x) for x in held)], ["token", key, "weight", "places"])

    def run(batches):
        for batch in batches:
            words = np.cumsum(sum(pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in batch.columns[1:]))
            start = 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(words, (words[start - 1] if start else 0) + _GROUP_WORDS, "right")))
                yield grouped(batch.slice(start, stop - start))
                start = stop

    return run


def _each(postings: DataFrame, key: str) -> DataFrame:
    """A row for each document of the rows of an index."""
    return postings.select("token", F.inline(F.arrays_zip(key, "weight", "places")))


def store_index(docs: DataFrame, path: str, weights: dict[str, float] | None = None, key: str = "doc_id", parts: int = 64) -> None:
    """Q3. Writes an index of docs (key and the fields of weights) below path: postings (token, and of some documents that
    have it the keys, exact weights and places: number of the field times 2^32 and of the token there, both from 0) and
    frequencies (token, documents), in folders by a hash of the token.

    Words are grouped where the texts are read, so what is exchanged is a row for each word of many documents. Rows are
    dealt by part and, of large inputs, by their first key, so a token that every document has is spread over tasks and
    files, and a part is few files. Rows of docs with one key count as one document. The table of parameters says how to
    read it."""
    weights = FIELD_WEIGHTS if weights is None else weights
    kind, size = docs.schema[key].dataType.simpleString(), reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in weights))
    keys = docs.groupBy(key).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    asked = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    words = docs.select(key, *(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+").alias(f"_{i}") for i, c in enumerate(weights)))
    _, digits, scale = _exact(list(weights.values()))
    weight = f"decimal({digits + 10},{scale})" if digits else "double"
    rows = words.mapInArrow(_postings(list(weights.values()), key), f"token string, {key} array<{kind}>, weight array<{weight}>, places array<array<long>>")
    if asked["most"] > 1:
        both = _each(rows, key).groupBy("token", key).agg(F.sum("weight").alias("weight"), F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
        rows = both.select("token", *(F.array(c).alias(c) for c in (key, "weight", "places")))
    slices = max(1, -(-asked["bytes"] // (parts * _FILE_BYTES)))
    rows = rows.withColumn("part", _part(F.col("token"), parts)).repartition("part", F.pmod(F.xxhash64(F.col(key)[0]), F.lit(slices)))
    rows.sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{path}/postings")
    counts = docs.sparkSession.read.parquet(f"{path}/postings").groupBy("part", "token").agg(F.sum(F.size(key)).alias("documents"))
    counts.repartition(F.col("part")).sortWithinPartitions("token").write.partitionBy("part").parquet(f"{path}/frequencies")
    docs.sparkSession.range(1).select(F.lit(asked["documents"]).cast("long").alias("documents"), F.lit(parts).alias("parts")).write.parquet(f"{path}/parameters")


def postings_of(spark: SparkSession, path: str, terms: list[str], table: str = "postings", key: str = "doc_id") -> DataFrame:
    """Q3. The postings (token, key, weight, places) or frequencies of some terms: only the terms' own parts are read, and
    in these the row groups that may hold them."""
    low = sorted({t.lower() for t in terms})
    parts = spark.read.parquet(f"{path}/parameters").first()["parts"]
    here = spark.range(1).select(*(_part(F.lit(t), parts) for t in low)).first()
    found = spark.read.parquet(f"{path}/{table}").where(F.col("part").isin(*sorted(set(here))) & F.col("token").isin(*low)).drop("part")
    return _each(found, key) if table == "postings" else found


def search_index(spark: SparkSession, path: str, terms: list[str], key: str = "doc_id", k: int = 20, rare: bool = False) -> DataFrame:
    """Q3. As ranked_search, from a stored index. With rare a token's weight is multiplied by ln(1 + documents / those that
    have it), so that a rare word counts more."""
    hits = postings_of(spark, path, terms, key=key)
    if rare:
        total = spark.read.parquet(f"{path}/parameters").select(F.col("documents").alias("_all"))
        hits = hits.join(F.broadcast(postings_of(spark, path, terms, "frequencies")), "token").crossJoin(F.broadcast(total))
        hits = hits.withColumn("weight", F.col("weight") * F.log(1 + F.col("_all") / F.col("documents")))
    return ranked_search(hits.select("token", key, "weight"), terms, key, k)


def search_phrase(spark: SparkSession, path: str, phrase: list[str], key: str = "doc_id", k: int = 20) -> DataFrame:
    """Q3. The k documents that have the words of a phrase one behind the other in a field most often (key, times)."""
    words = [w.lower() for w in phrase]
    found = postings_of(spark, path, words, key=key).select("token", key, "places")
    step = lambda i: found.where(F.col("token") == words[i]).select(key, F.explode(F.transform("places", lambda p: p - i)).alias("start"))
    both = step(0)
    for i in range(1, len(words)):
        both = both.join(step(i), [key, "start"])
    return both.groupBy(key).agg(F.count("*").alias("times")).orderBy(F.col("times").desc(), key).limit(k)


def search_actors(actors: DataFrame, links: DataFrame, q: str, types: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Q4. Actors whose name holds q, with their distinct documents: an exact name first, then by documents and name."""
    hits = actors.where(like(F.col("name"), q))
    if types:
        hits = hits.where(F.col("actor_type").isin(types))
    per = links.join(hits.select("actor_id"), "actor_id", "left_semi").groupBy("actor_id").agg(F.count_distinct("doc_id").alias("documents"))
    out = hits.join(per, "actor_id", "left").withColumn("documents", zero(F.col("documents")))
    return out.orderBy((F.lower("name") == q.lower()).desc(), F.col("documents").desc(), "name", "actor_id").limit(min(20, limit))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similar_documents(vectors: DataFrame, ids: list, k: int = 10, threshold: float = 0.0, key: str = "doc_id", vector: str = "embedding", most: int = 1_000) -> DataFrame:
    """Q5. For each of the given documents the k others of greatest cosine, from threshold on; ties to the smaller id.
    Only the asked documents' vectors are broadcast, at most `most` of them (more ids raise an error: a whole corpus goes through corpus_pairs); each task keeps k a
    query before the exchange."""
    if len(ids) > most:
        raise ValueError(f"more than {most} documents asked at once")
    unit = vectors.select(key, vector, F.sqrt(_dot(F.col(vector), F.col(vector))).alias("_n")).where("_n > 0")
    asked = unit.where(F.col(key).isin(ids)).select(F.col(key).alias("query_id"), F.col(vector).alias("_q"), F.col("_n").alias("_qn"))
    pairs = unit.join(F.broadcast(asked), F.col(key) != F.col("query_id"))
    scored = pairs.select("query_id", key, (_dot(F.col(vector), F.col("_q")) / (F.col("_n") * F.col("_qn"))).alias("similarity")).where(F.col("similarity") >= threshold)
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hash_tables(n: int, threshold: float, recall: float, bucket: int = 16_384, most_bits: int = 24) -> tuple[int, int]:
    """(bits, tables) of sign hashes for n vectors: as many bits as leave at most `bucket` vectors in a bucket where they have no
    structure, and as many tables as let two vectors at the threshold share a bucket with the chance `recall`. Vectors are
    exchanged once a table and compared in memory, so full buckets and few tables are the cheap way."""
    bits = max(1, min(most_bits, (max(n, 1) // bucket).bit_length()))
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    while bits > 1 and same**bits < 0.01:  # more than some hundred tables cost more than fuller buckets
        bits -= 1
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(same**bits, 1 - 1e-9))))


def _near(least: float, kind: str):
    """For rows (bucket, row, column, own, id, unit) sorted by the first three: the ids (a, b) of vectors of block `row` and of
    block `column` (of one block: of any two) whose inner product is `least` or more. A unit of two blocks is held at once;
    its pairs go out piece by piece."""

    def pairs(xs, left, ys, right):
        import pyarrow as pa

        for at in range(0, len(xs), 512):
            i, j = np.nonzero(xs[at : at + 512] @ ys.T >= least)
            i += at
            if left is right:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 100_000):
                yield pa.RecordBatch.from_arrays([left.take(pa.array(i[k : k + 100_000])), right.take(pa.array(j[k : k + 100_000]))], ["a", "b"])

    def unit(key, parts):
        import pyarrow as pa

        whole = pa.concat_arrays([p.field("unit") for p in parts])
        own = np.concatenate([p.field("own").to_numpy() for p in parts])
        ids = pa.concat_arrays([p.field("id") for p in parts])
        x = np.frombuffer(b"".join(whole.to_pylist()), np.float32).reshape(len(own), -1)
        if key[1] == key[2]:
            yield from pairs(x, ids, x, ids)
        else:
            a, b = np.nonzero(own == key[1])[0], np.nonzero(own == key[2])[0]
            yield from pairs(x[a], ids.take(pa.array(a)), x[b], ids.take(pa.array(b)))

    def run(batches):
        key, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            starts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1), len(batch)]
            rows = batch.to_struct_array()
            for begin, end in zip(starts, starts[1:]):
                if begin == end:
                    continue
                if key is not None and tuple(keys[begin]) != key:
                    yield from unit(key, parts)
                    parts = []
                key = tuple(keys[begin])
                parts.append(rows.slice(begin, end - begin))
        if parts:
            yield from unit(key, parts)

    return run, f"a {kind}, b {kind}"


def corpus_pairs(vectors: DataFrame, threshold: float = 0.8, recall: float = 0.95, key: str = "doc_id", vector: str = "embedding", block: int = 16_384, bits: int | None = None, seed: int = 11) -> DataFrame:
    """Q5. (a, b, similarity): the pairs a < b of a whole table whose cosine reaches the threshold, each with the chance
    `recall` at the threshold and more above it. With bits=0 all pairs are compared, which is the exact way.

    Vectors get a hash of the signs of random projections in each of several tables, and meet where they share a
    bucket. They come there as unit vectors of 4 bytes a component, and a task multiplies a bucket's as a matrix; what it
    sends on are the pairs near the threshold or above it only, whose cosine is then taken exactly. A bucket of more than
    `block` vectors is dealt into blocks by hash, and these meet two by two as units of their own, so no task holds a full
    bucket and no pair of it is lost. Rows without id and vectors that are null, zero, not finite or shorter than the
    longest take no part; of several vectors of one id the least counts."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, bad)).groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("v"))
    good = written(good.withColumn("norm", F.sqrt(_dot(F.col("v"), F.col("v")))), "vectors")
    size = good.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    dim = size["dim"] or 0
    unit = good.where((F.size("v") == dim) & (F.col("norm") > 0))
    each, tables = hash_tables(size["n"], threshold, recall) if bits is None else (bits, 1 if not bits else hash_tables(size["n"], threshold, recall, most_bits=bits)[1])
    planes = np.random.default_rng(seed).standard_normal((tables * each, dim)).astype(np.float32)

    def signs(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), dim)
            x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            on = (x @ planes.T > 0).reshape(len(batch), tables, each)
            keys = (on * (1 << np.arange(each, dtype=np.int64))).sum(axis=2) * tables + np.arange(tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["id", "unit", "keys"])

    kind = unit.schema["id"].dataType.simpleString()
    rows = written(unit.select("id", "v").mapInArrow(signs, f"id {kind}, unit binary, keys array<long>"), "signs")
    full = rows.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = rows.select("id", "unit", F.explode("keys").alias("bucket")).join(full, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, other = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("bucket", own.alias("own"), other.alias("other"), "id", "unit")
    dealt = dealt.select("bucket", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("column"), "own", "id", "unit")
    near = dealt.repartition("bucket", "row", "column").sortWithinPartitions("bucket", "row", "column").mapInArrow(*_near(threshold - 1e-4 - dim * 1e-6, kind))
    met = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.lit(1).alias("met"))
    end = lambda name: unit.select(F.col("id").alias(name), F.col("v").alias(f"v_{name}"), F.col("norm").alias(f"n_{name}"))
    both = met.join(end("a"), "a").join(end("b"), "b")
    return both.select("a", "b", (_dot(F.col("v_a"), F.col("v_b")) / (F.col("n_a") * F.col("n_b"))).alias("similarity")).where(F.col("similarity") >= threshold)


def corpus_links(pairs: DataFrame, summaries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Q6. pairs (a, b, similarity) with score and confidence by what their summaries (key, leads, keywords, domains, bodies:
    arrays; year) share; see link_score. Missing summaries share nothing."""
    kinds = ("leads", "keywords", "domains", "bodies")
    end = lambda name: summaries.select(F.col(key).alias(name), *(F.col(c).alias(f"{c}_{name}") for c in (*kinds, "year")))
    both = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    shared = [zero(F.size(F.array_intersect(f"{c}_a", f"{c}_b"))) for c in kinds]
    shared = [F.greatest(F.lit(0), n) for n in shared]  # the size of null is -1
    scored = link_score(F.col("similarity"), *shared, zero(F.col("year_a") - F.col("year_b")))
    return both.select("a", "b", "similarity", scored["score"].alias("score"), scored["confidence"].alias("confidence"))


def shared_terms(pairs: DataFrame, summaries: DataFrame, columns: tuple[str, ...] = ("keywords", "policy_domains")) -> DataFrame:
    """Q5. pairs (query_id, doc_id) with the terms that both summaries have."""
    left = summaries.select(F.col("doc_id").alias("query_id"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = pairs.join(left, "query_id").join(summaries.select("doc_id", *columns), "doc_id")
    return both.select(*pairs.columns, *(F.array_intersect(c, f"_{c}").alias(f"shared_{c}") for c in columns))


def link_score(similarity: Column, leads: Column, keywords: Column, domains: Column, bodies: Column, years: Column) -> dict[str, Column]:
    """Q6. Half the similarity plus capped bonuses for what two documents share, less a penalty for the years between
    them, within 0 and 1; and its class."""
    bonus = lambda n, each, most: F.least(n * F.lit(each), F.lit(most))
    raw = similarity * 0.5 + bonus(leads, 0.15, 0.3) + bonus(keywords, 0.02, 0.2) + bonus(domains, 0.05, 0.15) + bonus(bodies, 0.05, 0.15) - bonus(F.abs(years), 0.01, 0.2)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return {"score": rounded(score, 4), "confidence": F.when(score > 0.8, "high").when(score > 0.6, "medium").otherwise("low")}


def store_embeddings(summaries: DataFrame, vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Q7. (summaries with the vectors of the right size; rows by what became of them: stored, wrong_dimension, missing)."""
    joined = summaries.drop("embedding").join(vectors.select("doc_id", F.col("embedding").alias("_v")), "doc_id", "left")
    good = F.size("_v") == dim
    outcome = F.when(F.col("_v").isNull(), "missing").when(good, "stored").otherwise("wrong_dimension")
    return joined.withColumn("embedding", F.when(good, F.col("_v"))).drop("_v"), joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
