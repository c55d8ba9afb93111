"""Who takes part with whom: pairs of actors in shared cases, and networks, pages and neighbours made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded, zero


def presence(invites: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per (case_id, actor_id) with flags invited and responded: duplicates go before any pairing."""
    some = lambda df, i, r: df.where("actor_id is not null and case_id is not null").select("case_id", "actor_id", F.lit(i).alias("i"), F.lit(r).alias("r"))
    return some(invites, True, False).unionByName(some(responses, False, True)).groupBy("case_id", "actor_id").agg(F.bool_or("i").alias("invited"), F.bool_or("r").alias("responded"))


#: Both were invited to the case, or both answered.
_TOGETHER = "(i_a and i_b) or (r_a and r_b)"


def paired(present: DataFrame, block: int = 2_000) -> DataFrame:
    """Rows (case_id, and actor, i, r of both sides) for each pair of actors a < b that a case brings together.

    The actors of a case of more than `block` are dealt by hash into blocks. The case is then as many units as it has
    ordered pairs of blocks: an actor goes to a row of them as a and to a column as b, so a pair meets in one unit, a
    unit makes block squared pairs at most, and a case with a third of all rows is many tasks."""
    hot = present.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > block).select("case_id", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = present.join(hot, "case_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("actor_id"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda s, row, column: dealt.select("case_id", row.alias("row"), column.alias("column"), F.col("actor_id").alias(f"actor_{s}"), F.col("invited").alias(f"i_{s}"), F.col("responded").alias(f"r_{s}"))
    both = side("a", own, each).join(side("b", each, own), ["case_id", "row", "column"])
    return both.where(f"actor_a < actor_b and ({_TOGETHER})").drop("row", "column")


def cooccurrence(invites: DataFrame, responses: DataFrame, cases: DataFrame, keep_cases: int = 100, block: int = 2_000) -> DataFrame:
    """M11. Per pair of actors a < b: cases they were both invited to, both answered, either; Jaccard (4 decimals) of
    their cases, strength (2), the keep_cases latest shared cases, first and last date. cases: case_id, case_date.

    Pairs are made as in paired. Counts are summed on the map side; the latest cases of a pair are a limit by rank, of
    which each task keeps keep_cases a pair before the exchange. The number of pairs of a case with n actors is
    n (n - 1) / 2, which is the result itself.
    """
    present = presence(invites, responses)
    totals = present.groupBy("actor_id").agg(F.count("*").alias("n"))
    pairs = paired(present, block).join(cases.select("case_id", "case_date"), "case_id", "left")
    latest = Window.partitionBy("actor_a", "actor_b").orderBy(F.col("case_date").desc_nulls_last(), F.col("case_id"))
    ranked = pairs.select("actor_a", "actor_b", "case_id", "case_date").withColumn("_place", F.row_number().over(latest)).where(F.col("_place") <= keep_cases)
    shared = ranked.groupBy("actor_a", "actor_b").agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "case_id"))), lambda x: x["case_id"]).alias("shared_cases"))
    per = pairs.groupBy("actor_a", "actor_b").agg(
        F.count_if(F.col("i_a") & F.col("i_b")).alias("invite_count"), F.count_if(F.col("r_a") & F.col("r_b")).alias("response_count"), F.count("*").alias("shared_count"), F.min("case_date").alias("first_date"), F.max("case_date").alias("last_date"),
    )
    total = lambda s: totals.select(F.col("actor_id").alias(f"actor_{s}"), F.col("n").alias(f"n_{s}"))
    per = per.join(shared, ["actor_a", "actor_b"]).join(total("a"), "actor_a").join(total("b"), "actor_b")
    jaccard = F.col("shared_count") / (F.col("n_a") + F.col("n_b") - F.col("shared_count"))
    columns = ["actor_a", "actor_b", "invite_count", "response_count", "shared_count", "shared_cases", "first_date", "last_date"]
    return per.select(*columns, rounded(jaccard, 4).alias("jaccard"), rounded(jaccard, 2).alias("strength"))


def actor_neighbors(invites: DataFrame, responses: DataFrame, actors: DataFrame, actor, k: int = 10) -> DataFrame:
    """M15. The k actors most strongly tied to one actor, with names, without the pairs of others: that actor's cases come
    first, then who else is there, then how many cases these have in all."""
    present = presence(invites, responses)
    own = present.where(F.col("actor_id") == actor).select("case_id", F.col("invited").alias("i_a"), F.col("responded").alias("r_a"))
    others = present.where(F.col("actor_id") != actor).select("case_id", "actor_id", F.col("invited").alias("i_b"), F.col("responded").alias("r_b"))
    shared = others.join(own, "case_id").where(_TOGETHER).groupBy("actor_id").agg(F.count("*").alias("shared_count"))
    totals = present.join(shared.select("actor_id"), "actor_id", "left_semi").groupBy("actor_id").agg(F.count("*").alias("n"))
    tied = shared.join(totals, "actor_id").crossJoin(F.broadcast(own.agg(F.count("*").alias("n_own"))))
    strength = rounded(F.col("shared_count") / (F.col("n") + F.col("n_own") - F.col("shared_count")), 2)
    top = tied.select("actor_id", strength.alias("strength"), "shared_count").orderBy(F.col("strength").desc(), "actor_id").limit(k)
    return top.join(actors, "actor_id")


def cooccurrence_stats(pairs: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """M12. (pairs, mean Jaccard, shared cases of the strongest; the strongest pairs)."""
    strongest = pairs.orderBy(F.col("strength").desc(), "actor_a", "actor_b").limit(top)
    best = F.max_by("shared_count", F.struct(F.col("strength"), -F.col("actor_a"), -F.col("actor_b")))
    stats = pairs.agg(F.count("*").alias("total_pairs"), F.coalesce(rounded(F.avg("jaccard"), 4), F.lit(0.0)).alias("avg_jaccard"), zero(best).alias("max_count"))
    return stats, strongest


def network(pairs: DataFrame, actors: DataFrame, min_strength: float = 0.1, limit: int = 200, types: list | None = None, centre=None) -> tuple[DataFrame, DataFrame]:
    """M13. (nodes, edges): the 3 * limit strongest pairs (about the centre, if given) between actors of the types, the
    limit nodes of most edges (and the centre), the edges among them, and each node's degree there.
    actors: actor_id, name, actor_type."""
    strong = pairs.where(F.col("strength") >= min_strength)
    if centre is not None:
        strong = strong.where((F.col("actor_a") == centre) | (F.col("actor_b") == centre))
    strong = strong.orderBy(F.col("strength").desc(), "actor_a", "actor_b").limit(3 * limit)
    known = actors if types is None else actors.where(F.col("actor_type").isin(types))
    end = lambda c: known.select(F.col("actor_id").alias(c))
    strong = strong.join(end("actor_a"), "actor_a", "left_semi").join(end("actor_b"), "actor_b", "left_semi")
    degrees = _degrees(strong)
    chosen = degrees.orderBy(F.col("degree").desc(), "actor_id").limit(limit).select("actor_id")
    if centre is not None:
        chosen = chosen.unionByName(known.where(F.col("actor_id") == centre).select("actor_id")).distinct()
    pick = lambda c: chosen.select(F.col("actor_id").alias(c))
    edges = strong.join(pick("actor_a"), "actor_a", "left_semi").join(pick("actor_b"), "actor_b", "left_semi")
    nodes = known.join(chosen, "actor_id", "left_semi").join(_degrees(edges), "actor_id", "left").withColumn("degree", zero(F.col("degree")))
    return nodes, edges


def _endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("actor_a", "actor_b")).alias("actor_id"))


def _degrees(edges: DataFrame) -> DataFrame:
    return _endpoints(edges).groupBy("actor_id").agg(F.count("*").alias("degree"))


def type_counts(pairs: DataFrame, actors: DataFrame) -> DataFrame:
    """M14. Actors by type among all that stand in a pair."""
    return actors.join(_endpoints(pairs).distinct(), "actor_id", "left_semi").groupBy("actor_type").agg(F.count("*").alias("n"))


def neighbors(pairs: DataFrame, actors: DataFrame, actor, k: int = 10) -> DataFrame:
    """M15. The k actors most strongly tied to one actor, with names."""
    own = pairs.where((F.col("actor_a") == actor) | (F.col("actor_b") == actor))
    other = F.when(F.col("actor_a") == actor, F.col("actor_b")).otherwise(F.col("actor_a"))
    top = own.select(other.alias("actor_id"), "strength", "shared_count").orderBy(F.col("strength").desc(), "actor_id").limit(k)
    return top.join(actors, "actor_id")


def role_points(role: Column) -> Column:
    """Points of a shared person by role: 3 for an inquiry's head, 2 for a member, 2 for a minister, else 0."""
    low = F.lower(F.coalesce(role, F.lit("")))
    return F.when(low.contains("utredare"), 3).when(low.contains("ledamot") | low.contains("kommitté"), 2).when(low.contains("minister") | low.contains("statsråd"), 2).otherwise(0)


def related_documents(links: DataFrame, documents: DataFrame, of: Column | None = None, points: Column | None = None, top: int = 10) -> DataFrame:
    """M16. Per document the top others that share actors by name: points for each shared relation, 1 more for the same
    ministry. links: doc_id, name, role; documents: doc_id, ministry; `of` limits the documents asked for.

    Relations are first summed per (name, document), so a name's pairs are pairs of documents, not of relations.
    """
    points = role_points(F.col("role")) if points is None else points
    per = links.where("name is not null").withColumn("_p", points).groupBy("name", "doc_id").agg(F.sum("_p").alias("points"), F.count("*").alias("n"))
    left = (per if of is None else per.where(of)).select("name", F.col("doc_id").alias("source_id"))
    pairs = left.join(per, "name").where("source_id <> doc_id").groupBy("source_id", "doc_id").agg(F.sum("points").alias("points"), F.sum("n").alias("shared"))
    own = documents.select(F.col("doc_id").alias("source_id"), F.col("ministry").alias("_own"))
    scored = pairs.join(own, "source_id").join(documents.select("doc_id", "ministry"), "doc_id")
    same = F.when(F.col("_own") == F.col("ministry"), 1).otherwise(0)
    scored = scored.select("source_id", "doc_id", "shared", (F.col("points") + same).alias("score"), (same == 1).alias("same_ministry"))
    best = Window.partitionBy("source_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def related_reasons(links: DataFrame, doc, other: DataFrame) -> DataFrame:
    """M16. Why documents are related to one: each shared person with points, role, excerpt and page."""
    names = links.where(F.col("doc_id") == doc).select("name").distinct()
    shared = links.where(F.col("doc_id") != doc).join(names, "name", "left_semi").join(other.select("doc_id"), "doc_id", "left_semi")
    low, p = F.lower(F.coalesce("role", F.lit(""))), role_points(F.col("role"))
    kind = F.when(low.contains("utredare") | low.contains("minister") | low.contains("statsråd"), "lead").otherwise("committee")
    return shared.where(p > 0).withColumn("reason", kind).withColumn("points", p)


def document_context(doc, process_documents: DataFrame, processes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M17. (processes of a document, its actors with excerpts)."""
    own = process_documents.where(F.col("doc_id") == doc).join(processes, "process_id")
    return own, links.where(F.col("doc_id") == doc).orderBy("name")


def process_actors(process, process_documents: DataFrame, links: DataFrame) -> DataFrame:
    """M18. Actors of a process by name and type: their roles and how many of its documents name them."""
    rows = links.join(process_documents.where(F.col("process_id") == process).select("doc_id"), "doc_id", "left_semi")
    out = rows.groupBy("name", "actor_type").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.count_distinct("doc_id").alias("documents"))
    return out.orderBy(F.col("documents").desc(), "name")


def process_page(process, process_documents: DataFrame, documents: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M19. (documents with role, events newest first, documents by type) of a process."""
    docs = process_documents.where(F.col("process_id") == process).join(documents, "doc_id")
    own = events.where(F.col("process_id") == process).orderBy(F.col("event_date").desc(), "event_type")
    return docs.orderBy("doc_type", "doc_id"), own, docs.groupBy("doc_type").agg(F.count("*").alias("n"))


def related_actors(links: DataFrame, actor, top: int = 10) -> DataFrame:
    """M20. Other actors on an actor's documents, by number of relations. links: doc_id, actor_id."""
    own = links.where(F.col("actor_id") == actor).select("doc_id").distinct()
    rows = links.where(F.col("actor_id") != actor).join(own, "doc_id", "left_semi").groupBy("actor_id").agg(F.count("*").alias("connections"))
    return rows.orderBy(F.col("connections").desc(), "actor_id").limit(top)


def actor_timeline(links: DataFrame, process_documents: DataFrame, events: DataFrame, actor, n: int = 20) -> DataFrame:
    """M21. The latest events of the processes that an actor's documents are in."""
    docs = links.where(F.col("actor_id") == actor).select("doc_id")
    processes = process_documents.join(docs, "doc_id", "left_semi").select("process_id")
    return events.join(processes, "process_id", "left_semi").orderBy(F.col("event_date").desc(), "process_id", "event_type").limit(n)


def actor_responses(responses: DataFrame, cases: DataFrame, actor=None) -> DataFrame:
    """M22. Per actor and case the answer that counts (with a stance, no attachment, by file name) and the others.
    responses: actor_id, case_id, filename, stance; cases: case_id, case_date. By falling date."""
    own = responses if actor is None else responses.where(F.col("actor_id") == actor)
    stance = F.coalesce((F.col("stance") != "no_position") & (F.col("stance") != ""), F.lit(False))
    attached = F.coalesce(F.lower("filename").contains("bilaga"), F.lit(False))
    order = Window.partitionBy("actor_id", "case_id").orderBy(stance.desc(), attached.asc(), F.coalesce("filename", F.lit("")), "stance")
    ranked = own.withColumn("_n", F.row_number().over(order))
    out = ranked.groupBy("actor_id", "case_id").agg(
        F.max(F.when(F.col("_n") == 1, F.col("filename"))).alias("primary_file"), F.max(F.when(F.col("_n") == 1, F.col("stance"))).alias("primary_stance"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") > 1, F.struct("_n", "filename")))), lambda x: x["filename"]).alias("attachments"),
    )
    return out.join(cases.select("case_id", "case_date"), "case_id", "left").orderBy(F.col("case_date").desc_nulls_last(), "case_id")


def actor_documents(links: DataFrame, documents: DataFrame, actor) -> DataFrame:
    """M23. An actor's documents, newest first."""
    return links.where(F.col("actor_id") == actor).join(documents, "doc_id").orderBy(F.col("publication_date").desc_nulls_last(), "doc_id")


def actor_invites(invites: DataFrame, cases: DataFrame, actor) -> DataFrame:
    """M23. An actor's invitations with their case, latest first."""
    return invites.where(F.col("actor_id") == actor).join(cases, "case_id").orderBy(F.col("case_date").desc_nulls_last(), "case_id")
