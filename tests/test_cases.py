"""Stances, references, processes, participation and streams on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import entities as E
from casegraph.operators import metrics as M
from casegraph.operators import network as N
from casegraph.operators import process as C
from casegraph.operators import references as G
from casegraph.operators import search as Q
from casegraph.operators import stance as P
from casegraph.sources import tables as S
from casegraph.streaming import streams as R

FILL = " Detta är en text som är lång nog för att räknas och den säger annars ingenting om saken i fråga."


def test_stances(spark):
    texts = [
        ("short", "Vi tillstyrker.", "neutral"), ("summary", "Sammanfattning\nVi tillstyrker förslaget.\n" + FILL, "support"), ("negated", "Myndigheten kan inte tillstyrka förslaget." + FILL, "oppose"),
        ("tie", "Vi tillstyrker med förbehåll." + FILL, "conditional"), ("none", "Vi har inga synpunkter." + FILL, "neutral"), ("mixed", "Vi tillstyrker delar men avstyrker andra." + FILL, "mixed"),
    ]
    got = {r["id"]: r for r in P.stance(spark.createDataFrame(texts, "id string, text string, expected string")).collect()}
    assert {i: got[i]["stance"] for i, _, _ in texts} == {i: e for i, _, e in texts}
    assert got["negated"]["oppose_count"] == 1 and got["negated"]["support_count"] == 0
    assert got["summary"]["section_context"] == "summary"


def test_references(spark):
    docs = spark.createDataFrame([("a", "SOU 2024:55", "Ett gemensamt registerutdrag för arbetsgivare"), ("b", "Dir. 2023:1", "x")], "doc_id string, doc_number string, title string")
    refs = spark.createDataFrame([(1, "z", "sou 2024:55"), (2, "z", "Betänkandet SOU 2024:55, om utdrag"), (3, "z", "SOU 1999:1"), (4, "z", "ingenting alls"), (5, "z", "Remiss av ett gemensamt registerutdrag för arbetsgivare"), (6, "z", "Kommittédirektiv")], "ref_id int, source_id string, target_number string")
    got = {r["ref_id"]: r for r in G.resolve_references(refs, docs).collect()}
    assert [got[i]["outcome"] for i in range(1, 7)] == ["resolved", "resolved", "no_match", "extraction_failed", "extraction_failed", "extraction_failed"]
    assert got[1]["evidence"] == "direct_match" and got[2]["evidence"] == "sou_pattern" and got[2]["target_id"] == "a"
    titles = {r["ref_id"]: r for r in G.match_titles(refs.where("ref_id >= 4"), docs).collect()}
    assert titles[5]["target_id"] == "a" and titles[5]["reason"] == "matched" and titles[4]["reason"] == "no_candidates" and 6 not in titles


def test_orphans_become_processes(spark):
    kinds = {"d1": "directive", "d2": "sou", "d3": "proposition", "p1": "sou", "x": "sou", "y": "sou"}
    docs = spark.createDataFrame([(k, f"N {k}", v, f"T {k}", "Fi" if k == "d2" else None) for k, v in kinds.items()], "doc_id string, doc_number string, doc_type string, title string, ministry string")
    edges = spark.createDataFrame([("d1", "d2"), ("d2", "d3"), ("x", "p1"), ("y", "p1"), ("y", "p2"), ("d1", "d1")], "source_id string, target_id string")
    members = spark.createDataFrame([("A", "p1"), ("B", "p2")], "process_id string, doc_id string")
    adopted, rest = G.adopt_orphans(edges, members)
    assert [tuple(r) for r in adopted.collect()] == [("x", "A")] and [tuple(r) for r in rest.collect()] == [("y", "conflict")]
    clusters = G.orphan_clusters(edges, G.orphans(docs, members), adopted)
    processes, bridge, large = G.clusters_to_processes(clusters, docs)
    made = processes.collect()
    assert len(made) == 1 and made[0]["title"] == "T d3" and made[0]["stage"] == "proposition" and made[0]["ministry"] == "Fi" and made[0]["size"] == 3
    h = 0
    for ch in "N d1|N d2|N d3":
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >= 1 << 31 else h)
    digits = ""
    while h:
        digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
    assert made[0]["process_key"] == f"auto-Nd3-{digits[:8]}"
    assert {r["doc_id"]: r["role"] for r in bridge.collect()} == {"d1": "directive", "d2": "sou", "d3": "proposition"} and large.count() == 0


def test_long_chains_have_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    for small in (0, 30, 200_000):
        got = {r["node"]: r["component"] for r in G.components(edges, small=small).collect()}
        assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and len(got) == 203
    assert G.components(edges.where("false"), small=0).count() == 0
    names = spark.createDataFrame([("b", "c"), ("d", "c"), ("x", "x"), (None, "b")], "a string, b string")
    for small in (0, 200_000):
        assert {tuple(r) for r in G.components(names, small=small).collect()} == {("b", "b"), ("c", "b"), ("d", "b")}


def test_stage_needs_document_and_event(spark):
    p = spark.createDataFrame([("1", "directive"), ("2", "law"), ("3", "remiss")], "process_id string, current_stage string")
    docs = spark.createDataFrame([("1", "sou"), ("2", "sou"), ("3", "dir")], "process_id string, doc_type string")
    events = spark.createDataFrame([("1", "sou_published", dt.date(2024, 3, 7)), ("3", "remiss_period_start", None)], "process_id string, event_type string, event_date date")
    got = {r["process_id"]: r for r in C.verify_stages(C.stage(C.evidence(p, docs, events))).collect()}
    assert got["1"]["stage"] == "published" and "(7 mars 2024)" in got["1"]["stage_explanation"] and got["1"]["valid_transition"]
    assert got["2"]["stage"] == "directive" and not got["2"]["valid_transition"]
    assert got["3"]["stage"] == "remiss" and got["3"]["match"]


def test_events_merge(spark):
    cols = "process_id string, event_type string, event_date date, person string, metadata string"
    old = spark.createDataFrame([("1", "sou_published", dt.date(2024, 1, 1), None, "a"), ("1", "committee_formed", None, "Ann", "b")], cols)
    new = spark.createDataFrame([("1", "sou_published", dt.date(2024, 1, 1), None, "c"), ("1", "committee_formed", None, "Bo", "d")], cols)
    got = {(r["event_type"], r["person"]): (r["metadata"], r["action"]) for r in C.merge_events(old, new).collect()}
    assert got == {("sou_published", None): ("c", "updated"), ("committee_formed", "Ann"): ("b", "kept"), ("committee_formed", "Bo"): ("d", "inserted")}


def test_participation(spark):
    responses = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 1, "x"), (None, 1, "x")], "actor_id string, case_id int, stance string")
    invites = spark.createDataFrame([("a", 1), ("a", 2), ("c", 2)], "actor_id string, case_id int")
    names = spark.createDataFrame([("a", "Ann")], "actor_id string, name string")
    got = {r["actor_id"]: tuple(r)[1:] for r in M.participation(responses, invites, names).collect()}
    assert got == {"a": ("Ann", 2, 2, 100, 0), "b": ("Unknown", 1, 0, None, 1), "c": ("Unknown", 0, 1, 0, 0)}


def test_pairs_need_the_same_kind_of_presence(spark):
    invites = spark.createDataFrame([(1, 1), (2, 1), (1, 2)], "actor_id int, case_id int")
    responses = spark.createDataFrame([(1, 1), (3, 2), (3, 1)], "actor_id int, case_id int")
    cases = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, None)], "case_id int, case_date date")
    got = {(r["actor_a"], r["actor_b"]): (r["invite_count"], r["response_count"], r["shared_count"], r["jaccard"]) for r in N.cooccurrence(invites, responses, cases).collect()}
    assert got == {(1, 2): (1, 0, 1, 0.5), (1, 3): (0, 1, 1, 0.3333)}


def test_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "v")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(S.upsert(b, a, ["k"])) == [(1, "x"), (2, "z"), (3, "v")]
    assert rows(S.upsert(b, a, ["k"], "ignore")) == [(1, "x"), (2, "y"), (3, "v")]
    assert rows(S.insert_absent(b, a, ["k"])) == [(3, "v")]
    q = S.citation_quality({"t": spark.createDataFrame([(1, "e"), (None, "e"), (None, None)], "source_page int, source_excerpt string"), "empty": spark.createDataFrame([], "source_page int, source_excerpt string")})
    assert {r["table_name"]: (r["total"], r["coverage"], r["violations"]) for r in q.collect()} == {"t": (3, 33.33, 1), "empty": (0, None, 0)}
    c = spark.createDataFrame([('{"a": 1}',), ('[{"a": 1}, {"a": 2}]',), (None,)], "j string")
    assert [len(r[0]) for r in c.select(S.one_or_many(F.col("j"), "struct<a:int>")).collect()] == [1, 2, 0]


def test_streams_agree_with_batches(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque*").withColumn("ts", F.col("ts").cast("timestamp"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    counts = run(R.task_counts(stream), "counts", "complete")
    batch = events.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert counts.count() == batch.count() and counts.agg(F.sum("n")).first()[0] == events.count()
    # in append mode a window is told once, when the watermark has passed it, and its state goes
    appended = run(R.task_counts(stream, delay="1 hour"), "appended", "append")
    closed = {(r["window_start"], r["event_type"]): r["n"] for r in appended.collect()}
    whole = {(r["window"]["start"], r["event_type"]): r["count"] for r in batch.collect()}
    assert closed and appended.count() == len(closed) and all(whole[k] == n for k, n in closed.items())
    renamed = stream.withColumnRenamed("user_id", "case_id")
    spans = run(R.stream_velocity(renamed, "signup", "purchase"), "spans", "update").where("days > 0 and not closed")
    direct = M.velocity(events.select(F.col("user_id").alias("case_id"), "event_type", F.to_date("ts").alias("event_date")), "signup", "purchase")
    assert spans.select("case_id", "days").exceptAll(direct.select("case_id", "days")).count() == 0 and spans.count() == direct.count()
    once = run(R.dedup_events(renamed.withColumn("event_date", F.to_date("ts"))), "once", "append")
    assert once.count() == events.select("user_id", "event_type", F.to_date("ts")).distinct().count()


def test_a_table_is_replaced_by_a_query_over_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    S.full_refresh(spark.read.parquet(path).where("id < 3"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2] and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception, match="no number"):
        S.full_refresh(spark.range(3).select(F.raise_error(F.lit("no number")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3


def test_limits_raise(spark):
    words = spark.createDataFrame([(f"ord{i}", "support") for i in range(4)], "keyword string, category string")
    assert len(P.rule_table(words, most=4)["support"]) == len(P.rule_table()["support"]) + 4
    with pytest.raises(ValueError, match="more than 3"):
        P.rule_table(words, most=3)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "doc_id int, embedding array<double>")
    assert Q.similar_documents(vectors, [1], most=1).count() == 1
    with pytest.raises(ValueError, match="more than 1"):
        Q.similar_documents(vectors, [1, 2], most=1)


def test_new_entities_with_numbers_as_ids(spark):
    entities = spark.createDataFrame([(1, "Ann")], "entity_id long, entity_name string")
    clash = spark.range(1).select(F.xxhash64(F.lit("bo")).alias("entity_id"), F.lit("Cy").alias("entity_name"))
    rows = spark.createDataFrame([(i, None, "low") for i in range(5)], "id int, entity_id long, match_confidence string")
    decisions = spark.createDataFrame([(0, "create", None, "Bo"), (1, "create", None, " bo "), (2, "create", None, "ann"), (3, "approve", 1, None), (4, "reject", None, None)], "id int, action string, entity_id long, new_name string")
    out, every = E.apply_decisions(rows, entities.unionByName(clash), decisions)
    got = {r["id"]: (r["entity_id"], r["match_confidence"]) for r in out.collect()}
    assert got[0] == got[1] and got[0][0] is not None and got[0][1] == "high" and got[2] == (1, "high") and got[3] == (1, "high") and got[4] == (None, "rejected")
    ids = [r["entity_id"] for r in every.collect()]
    assert len(ids) == len(set(ids)) == 3


def test_similar_pairs_are_all_found(spark):
    rng = random.Random(4)
    made = {"".join(rng.choice("abc -") for _ in range(rng.randint(2, 14))) for _ in range(120)} | {"kommun", "kommunen i abc", "abc stad", "abc kommun"}
    names = sorted(n for n in made if len(" ".join(n.replace("-", " ").split())) > 1)  # shorter ones have no bigrams
    df = spark.createDataFrame([(n,) for n in names], "n string")
    left, right = df.select(F.col("n").alias("a")), df.select(F.col("n").alias("b"))
    plain = left.crossJoin(right).select("a", "b", E.similarity(F.col("a"), F.col("b")).alias("score")).where("score >= 0.5")
    rows = lambda d: {(r["a"], r["b"], round(r["score"], 9)) for r in d.collect()}
    assert rows(E.similar_pairs(left, right)) == rows(plain)


def test_modes_of_linking(spark):
    entities = spark.createDataFrame([(1, "Kalmar kommun"), (2, "Naturvårdsverket")], "entity_id long, entity_name string")
    bands = [None, "high", "medium", "low", "unmatched", "rejected"]
    rows = [(i, "Kalmar kommun", None, b) for i, b in enumerate(bands)] + [(10 + i, "Naturvårdsverket.pdf", 1, b) for i, b in enumerate(bands)] + [(20, None, None, None), (21, "info@x.se", None, None), (22, "Okänt sällskap", None, None), (23, "Naturvårdsverkett", None, None)]
    frame = spark.createDataFrame(rows, "id long, responding_organization string, entity_id long, match_confidence string")

    def linked(mode, **how):
        return {r["id"]: (r["entity_id"], r["match_confidence"]) for r in E.link_responses(frame, entities, mode=mode, **how).collect()}

    before = {r[0]: (r[2], r[3]) for r in rows}
    first = {22: (None, "unmatched"), 23: (2, "high")}
    expected = {"unlinked": [0], "pending_review": [0, 2, 3, 4], "unmatched_and_rejected": [0, 5], "all": [0, 1, 2, 3, 4, 5]}
    for mode, ids in expected.items():
        assert linked(mode) == before | first | {i: (1, "high") for i in ids}, mode
    assert linked("all", force=True) == before | first | {i: (1, "high") for i in range(6)} | {10 + i: (2, "high") for i in range(6)}
    held = linked("all", force=True, held=F.col("id") < 12)
    assert all(held[i] == before[i] for i in before if i < 12) and held[15] == (2, "high")
    with pytest.raises(ValueError):
        E.link_responses(frame, entities, mode="unmatched")


def test_rejections_survive_passes(spark):
    entities = spark.createDataFrame([("a", "Kalmar kommun"), ("b", "Naturvårdsverket")], "entity_id string, entity_name string")
    rows = spark.createDataFrame([(i, n, None, None) for i, n in enumerate(["Kalmar kommun", "Kalmar kommun", "Naturvårdsverket", "Okänt sällskap", "OKÄNT sällskap", "Kalmar kommun"])], "id long, responding_organization string, entity_id string, match_confidence string")
    log = spark.createDataFrame([(1, "person", 5, "reject", None), (1, "model", 9, "approve", "b"), (1, "rule", 10, "approve", "a"), (2, "model", 1, "approve", "a"), (2, "model", 0, "reject", None), (4, "person", 1, "reject", None), (5, "person", 2, "approve", "a"), (5, "person", 2, "reject", None), (0, "nobody", 3, "reject", None)], "id long, source string, decided_at int, action string, entity_id string")
    expected = {0: ("a", "high"), 1: (None, "rejected"), 2: ("a", "high"), 3: (None, "unmatched"), 4: (None, "rejected"), 5: (None, "rejected")}
    for mode in ("unlinked", "unmatched_and_rejected", "pending_review", "all"):
        first = E.relink(rows, entities, log, mode=mode)[0]
        again = E.relink(first, entities, log, mode=mode)[0]
        assert sorted(again.columns) == sorted(first.columns)
        for out in (first, again):
            assert {r["id"]: (r["entity_id"], r["match_confidence"]) for r in out.collect()} == expected, mode
    forced, known = E.relink(first, entities, log, mode="all", force=True, create=True)
    got = {r["id"]: (r["entity_id"], r["match_confidence"]) for r in forced.collect()}
    created = {r["entity_name"]: r["entity_id"] for r in known.collect()}["Okänt sällskap"]
    assert got == expected | {2: ("b", "high"), 3: (created, "unmatched")}  # a model's word gives way to force, a person's does not


def test_extracted_people_with_numbers_as_ids(spark):
    people = spark.createDataFrame([(1, "sou", "A", "person", "Särskild utredare"), (1, "sou", "B", "person", "expert"), (2, "directive", "A", "person", None)], "doc_id long, doc_type string, name string, entity_type string, role string")
    entities = spark.createDataFrame([(5, "person", "B"), (6, "organization", "A")], "entity_id long, entity_type string, entity_name string")
    relations = spark.createDataFrame([(5, 1, "mentioned")], "entity_id long, doc_id long, relation_type string")
    known, edges, counts = E.upsert_extracted(people, entities, relations)
    ids = {(r["entity_type"], r["entity_name"]): r["entity_id"] for r in known.collect()}
    assert len(ids) == 3 and ids["person", "B"] == 5
    new = ids["person", "A"]
    assert {tuple(r) for r in edges.collect()} == {(5, 1, "mentioned"), (new, 1, "lead"), (new, 2, "assigned")} and tuple(counts.first()) == (1, 1)


@pytest.mark.parametrize("block", [2, 5, 2000])
def test_cases_of_many_actors_meet_in_blocks(spark, block):
    r = random.Random(3)
    held = {(c, a): (r.random() < 0.7, r.random() < 0.5) for c in range(12) for a in range(20) if c == 0 or r.random() < 0.3}
    pick = lambda k: spark.createDataFrame([(c, a) for (c, a), f in held.items() if f[k] for _ in range(2)] + [(None, 1), (3, None)], "case_id long, actor_id long")
    cases = spark.createDataFrame([(c, dt.date(2024, 1, 1 + c % 5) if c % 4 else None) for c in range(12)], "case_id long, case_date date")
    there = {k: f for k, f in held.items() if any(f)}
    n, expected = {}, {}
    for (_, a) in there:
        n[a] = n.get(a, 0) + 1
    for a in range(20):
        for b in range(a + 1, 20):
            both = [c for c in range(12) if (c, a) in there and (c, b) in there and any(x and y for x, y in zip(there[c, a], there[c, b], strict=True))]
            if both:
                order = sorted(both, key=lambda c: (-(1 + c % 5) if c % 4 else 99, c))
                expected[a, b] = (len(both), order[:3], len(both) / (n[a] + n[b] - len(both)))
    pairs = N.cooccurrence(pick(0), pick(1), cases, keep_cases=3, block=block)
    got = {(x["actor_a"], x["actor_b"]): (x["shared_count"], x["shared_cases"], x["jaccard"]) for x in pairs.collect()}
    assert got.keys() == expected.keys() and all(got[k][:2] == v[:2] and abs(got[k][2] - v[2]) < 1e-4 for k, v in expected.items())
    if block == 2:
        units = N.paired(N.presence(pick(0), pick(1)), block)
        assert "row" not in units.columns and units.count() == sum(v[0] for v in expected.values())
        actors = spark.createDataFrame([(a, f"n{a}") for a in range(20)], "actor_id long, name string")
        tied = lambda df: [(x["actor_id"], x["strength"], x["shared_count"], x["name"]) for x in df.orderBy(F.col("strength").desc(), "actor_id").collect()]
        assert tied(N.actor_neighbors(pick(0), pick(1), actors, 4, 6)) == tied(N.neighbors(pairs, actors, 4, 6))


def test_names_meet_stems_on_a_rare_part(spark):
    names = spark.createDataFrame([(f"Svenska kund{i:06d}",) for i in range(300)] + [("Sveriges kundverket",)], "name string")
    entities = spark.createDataFrame([(i, f"Kund{i:06d}föreningen") for i in range(300)], "entity_id long, entity_name string")
    got = {r["name"]: r["entity_id"] for r in E.match_stem(names, entities).collect()}
    assert got == {f"Svenska kund{i:06d}": i for i in range(300)}
    assert E._stem_meetings(names, entities, 6).count() <= 600  # they all begin alike: 90,000 pairs


def test_a_name_is_made_normal_once(spark, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), E.normalize_org

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(E, "normalize_org", lambda c: counted(plain(c)))
    rows = spark.range(400).select("id", F.concat(F.lit("Yttrande från Verket "), (F.col("id") % 2).cast("string")).alias("responding_organization"), F.lit(None).cast("long").alias("entity_id"), F.lit(None).cast("string").alias("match_confidence"))
    known = spark.createDataFrame([(7, "Verket 0")], "entity_id long, entity_name string")
    linked = E.link_responses(rows, known)
    assert {(r["entity_id"], r["n"]) for r in linked.groupBy("entity_id").agg(F.count("*").alias("n")).collect()} == {(7, 200), (None, 200)}
    assert seen.value <= 40
    assert E.with_normal_names(rows, "responding_organization", "name").where("name = 'Verket 1'").count() == 200
    fresh = E.bootstrap_entities(rows.select(F.col("responding_organization").alias("name"), F.col("id").alias("seen_at")), known, spark.createDataFrame([], "name_lower string, rule_type string"))[0]
    assert [(r["name_lower"], r["occurrences"]) for r in fresh.collect()] == [("verket 1", 200)]
    assert seen.value <= 120


def test_final_s_goes_but_for_kept_endings(spark):
    names = [("Kalmars", "Kalmars"), ("Borås", "Borås"), ("Stiftelsen Ukrainas", "Stiftelsen Ukrainas"), ("Stiftelsen KALMARS", "Stiftelsen KALMARS"), ("Ässas", "Ässas"), ("Försvarets", "Försvaret")]
    got = {r["a"]: r["b"] for r in spark.createDataFrame(names, "a string, w string").select("a", E.normalize_org(F.col("a")).alias("b")).collect()}
    assert got == dict(names)


def test_answers_are_exchanged_once_for_their_boards(spark):
    from casegraph.plans.derived import answers

    plan = answers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan


def test_the_table_of_aliases_takes_no_python_rows(spark):
    table = E.aliases(spark)
    assert "Scan ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
    assert ("SKR", "sveriges kommuner och regioner") in {tuple(r) for r in table.collect()}


def test_equal_links_are_judged_once(spark, monkeypatch):
    judged, kinds = spark.sparkContext.accumulator(0), G.link_kind

    def counted(url, anchor):
        @F.udf("string")
        def seen(x):
            judged.add(1)
            return x

        return kinds(url, anchor) | {"external_type": seen(url)}

    monkeypatch.setattr(G, "link_kind", counted)
    links = spark.createDataFrame([(i, "https://www.regeringen.se/x", "SOU 2024:5") for i in range(50)] + [(1, None, "Ds 2024:1"), (2, "https://www.regeringen.se/x", None)], "source_id int, url string, anchor string")
    rows = G.store_link_references(links, spark.createDataFrame([(7, "SOU 2024:5")], "doc_id int, doc_number string")).collect()
    assert judged.value < 10
    assert sorted((r["source_id"], r["target_number"], r["target_id"]) for r in rows) == sorted([(i, "SOU 2024:5", 7) for i in range(50)] + [(1, "Ds 2024:1", None)])
