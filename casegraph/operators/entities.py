"""Free-text organisation names to known entities: normal names, matching cascade, linking, review, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rules import FLAGS
from ..functions.text import normal_form, once
from ..sources.scratch import checkpointed, written


def has_contact(c: Column) -> Column:
    return c.rlike("(?i)" + rules.CONTACT)


def is_boilerplate(c: Column) -> Column:
    """E2. Contact details or one of the blocked phrases."""
    return has_contact(F.trim(c)) | F.trim(c).rlike(FLAGS + "|".join(rules.BOILERPLATE))


def normalize_org(c: Column) -> Column:
    """E1. An organisation's name without file size and ending, attachment words, company form, bracketed abbreviation
    and possessive s; empty for contact details and document titles."""
    raw = normal_form(F.coalesce(c, F.lit("")), "NFKC")
    cut = lambda c, *patterns: reduce(lambda c, p: F.regexp_replace(c, FLAGS + p, ""), patterns, c)
    size = r"\d+(\.\d+)?\s*(kB|mb|b)"
    name = cut(raw, rf"\s*\((pdf|word|doc|docx)\s+{size}\)\s*$", rf"\s+{size}\s*$", r"\.(pdf|docx?|xlsx?|pptx?|odt|rtf)\s*$")
    name = F.trim(F.regexp_replace(name, FLAGS + r"\s+", " "))
    name = F.trim(cut(name, r"^bilaga\s+", r"^övrigt\s+yttrande\s+", r"^yttrande\s+från\s+"))
    name = F.trim(cut(name, r"\s*bilaga\s*(?:till\s+remissvar)?\s*$", r"\s*bilaga\s+\d+\s*$", r"\s*svar\s*$", r"\s+AB$"))
    name = F.trim(F.regexp_replace(name, r"\s*\([A-ZÄÖÅ]{2,6}\)\s*$", ""))
    kept = "|".join(e[:-1] for e in rules.KEEP_FINAL_S)
    # the s is asked for first: the list of endings is dear and is tried at one place a name only
    name = F.regexp_replace(name, rf"{FLAGS}^(.{{6,}})(?=(?-i:s)$)(?<!{kept})(?-i:s)$", "$1")
    name = F.regexp_replace(name, FLAGS + r"\bAP[\s–]+fonden\b", "AP-fonden")
    name = F.regexp_replace(name, FLAGS + r"\b(Patent|Post|Havs|Tandvårds|Klimat|Arbets|Miljö)\s+och\s+", "$1- och ")
    # made once a row, though it is both asked and given
    return once(F.struct(has_contact(raw).alias("contact"), name.alias("name")), lambda x: F.when(x["contact"] | x["name"].rlike(FLAGS + rules.DOCUMENT_TITLE), "").otherwise(x["name"]))


def folded(c: Column) -> Column:
    """A name for comparison: lower case, hyphens and runs of blanks as one blank."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "-", " "), r"\s+", " ")))


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring characters; none for shorter texts."""
    return F.when(F.length(c) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def _folded_similarity(x: Column, y: Column, ga: Column | None = None, gb: Column | None = None) -> Column:
    """similarity of names that are folded, given their bigrams where they are known."""
    ga, gb = bigrams(x) if ga is None else ga, bigrams(y) if gb is None else gb
    short, long = F.when(F.length(x) > F.length(y), y).otherwise(x), F.when(F.length(x) > F.length(y), x).otherwise(y)
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    whole = F.regexp_like(long, F.concat(F.lit(FLAGS + r"\b"), F.regexp_replace(short, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"\b")))
    dice = F.when((F.size(ga) > 0) & (F.size(gb) > 0), F.size(F.array_intersect(ga, gb)) * 2 / (F.size(ga) + F.size(gb))).otherwise(0.0)
    return F.when(x == y, 1.0).when((F.contains(x, y) | F.contains(y, x)) & ((ratio >= 0.5) | whole), F.lit(0.8) + F.lit(0.2) * ratio).otherwise(dice).cast("double")


def similarity(a: Column, b: Column) -> Column:
    """E6. 1 for names equal after folding; 0.8 + 0.2 * ratio of lengths where one holds the other and is at least half
    as long or stands as whole words in it; else twice the shared bigrams over the sum of both sides'."""
    empty = F.coalesce((F.length(a) == 0) | (F.length(b) == 0), F.lit(True))
    return F.when(empty, 0.0).otherwise(_folded_similarity(folded(a), folded(b)))


def municipal(c: Column) -> Column:
    """A town's name as its municipality's."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, FLAGS + r"\bstad\b", "kommun"), r"\s+", " "))


def _candidates(df: DataFrame, step: int, score: float, method: str) -> DataFrame:
    """Pairs (name, entity_id, entity_name) of one matching step as candidates; of several steps the least decides."""
    return df.select("name", "entity_id", "entity_name", F.lit(step).alias("step"), F.lit(score).alias("score"), F.lit(method).alias("method"))


def _decide(candidates: DataFrame) -> DataFrame:
    """One match per name: the first step's, of several entities the least id."""
    best = candidates.groupBy("name").agg(F.min_by(F.struct("entity_id", "entity_name", "score", "method"), F.struct("step", "entity_id")).alias("m"))
    return best.select("name", "m.entity_id", F.col("m.entity_name").alias("matched_name"), F.lit("high").alias("confidence"), "m.score", "m.method")


def exact_candidates(names: DataFrame, entities: DataFrame) -> DataFrame:
    """E3. Equal without case (step 1), equal without blanks and hyphens (2). names: name; entities: entity_id, entity_name."""
    plain, tight = lambda c: F.lower(c), lambda c: F.lower(F.regexp_replace(c, r"[\s-]", ""))
    meet = lambda key: names.withColumn("k", key(F.col("name"))).join(entities.withColumn("k", key(F.col("entity_name"))), "k")
    return _candidates(meet(plain), 1, 1.0, "exact").unionByName(_candidates(meet(tight), 2, 1.0, "exact"))


def match_exact(names: DataFrame, entities: DataFrame) -> DataFrame:
    """E3. The exact matches."""
    return _decide(exact_candidates(names, entities))


def aliases(spark) -> DataFrame:
    """The fixed table of abbreviations: alias (upper case) and target (lower case)."""
    rows = F.array(*(F.struct(F.lit(k.upper()).alias("alias"), F.lit(v.lower()).alias("target")) for k, v in rules.ABBREVIATIONS.items()))
    return spark.range(0, 1, 1, 1).select(F.inline(rows))  # one task of the JVM; rows of Python's would start a worker on each core


def abbreviation_candidates(names: DataFrame, entities: DataFrame) -> DataFrame:
    """E4. A name of up to 5 characters matches by what it stands for (step 3) or an entity with it in brackets (4); a
    longer one by its first word's expansion or brackets (5), or by any alias of 3 characters or more that both hold (6).

    The table of aliases is fixed, so each entity is first reduced to the aliases it fits; names then meet entities
    on an alias or a bracketed word, never all with all.
    """
    table = F.broadcast(aliases(names.sparkSession))
    low, up = F.lower("entity_name"), F.upper("entity_name")
    full = F.contains(low, F.col("target"))
    fits = entities.join(table, full | F.contains(F.col("target"), low)).select("alias", "entity_id", "entity_name", full.alias("full"))
    brackets = entities.select(F.explode(F.regexp_extract_all(up, F.lit(r"\(([^)]+)\)"), F.lit(1))).alias("alias"), "entity_id", "entity_name")
    holds = entities.join(table.where(F.length("alias") >= 3), F.contains(up, F.col("alias"))).select("alias", "entity_id", "entity_name")
    short = names.where(F.length("name") <= 5).withColumn("alias", F.upper("name"))
    long = names.where(F.length("name") > 5)
    known = long.withColumn("alias", F.upper(F.element_at(F.split("name", r"[\s-]"), 1))).join(table.select("alias"), "alias", "left_semi")
    inside = long.join(table.where(F.length("alias") >= 3).select("alias"), F.contains(F.upper("name"), F.col("alias"))).select("name", "alias")
    either = fits.where("full").select("alias", "entity_id", "entity_name").unionByName(brackets)
    steps = (short.join(fits, "alias"), short.join(brackets, "alias"), known.join(either, "alias"), inside.join(holds, "alias"))
    return reduce(DataFrame.unionByName, (_candidates(df, 3 + i, 1.0, "abbreviation") for i, df in enumerate(steps)))


def match_abbreviation(names: DataFrame, entities: DataFrame) -> DataFrame:
    """E4. The matches by abbreviation."""
    return _decide(abbreviation_candidates(names, entities))


def _grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _stem_meetings(names: DataFrame, entities: DataFrame, least: int) -> DataFrame:
    """Names and the entities whose stem may hold them. A stem that holds a name has all of the name's grams of `least`
    characters, so they meet on the one of these that the fewest stems have; a name with a gram of no stem meets none."""
    stem = reduce(lambda c, e: F.trim(F.regexp_replace(c, e + "$", "")), rules.ORG_ENDINGS, F.lower("entity_name"))
    part = F.regexp_replace(F.regexp_replace(F.lower("name"), r"^svenska?\s+", ""), r"^sveriges\s+", "")
    parts = names.select("name", part.alias("part")).where(F.length("part") >= least)
    right = entities.withColumn("stem", stem).withColumn("gram", F.explode(_grams(F.col("stem"), least)))
    held = right.groupBy("gram").agg(F.count("*").alias("n"))
    grams = parts.select("part").distinct().select("part", F.explode(_grams(F.col("part"), least)).alias("gram"))
    rarest = grams.join(held, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    left = parts.join(rarest.where("r.n > 0").select("part", "r.gram"), "part")
    return left.join(right, "gram")


def stem_candidates(names: DataFrame, entities: DataFrame, least: int = 6) -> DataFrame:
    """E5. An entity's name without its ending holds the name without Svensk(a) or Sveriges, of `least` characters or
    more (step 7)."""
    return _candidates(_stem_meetings(names, entities, least).where(F.contains("stem", "part")), 7, 0.95, "stem")


def match_stem(names: DataFrame, entities: DataFrame) -> DataFrame:
    """E5. The matches by stem."""
    return _decide(stem_candidates(names, entities))


def _forms(c: Column) -> list[Column]:
    """A name's forms for comparison: folded, and folded as a municipality's."""
    return [folded(F.lower(c)), folded(municipal(F.lower(c)))]


def _with_grams(names: DataFrame, key: str, forms) -> DataFrame:
    """Distinct names (key) with their forms f0, f1, ... and the forms' bigrams g0, g1, ..."""
    made = forms(F.col(key))
    rows = names.withColumns({f"f{k}": f for k, f in enumerate(made)})
    return written(rows.withColumns({f"g{k}": bigrams(F.col(f"f{k}")) for k in range(len(made))}), "names")


def _rare_grams(names: DataFrame, key: str, n_forms: int, counts: DataFrame) -> DataFrame:
    """(key, all, early, first) of names with bigrams: in order of rarity for each form, and of all forms together all of
    them, the rarest two thirds (one more, rounded up), and the rarest one of each."""
    grams = names.select(key, F.posexplode(F.array(*(f"g{k}" for k in range(n_forms)))).alias("form", "grams")).select(key, "form", F.explode("grams").alias("gram"))
    ranked = grams.join(counts, "gram").groupBy(key, "form").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]).alias("g"))
    early = F.slice("g", F.lit(1), F.size("g") - F.ceil(F.size("g") / 3).cast("int") + 1)
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return written(ranked.groupBy(key).agg(every("g").alias("all"), every(early).alias("early"), every(F.slice("g", 1, 1)).alias("first")), "grams")


def similar_pairs(left: DataFrame, right: DataFrame, forms=lambda c: [folded(c)]) -> DataFrame:
    """E6. Pairs (a, b, score) of left (a) and right (b), tables of distinct names, whose similarity in one of their forms
    is .5 or more; all such pairs are found.

    Names meet on rare bigrams, never all with all. At .5 or more by bigrams two names share at least a third of either
    side's, so they share one of the rarest two thirds of both (prefix filter); a name that is part of another shares its rarest
    bigram with it. Rarity counts both tables, so a common bigram is no name's meeting place unless it has no rarer ones.
    Forms and bigrams are made once a name, not once a pair. A name of one character has no bigram and is in no pair.
    """
    sides = {"a": _with_grams(left, "a", forms), "b": _with_grams(right, "b", forms)}
    n = len(forms(F.lit("")))
    grams = lambda c: sides[c].select(F.explode(F.array_distinct(F.flatten(F.array(*(f"g{k}" for k in range(n)))))).alias("gram"))
    counts = written(grams("a").unionByName(grams("b")).groupBy("gram").agg(F.count("*").alias("n")), "counts")
    rare = {c: _rare_grams(df, c, n, counts) for c, df in sides.items()}
    of = lambda c, kind: rare[c].select(c, F.explode(kind).alias("gram"))
    met = reduce(DataFrame.unionByName, (of("a", x).join(of("b", y), "gram").select("a", "b") for x, y in (("early", "early"), ("first", "all"), ("all", "first")))).distinct()
    named = lambda c: sides[c].select(c, *(F.col(f"{x}{k}").alias(f"_{c}{x}{k}") for x in "fg" for k in range(n)))
    both = met.join(named("a"), "a").join(named("b"), "b")
    score = lambda k: _folded_similarity(*(F.col(f"_{c}{x}{k}") for x in "fg" for c in "ab"))
    best = score(0)
    for k in range(1, n):  # another form counts where it differs
        same = (F.col(f"_af{k}") == F.col("_af0")) & (F.col(f"_bf{k}") == F.col("_bf0"))
        best = F.when(same, best).otherwise(F.greatest(best, score(k)))
    return both.select("a", "b", best.alias("score")).where("score >= 0.5")


def match_fuzzy(names: DataFrame, entities: DataFrame) -> DataFrame:
    """E7. The best similarity of each name, as it is or in municipal form, with bands: .9 high, .7 medium, .5 low. Names
    that reach .5 with no entity are unmatched, with score 0.

    Distinct names of both sides meet as in similar_pairs; of entities with one name the least id counts.
    """
    names, named = names.select("name").distinct(), entities.groupBy("entity_name").agg(F.min("entity_id").alias("entity_id"))
    pairs = similar_pairs(names.select(F.col("name").alias("a")), named.select(F.col("entity_name").alias("b")), _forms)
    best = pairs.groupBy("a").agg(F.max_by(F.struct("b", "score"), F.struct(F.col("score"), -F.length("b"), F.reverse("b"))).alias("m"))
    best = best.select(F.col("a").alias("name"), F.col("m.b").alias("entity_name"), F.col("m.score").alias("score")).join(named, "entity_name")
    out = names.join(best, "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    band = F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= 0.7, "medium").when(F.col("score") >= 0.5, "low").otherwise("unmatched")
    return out.select("name", "entity_id", F.col("entity_name").alias("matched_name"), band.alias("confidence"), "score", F.lit("fuzzy").alias("method"))


def resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """E8. Each distinct non-empty name through exact, abbreviation, stem and fuzzy matching; the first step that
    matches decides. A name of up to 5 characters that no step before the stem matches goes to review (low, 0).
    Columns: name, entity_id, matched_name, confidence, score, method.

    Steps give candidates side by side and one aggregate decides; what is decided is checkpointed, so the fuzzy match,
    which is the dear one, meets the other names only and nothing is computed twice.
    """
    names = checkpointed(names.where(F.trim("name") != "").select("name").distinct())
    entities = checkpointed(entities.select("entity_id", "entity_name").where("entity_name <> ''"))
    long = names.where(F.length("name") > 5)
    quick = reduce(DataFrame.unionByName, (exact_candidates(names, entities), abbreviation_candidates(names, entities), stem_candidates(long, entities)))
    decided = checkpointed(_decide(quick))
    left = names.join(decided.select("name"), "name", "left_anti")
    nobody, unknown = F.lit(None).cast(entities.schema["entity_id"].dataType).alias("entity_id"), F.lit(None).cast("string").alias("matched_name")
    review = left.where(F.length("name") <= 5).select("name", nobody, unknown, F.lit("low").alias("confidence"), F.lit(0.0).alias("score"), F.lit("abbreviation").alias("method"))
    rest = checkpointed(left.where(F.length("name") > 5))
    fuzzy = match_fuzzy(rest, entities)
    fuzzy = fuzzy.select("name", "entity_id", "matched_name", "confidence", "score", F.when(F.col("confidence") == "unmatched", "none").otherwise(F.col("method")).alias("method"))
    return decided.unionByName(review).unionByName(fuzzy)


def _rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


#: Which unlinked rows a mode takes, by their confidence: null means that none has looked at the row yet.
LINK_MODES = {"unlinked": (None,), "pending_review": (None, "medium", "low", "unmatched"), "unmatched_and_rejected": (None, "rejected"), "all": None}


def _asked(mode: str, force: bool) -> Column:
    if mode not in LINK_MODES:
        raise ValueError(f"mode must be one of {', '.join(LINK_MODES)}, not {mode}")
    bands = LINK_MODES[mode]
    band = F.lit(True) if bands is None else F.col("match_confidence").isNull() | F.coalesce(F.col("match_confidence").isin(*[b for b in bands if b]), F.lit(False))
    return band if force else band & F.col("entity_id").isNull()


def normal_names(rows: DataFrame, name: str) -> DataFrame:
    """(name column, _clean): the distinct names of a column with their normal forms, those that have one. The form is dear,
    so it is made once a name and not once a row, and is kept."""
    return checkpointed(rows.where(F.col(name).isNotNull()).select(name).distinct().select(name, normalize_org(F.col(name)).alias("_clean"))).where("_clean <> ''")


def with_normal_names(rows: DataFrame, name: str, out: str) -> DataFrame:
    """E1. rows with the normal form of their name as `out`, made once a distinct name."""
    return rows.join(normal_names(rows, name), name, "left").withColumn(out, F.coalesce("_clean", F.lit(""))).drop("_clean")


def link_responses(rows: DataFrame, entities: DataFrame, name: str = "responding_organization", mode: str = "unlinked", min_confidence: str = "high", force: bool = False, held: Column | None = None) -> DataFrame:
    """E9, E10. rows (id, name column, entity_id, match_confidence) with links, and matched_name and score of the match.

    mode says which rows are looked at: unlinked (no confidence yet), pending_review (also medium, low and unmatched ones),
    unmatched_and_rejected (no confidence, or rejected) or all; rows with an entity only with force. Rows for which held
    is true (what people have decided) are never touched. A match of min_confidence or better links; a lesser one is kept
    as a suggestion with its confidence, and a row that nothing matches is unmatched. A row whose name is empty once it
    is normal stays as it is, as do all rows that are not looked at, with the suggestion of an earlier pass."""
    asked = _asked(mode, force) if held is None else _asked(mode, force) & ~F.coalesce(held, F.lit(False))
    earlier = {"matched_name": "string", "score": "double"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in earlier.items() if c not in rows.columns})
    rows = rows.withColumn("_raw", F.when(asked, F.col(name)))
    names = normal_names(rows.select("_raw"), "_raw").withColumn("name", F.lower("_clean"))
    found = resolve(names.select("name"), entities)
    hit = names.join(found, "name").select("_raw", F.col("entity_id").alias("_entity"), F.col("matched_name").alias("_matched"), F.col("confidence").alias("_confidence"), F.col("score").alias("_score"))
    joined = rows.join(hit, "_raw", "left")
    looked = F.col("_confidence").isNotNull()
    good = (_rank(F.col("_confidence")) >= _rank(F.lit(min_confidence))) & F.col("_entity").isNotNull()
    new = {"entity_id": F.when(good, F.col("_entity")), "match_confidence": F.col("_confidence"), "matched_name": F.col("_matched"), "score": F.col("_score")}
    out = joined.withColumns({c: F.when(looked, x).otherwise(F.col(c)) for c, x in new.items()})
    return out.drop("_raw", "_entity", "_confidence", "_matched", "_score")


def create_unmatched(linked: DataFrame, entities: DataFrame, name: str = "responding_organization", held: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """E9. (rows, entities) with an entity for each normal name of an unmatched row, of which the least spelling counts. The
    rows link to it and keep their confidence, unmatched, which says how they came by it."""
    linked = checkpointed(linked)
    open_ = F.col("entity_id").isNull() & (F.col("match_confidence") == "unmatched")
    if held is not None:
        open_ = open_ & ~F.coalesce(held, F.lit(False))
    rows = linked.withColumn("_raw", F.when(open_, F.col(name)))
    forms = normal_names(rows.select("_raw"), "_raw").withColumn("_k", F.lower("_clean"))
    rows = rows.join(forms.select("_raw", "_k"), "_raw", "left").drop("_raw")
    names = forms.groupBy(F.col("_k").alias("k")).agg(F.min("_clean").alias("entity_name"))
    old = entities.groupBy(F.lower("entity_name").alias("k")).agg(F.min("entity_id").alias("_created"))
    new = checkpointed(_new_ids(names.join(old, "k", "left_anti"), entities))
    ids = old.unionByName(new.select(F.lower("entity_name").alias("k"), F.col("entity_id").alias("_created"))).withColumnRenamed("k", "_k")
    out = rows.join(ids, "_k", "left").withColumn("entity_id", F.when(F.col("_k").isNotNull(), F.col("_created")).otherwise(F.col("entity_id"))).drop("_k", "_created")
    return out, entities.unionByName(new, allowMissingColumns=True)


#: Whose word counts more: a person's over a model's over a rule's.
DECIDERS = ("rule", "model", "person")


def standing_decisions(log: DataFrame) -> DataFrame:
    """E14. Of a log of decisions (id, source, decided_at, action approve/reject, entity_id) the one that stands for each id: a
    person's before a model's before a rule's, then the latest; of several at one time a rejection, then the least entity.
    Other sources and actions are left out."""
    weight = reduce(lambda w, x: w.when(F.col("source") == x[1], x[0]), enumerate(DECIDERS), F.when(F.lit(False), 0))
    known = log.where(F.col("source").isin(*DECIDERS) & F.col("action").isin("approve", "reject")).withColumn("_weight", weight)
    # of equal times the last by these counts, so the entity is ordered downwards
    first = known.groupBy("id", "_weight", "decided_at").agg(F.max(F.when(F.col("action") == "reject", 1).otherwise(0)).alias("_no"), F.min(F.when(F.col("action") == "approve", F.col("entity_id"))).alias("_entity"))
    best = first.groupBy("id").agg(F.max_by(F.struct("_weight", "_no", "_entity"), F.struct("_weight", "decided_at")).alias("d"))
    no = F.col("d._no") == 1
    return best.select("id", F.element_at(F.array(*(F.lit(x) for x in DECIDERS)), F.col("d._weight") + 1).alias("source"), F.when(no, "reject").otherwise("approve").alias("action"), F.when(~no, F.col("d._entity")).alias("decided_entity"))


def replay_decisions(rows: DataFrame, log: DataFrame) -> DataFrame:
    """E14. rows (id, entity_id, match_confidence) as the log has them: approved ones have their entity (high), rejected ones
    none (rejected). Adds decided_by, whose decision stands (null: nobody's), anew at each call."""
    d = standing_decisions(log).select("id", F.col("source").alias("decided_by"), "action", "decided_entity")
    joined = rows.drop("decided_by").join(d, "id", "left")
    entity = F.when(F.col("action") == "approve", F.col("decided_entity")).when(F.col("action") == "reject", None).otherwise(F.col("entity_id"))
    band = F.when(F.col("action") == "approve", "high").when(F.col("action") == "reject", "rejected").otherwise(F.col("match_confidence"))
    return joined.withColumn("entity_id", entity).withColumn("match_confidence", band).drop("action", "decided_entity")


def relink(rows: DataFrame, entities: DataFrame, log: DataFrame, name: str = "responding_organization", mode: str = "unlinked", min_confidence: str = "high", force: bool = False, create: bool = False) -> tuple[DataFrame, DataFrame]:
    """E9, E14. (rows, entities) of one pass: decisions are replayed, then the rest is linked, and with create unmatched names
    become entities. What a person has decided holds in every mode, forced or not, so a rejection survives all passes;
    a model's or a rule's word holds unless the pass is forced."""
    decided = replay_decisions(rows, log)
    held = F.col("decided_by") == "person" if force else F.col("decided_by").isNotNull()
    linked = link_responses(decided, entities, name, mode, min_confidence, force, held)
    return create_unmatched(linked, entities, name, held) if create else (linked, entities)


def link_report(linked: DataFrame, name: str = "responding_organization", top: int = 20) -> tuple[DataFrame, DataFrame]:
    """E9. (rows by confidence, the normal names most often unmatched)."""
    raw = linked.where("match_confidence = 'unmatched'").groupBy(name).agg(F.count("*").alias("n"))  # a name's form is made once
    unmatched = raw.groupBy(normalize_org(F.col(name)).alias(name)).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), name).limit(top)
    return linked.groupBy("match_confidence").agg(F.count("*").alias("n")), unmatched


def bootstrap_entities(names: DataFrame, entities: DataFrame, name_rules: DataFrame, min_occurrences: int = 1, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """E11. (new entities with count and first spelling, counts by reason) of raw names (name, seen_at): checked, normal,
    short ones by the rule table (name_lower, rule_type), grouped without case, those that exist left out."""
    spelled = names.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("seen_at")).alias("seen_at"))  # what is said of a name is said once
    rows = checkpointed(spelled.withColumn("clean", normalize_org(F.col("name")))).withColumn("name_lower", F.lower("clean"))
    rows = rows.join(name_rules.select("name_lower", "rule_type"), "name_lower", "left")
    size = F.length("clean")
    reason = (
        F.when(F.col("name").isNull() | (F.length(F.trim("name")) < 3), "too_short").when(F.length("name") > 100, "too_long").when(has_contact(F.col("name")), "contact").when(is_boilerplate(F.col("name")), "boilerplate")
        .when(F.col("clean") == "", "not_a_name").when(F.col("rule_type") == "block", "blocked").when((size <= 4) & F.coalesce(F.col("rule_type") != "allow", F.lit(True)) & (F.col("clean") != F.upper("clean")), "short_mixed_case")
    )
    rows = rows.withColumn("reason", F.coalesce(reason, F.lit("ok")))
    good = rows.where("reason = 'ok'").groupBy("name_lower").agg(F.sum("n").alias("occurrences"), F.min_by("clean", F.struct("seen_at", "clean")).alias("entity_name"))
    fresh = good.where(F.col("occurrences") >= min_occurrences).join(entities.select(F.lower("entity_name").alias("name_lower")), "name_lower", "left_anti")
    if limit is not None:
        fresh = fresh.orderBy(F.col("occurrences").desc(), "name_lower").limit(limit)
    return fresh, rows.groupBy("reason").agg(F.sum("n").alias("n"))


def merge_duplicates(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E12. (kept entities, map from each id that goes to the one that stays): of names equal without case the oldest.
    entities: entity_id, entity_name, created_at."""
    first = entities.groupBy(F.lower("entity_name").alias("k")).agg(F.min(F.struct("created_at", "entity_id")).alias("m")).select("k", F.col("m.entity_id").alias("canonical_id"))
    joined = entities.withColumn("k", F.lower("entity_name")).join(first, "k")
    return joined.where("entity_id = canonical_id").drop("k", "canonical_id"), joined.where("entity_id <> canonical_id").select("entity_id", "canonical_id")


def repoint(facts: DataFrame, moved: DataFrame, col: str = "entity_id") -> DataFrame:
    """E12. facts with ids that went replaced by those that stay."""
    m = moved.select(F.col("entity_id").alias("_from"), "canonical_id")
    return facts.join(m, facts[col] == m["_from"], "left").withColumn(col, F.coalesce("canonical_id", col)).drop("_from", "canonical_id")


def review_queue(rows: DataFrame, n: int = 100) -> DataFrame:
    """E13. Rows without an entity whose confidence is missing, low, medium or unmatched; missing first."""
    some = F.col("match_confidence").isNull() | F.col("match_confidence").isin("low", "medium", "unmatched")
    return rows.where(F.col("entity_id").isNull() & some).orderBy(F.col("match_confidence").asc_nulls_first(), "id").limit(n)


def review_counts(rows: DataFrame) -> DataFrame:
    """E13. Unlinked rows by confidence."""
    return rows.where("entity_id is null").groupBy(F.coalesce("match_confidence", F.lit("none")).alias("confidence")).agg(F.count("*").alias("n"))


def _new_ids(names: DataFrame, entities: DataFrame, columns: tuple[str, ...] | list[str] = ("entity_name",)) -> DataFrame:
    """names (k and columns) with entity_id: the hash of k, SHA-1 as text or 64 bits as a number. A number that an
    entity has already gives way to a hash with a mark; of new names that share one the least keeps it."""
    kind = entities.schema["entity_id"].dataType.simpleString()
    if kind == "string":
        return names.select(F.sha1("k").alias("entity_id"), *columns)
    if kind != "bigint":
        raise TypeError(f"entity_id must be string or bigint for new entities, not {kind}")
    taken = entities.select(F.col("entity_id").alias("_id")).distinct()
    hashed = names.withColumn("_first", F.xxhash64("k")).join(taken, F.col("_first") == F.col("_id"), "left")
    hashed = hashed.select(F.when(F.col("_id").isNull(), F.col("_first")).otherwise(F.xxhash64(F.concat("k", F.lit("|")))).alias("entity_id"), F.struct(*columns).alias("_row"))
    return hashed.groupBy("entity_id").agg(F.min("_row").alias("_row")).select("entity_id", "_row.*")


def apply_decisions(rows: DataFrame, entities: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E14. (rows, entities) after decisions (id, action approve/reject/create, entity_id, new_name): approved rows get
    the entity, created ones a new one by name, with a hash of the name as id (text or bigint), rejected ones none."""
    new = decisions.where("action = 'create'").select(F.trim("new_name").alias("entity_name")).where("entity_name <> ''").distinct()
    new = new.withColumn("k", F.lower("entity_name")).groupBy("k").agg(F.min("entity_name").alias("entity_name"))
    old = entities.select(F.lower("entity_name").alias("k")).distinct()
    new = _new_ids(new.join(old, "k", "left_anti"), entities)
    every = entities.select("entity_id", "entity_name").unionByName(new)
    by_name = every.groupBy(F.lower("entity_name").alias("_k")).agg(F.min("entity_id").alias("_created"))
    d = decisions.select(F.col("id"), "action", F.col("entity_id").alias("_approved"), F.lower(F.trim("new_name")).alias("_k")).join(by_name, "_k", "left").drop("_k")
    joined = rows.join(d, "id", "left")
    entity = F.when(F.col("action") == "approve", F.col("_approved")).when(F.col("action") == "create", F.col("_created")).when(F.col("action") == "reject", None).otherwise(F.col("entity_id"))
    band = F.when(F.col("action").isin("approve", "create"), "high").when(F.col("action") == "reject", "rejected").otherwise(F.col("match_confidence"))
    return joined.withColumn("match_confidence", band).withColumn("entity_id", entity).drop("action", "_approved", "_created"), entities.unionByName(new, allowMissingColumns=True)


def upsert_extracted(people: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E15. (entities, relations, counts created and reused) with extracted people (doc_id, doc_type, name, entity_type,
    role). Entities are unique by (type, name), relations by (entity, document, kind). Ids are text or bigint."""
    keys = ["entity_type", "entity_name"]
    seen = people.select("entity_type", F.col("name").alias("entity_name")).distinct()
    fresh = seen.join(entities.select(*keys), keys, "left_anti").withColumn("k", F.concat_ws("|", *keys))
    new = _new_ids(fresh, entities, keys)
    all_entities = entities.select("entity_id", *keys).unionByName(new.select("entity_id", *keys))
    role = F.regexp_replace(F.lower(F.trim("role")), r"\s+", "_")
    kind = F.when(role.isin("särskild_utredare", "utredare", "huvudutredare"), "lead").when(role.isin("sekreterare", "huvudsekreterare"), "secretary").when(role.isin("ledamot", "ordförande"), "member").when(role.isin("minister", "statsråd"), "responsible").when(F.col("doc_type") == "directive", "assigned").otherwise("mentioned")
    edges = people.withColumn("relation_type", kind).withColumn("entity_name", F.col("name")).join(all_entities, keys).select("entity_id", "doc_id", "relation_type").distinct()
    fresh = edges.join(relations.select("entity_id", "doc_id", "relation_type"), ["entity_id", "doc_id", "relation_type"], "left_anti")
    counts = seen.join(entities.select(*keys, F.lit(1).alias("_old")), keys, "left").agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count_if(F.col("_old").isNotNull()).alias("reused"))
    return all_entities, relations.select("entity_id", "doc_id", "relation_type").unionByName(fresh), counts
