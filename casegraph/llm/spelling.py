"""Words of a corpus, and which of them are spelling variants of which, by permuterm rotations."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What a word is made of: Latin letters, and the letters and two signs from U+00C0 to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Stands for a word's end in its rotations; no letter.
END = "$"
_PRIME = 2**61 - 1
_BASES = [int(x) for x in np.random.default_rng(20240713).integers(2**40, 2**60, 2)]


def without(word: Column, at: Column) -> Column:
    """The word without its code point at `at` (from 0)."""
    return F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length(word)))


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, slips: int = 97) -> DataFrame:
    """The words of docs (doc_id, text) as word, n.

    A run of LETTERS has A-Z lower-cased. Where `slips` divides h, the unsigned crc32 of UTF-8 `<doc_id>:<run>`, the run's
    code point h % length is deleted, as a writer's slip would. Words are the distinct results of at least least_length
    code points with at least least_count occurrences. Null texts have none; a null doc_id is written as nothing.
    Occurrences are summed before the exchange, so a word that fills a third of the corpus is one row for each task."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all("text", F.lit(LETTERS + "{" + str(least_length) + ",}"), F.lit(0))).alias("run"),
    )
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run"))
    runs = runs.select("doc_id", low.alias("run")).withColumn("h", F.crc32(F.encode(F.concat("doc_id", F.lit(":"), "run"), "utf-8")))
    slip = without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))
    words = runs.select(F.when(F.col("h") % slips == 0, slip).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def hashed_rotations(word: str, longest: int) -> list[tuple[str, bool, bool]]:
    """(key, whole, first) of the rotations of a word whose keys have more than `longest` letters.

    A key is the count of letters, the place of END and two polynomial hashes modulo 2^61 - 1 of what stands before it and
    after it, from running sums, so a word of a million letters makes a million short keys."""
    n = len(word)
    sums, powers = [[0] * (n + 1) for _ in _BASES], [[1] * (n + 1) for _ in _BASES]
    for base, s, p in zip(_BASES, sums, powers, strict=True):
        for i, c in enumerate(word):
            s[i + 1] = (s[i] * base + ord(c)) % _PRIME
            p[i + 1] = p[i] * base % _PRIME

    def key(m: int, i: int, j: int) -> str:
        ends = ((s[i], (s[n] - s[j] * p[n - j]) % _PRIME) for s, p in zip(sums, powers, strict=True))
        return f"{m}:{i}:" + ":".join(f"{a:x}:{b:x}" for a, b in ends)

    out = []
    if n - 1 > longest:
        out += [(key(n - 1, i, i + 1), False, i == 0 or word[i] != word[i - 1]) for i in range(n)]
    if n > longest:
        out += [(key(n, i, i), True, False) for i in range(n + 1)]
    return out


def rotations(words: DataFrame, longest: int = 64) -> DataFrame:
    """The rotations of words (rank, word) as key, rank, whole, first.

    For each letter of word + END the rotation that ends with it, without it: two words that differ in that letter alone
    have this key in common (whole is false; first tells whether the letter is not the same as the one before, so that of
    the ways to take a letter out of "ll" one counts). And each rotation as it is (whole): a word that has one letter more
    there has this key too. Keys of more than `longest` letters are hashes, else a long word would make the square of its
    length in bytes."""
    word = F.col("word")
    first = lambda i: (i == 0) | (word.substr(i + 1, F.lit(1)) != word.substr(i, F.lit(1)))
    turned = lambda before, after: F.concat(word.substr(after + 1, F.length(word)), F.lit(END), word.substr(F.lit(1), before))
    skipped = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.struct(turned(i, i + 1).alias("key"), F.lit(False).alias("whole"), first(i).alias("first")))
    entire = F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.struct(turned(i, i).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("first")))
    short = words.where(F.length(word) <= longest + 1)
    own = F.when(F.length(word) <= longest, F.concat(skipped, entire)).otherwise(skipped)
    plain = short.select("rank", F.explode(own).alias("r")).select("r.key", "rank", "r.whole", "r.first")

    def hashes(batches):
        import pyarrow as pa

        for batch in batches:
            for rank, text in zip(batch.column("rank").to_pylist(), batch.column("word").to_pylist(), strict=True):
                found = hashed_rotations(text, longest)
                for a in range(0, len(found), 50_000):
                    key, whole, lead = zip(*found[a : a + 50_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([rank] * len(key), pa.int64()), pa.array(whole), pa.array(lead)], ["key", "rank", "whole", "first"])

    long = words.where(F.length(word) > longest).select("rank", "word").mapInArrow(hashes, "key string, rank long, whole boolean, first boolean")
    return plain.unionByName(long)


def near_words(words: DataFrame, longest: int = 64) -> DataFrame:
    """For each of words (rank, word) that has words at one inserted, deleted or replaced letter: rank, n_near, best (the
    least rank among these).

    Keys are sorted over all tasks by range; the rows of one key stand together, and a scan of the group tells each of its
    rows how many others there are and which is the least, so no pairs are made. A group holds a word for each letter that
    may stand at its place and one that has none there: never more than there are letters."""
    sorted_keys = rotations(words, longest).repartitionByRange("key")
    group = Window.partitionBy("key").orderBy("whole", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part, lead = ~F.col("whole"), F.col("first")
    seen = sorted_keys.select(
        "rank", "whole", "first",
        F.count(F.when(part, 1)).over(group).alias("parts"), F.count(F.when(lead, 1)).over(group).alias("leads"),
        F.first("rank").over(group).alias("least"), F.nth_value("rank", 2).over(group).alias("next"),
        F.min(F.when(lead, F.col("rank"))).over(group).alias("least_lead"), F.max(F.when(F.col("whole"), F.col("rank"))).over(group).alias("shorter"),
    )
    other = F.when(F.col("rank") != F.col("least"), F.col("least")).when(F.col("parts") > 1, F.col("next"))
    counted = F.when(F.col("whole"), F.col("leads")).otherwise(F.col("parts") - 1 + (lead & F.col("shorter").isNotNull()).cast("long"))
    best = F.when(F.col("whole"), F.col("least_lead")).otherwise(F.least(other, F.when(lead, F.col("shorter"))))
    return seen.select("rank", counted.alias("n"), best.alias("best")).where("n > 0").groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """For each row of forms (rank, up) the last rank that following `up` reaches, as rank, top. A form occurs at least
    `ratio` times as often as its variant, so paths are short, and each round doubles the steps."""
    paths = forms.select("rank", F.col("up").alias("top"))
    while True:
        further = paths.select(F.col("rank").alias("top"), F.col("top").alias("further"))
        paths = written(paths.join(further, "top", "left").select("rank", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved")), "paths")
        if not paths.where("moved").limit(1).count():
            return paths.select("rank", "top")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, slips: int = 97, ratio: int = 2, longest: int = 64) -> DataFrame:
    """Per word of docs (doc_id, text): word, form, root, n, n_near, form_n; words and n as in word_counts.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. form is the near word of
    largest n, of several the smallest in code-point order, if that n (form_n) is at least ratio * n (ratio > 1), else null. root is what
    following forms leads to, the word itself without a form. Repeated rows count each. A table without words gives no
    rows. Other columns are not read.

    1. Words are counted, sorted by n and code points, and numbered in that order, so rows of rotations carry a number.
    2. near_words. 3. Forms by number; roots by doubling steps."""
    counts = word_counts(docs, least_length, least_count, slips)
    words = written(counts.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "words")
    near = words.join(near_words(words, longest), "rank", "left")
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    kept = near.join(best, "best", "left").select("rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n")))
    kept = written(kept, "forms")
    tops = last_forms(kept.where("best is not null").select("rank", F.col("best").alias("up")))
    roots = tops.join(words.select(F.col("rank").alias("top"), F.col("word").alias("root")), "top").select("rank", "root")
    return kept.join(roots, "rank", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
