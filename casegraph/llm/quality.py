"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column
from .shingles import shingle_sets
from .words import slices, split_words

#: Columns of the term vectors: for how a text is written, and for its words.
STYLE, WORDS = 1024, 1024
TERMS = STYLE + WORDS
_CLASS = np.full(256, 1, np.int64)  # letters, and bytes of characters beyond ASCII
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12]] = 4
_CLASS[[10, 13]] = 5
_marks = [b for b in range(256) if b < 128 and chr(b).isprintable() and not chr(b).isalnum() and b != 32]
_CLASS[_marks] = 6 + np.arange(len(_marks))
_CLASS[[b for b in range(32) if b not in (9, 10, 11, 12, 13)] + [127]] = 6 + len(_marks)
_N = 7 + len(_marks)
_PLACE = np.random.default_rng(3).integers(0, STYLE - 64, _N**3)


def term_vectors(texts) -> np.ndarray:
    """A row of TERMS numbers for each text of an Arrow string column: how it is written, and what it says.

    The first STYLE terms: three characters in a row, each seen as its kind (small, capital, digit, space, line end, or
    which mark), and in the last 64 which share of the words is new, how long words are and how many they are. Counts are
    square-rooted and rows have length 1 before those last terms are added. The WORDS terms behind: in how many of the
    text's distinct words (lower case, hashed) each stands."""
    data, offsets = binary_column(texts)
    starts, ends, before = split_words(data, offsets)
    sets, at = shingle_sets(texts, 1)
    distinct, words = np.diff(at), np.diff(before)
    out = np.zeros((len(offsets) - 1, TERMS), np.float32)
    kinds = _CLASS[data[int(offsets[0]) : int(offsets[-1])]]
    lo = int(offsets[0])
    place = (sets >> np.uint64(40)).astype(np.int64) % WORDS
    for i in range(len(out)):
        c = kinds[offsets[i] - lo : offsets[i + 1] - lo]
        if len(c) > 2:
            row = np.sqrt(np.bincount(_PLACE[(c[:-2] * _N + c[1:-1]) * _N + c[2:]], minlength=STYLE))
            out[i, :STYLE] = row / np.sqrt((row * row).sum())
        n = max(1, int(words[i]))
        mean = (ends[before[i] : before[i + 1]] - starts[before[i] : before[i + 1]]).mean() if words[i] else 0.0
        for base, value in ((0, 15.0 * distinct[i] / n), (20, min(19.0, mean)), (40, min(19.0, np.log2(n)))):
            whole = int(value)
            out[i, STYLE - 64 + base + whole] += 0.3 * (1 - (value - whole))
            out[i, STYLE - 64 + base + whole + 1] += 0.3 * (value - whole)
        out[i, STYLE:] = np.minimum(np.bincount(place[at[i] : at[i + 1]], minlength=WORDS), 60_000)
    return out


def _pieces(batches, rows: int = 1_000):
    """Record batches cut so that each holds at most 2 MB of text and `rows` rows, as a row makes TERMS numbers."""
    for batch in slices(batches, "text"):
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


class NeighbourVote:
    """Labelled vectors in a latent space, and the vote of the nearest by cosine."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, dims: int = 64, neighbours: int = 25, word_share: float = 0.35):
        """Words weigh by the logarithm of how few labelled texts have them; a text's words then have length word_share."""
        self.labels, self.neighbours, self.word_share = labels.astype(np.float32), neighbours, word_share
        n = len(terms)
        self.rarity = np.log((1.0 + n) / (1.0 + (terms[:, STYLE:] > 0).sum(axis=0))).astype(np.float32)
        weighed = self._weighed(terms)
        self.mean = weighed.mean(axis=0) if n else np.zeros(TERMS, np.float32)
        centred = (weighed - self.mean).astype(np.float64)
        # the first right singular vectors of the labelled rows, by subspace iteration from a fixed start
        axes = np.random.default_rng(41).standard_normal((TERMS, dims + 16))
        for _ in range(8):
            axes = np.linalg.qr(centred.T @ (centred @ axes))[0]
        _, turn = np.linalg.eigh((centred @ axes).T @ (centred @ axes))
        self.axes = (axes @ turn[:, ::-1][:, :dims]).astype(np.float32)
        self.known = self._latent(terms)

    def _weighed(self, terms: np.ndarray) -> np.ndarray:
        words = np.sqrt(terms[:, STYLE:]) * self.rarity
        words *= self.word_share / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-6)
        return np.concatenate([terms[:, :STYLE], words], axis=1)

    def _latent(self, terms: np.ndarray) -> np.ndarray:
        x = (self._weighed(terms) - self.mean) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, weighted by similarity; 0.5 without labels."""
        n = len(self.labels)
        if not n:
            return np.full(len(terms), 0.5)
        k = min(self.neighbours, n)
        out = np.empty(len(terms))
        for a in range(0, len(terms), 512):
            cosine = self._latent(terms[a : a + 512]) @ self.known.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0) + 1e-6
            out[a : a + 512] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4_096, dims: int = 64, neighbours: int = 25, word_share: float = 0.35) -> NeighbourVote:
    """A vote fitted on at most `sample` labelled rows: half of each label where there are enough, those of least hash.

    labels has doc_id and quality (0 or 1; others and nulls are left out); of several labels of one doc_id 0 counts. Of
    several rows of docs with one doc_id the least text counts, so no more than `sample` term vectors of TERMS numbers
    come to the driver; only their ids are sent to the scan of docs."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    order = F.xxhash64("doc_id", F.lit(23))
    chosen = known.where("quality = 0").orderBy(order, "doc_id").limit(sample // 2).unionByName(known.where("quality = 1").orderBy(order, "doc_id").limit(sample // 2))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def terms(batches):
        import pyarrow as pa

        for batch in _pieces(batches):
            x = term_vectors(batch.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(terms, f"doc_id {kind}, quality int, terms binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(found.column("terms").to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    return NeighbourVote(x, found.column("quality").to_numpy(), dims, neighbours, word_share)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0, **parameters) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (0 or 1).

    The vote is fitted on labelled rows whose crc32(doc_id as text) modulo folds is not held_out, and broadcast: at
    most `sample` vectors. Every document is compared with all of them in blocks of exact cosine products. A score
    takes nothing but the text. Null and empty texts count as empty and get a score; a null doc_id is not held out.
    Equal texts get equal scores. Without labels every score is 0.5. Columns other than doc_id and text are not read.
    """
    fold = lambda c: F.crc32(F.col(c).cast("string")) % folds == held_out
    vote = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(~fold("doc_id")), **parameters))

    def score(batches):
        import pyarrow as pa

        for batch in _pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(vote.value.scores(term_vectors(batch.column("text"))), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0, **parameters) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least threshold; fitted as in quality_scores."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds == held_out
    vote = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(~fold), **parameters))
    at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        for batch in _pieces(batches):
            yield batch.filter(pa.array(vote.value.scores(term_vectors(batch.column(at))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
