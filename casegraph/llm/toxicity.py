"""Toxicity scores by a bidirectional gated recurrent network with attention pooling over overlapping windows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, mix
from .shingles import word_hashes
from .words import lower_ascii, row_ranges, slices, split_words

#: Words of a window, and how far the next one starts behind it: every word but a text's first and last few is in two.
WINDOW, STRIDE = 32, 16
#: Units of each direction, components of a word's own vector and of that of its characters.
UNITS, OWN, CHARS = 12, 8, 8
#: Rows of the table of character sequences, which are of 3, 4 and 5 bytes.
GRAMS = 1 << 15
_GRAM_SIZES = (3, 4, 5)


def distinct_words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words of an Arrow string column, rows of GRAMS of their characters, n + 1 offsets of these,
    the number of each word in order, words before each row). A-Z are lower-cased."""
    data, offsets = binary_column(texts)
    starts, ends, before = split_words(data, offsets)
    hashes, first, number = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    grams, at = character_grams(data, starts[first], ends[first])
    return hashes, grams, at, number.astype(np.int64), before


def character_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of GRAMS, n + 1 offsets): the sequences of 3, 4 and 5 bytes of each word between two marks for its ends."""
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    total = int(at[-1])
    text = np.full(total, 2, np.uint64)  # the marks; in texts this byte is but a control character
    inside = np.ones(total, bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    text[inside] = lower_ascii(data[np.repeat(starts - at[:-1] - 1, sizes)[inside] + np.flatnonzero(inside)])
    rows, owner = [], []
    left = np.repeat(at[1:], sizes) - np.arange(total)  # bytes up to the end of the word
    word = np.repeat(np.arange(len(starts)), sizes)
    for n in _GRAM_SIZES:
        whole = np.flatnonzero(left >= n)
        code = np.full(len(whole), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + text[whole + k]
        rows.append((mix(code) >> np.uint64(40)).astype(np.int64) % GRAMS)
        owner.append(word[whole])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.searchsorted(owner[order], np.arange(len(starts) + 1))


def windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, row) of the windows of texts with word numbers before[i] to before[i + 1]: all words are in one."""
    n = np.diff(before)
    many = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(n)), many)
    start = (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return before[:-1][row] + start, np.minimum(WINDOW, n[row] - start), row


def taken_rows(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the ragged rows `which`."""
    sizes = np.diff(offsets)[which]
    at = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(int(at[-1])) + np.repeat(offsets[:-1][which] - at[:-1], sizes)], at


def sum_rows(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows."""
    sums = np.zeros((len(offsets) - 1, values.shape[1]), values.dtype)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        sums[some] = np.add.reduceat(values, offsets[some], axis=0)
    return sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """The weights. Words without a vector of their own have the last row of `own`."""

    known: np.ndarray  #: hashes of the words that have a vector of their own, sorted
    own: np.ndarray
    grams: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, known: np.ndarray, seed: int = 12) -> Network:
        r = np.random.default_rng(seed)
        n = OWN + CHARS
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        weights = {}
        for way in ("f", "b"):
            weights |= {f"in_{way}": draw(n, 3 * UNITS), f"on_{way}": draw(UNITS, 3 * UNITS), f"bias_{way}": np.zeros(3 * UNITS, np.float32)}
        weights |= {"look": np.zeros(2 * UNITS, np.float32), "out": draw(2 * UNITS, 1)[:, 0], "bias": np.full(1, -1, np.float32)}
        return cls(known, 0.05 * draw(len(known) + 1, OWN), 0.05 * draw(GRAMS, CHARS), weights)

    def own_rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of `own` for each word."""
        at = np.searchsorted(self.known, hashes)
        found = at < len(self.known)
        found[found] = self.known[at[found]] == hashes[found]
        return np.where(found, at, len(self.known))

    def inputs(self, own_rows: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The input vector of each word: its own vector, and the sum of those of its character sequences by the root of how many."""
        chars = np.concatenate([sum_rows(self.grams[grams[at[a] : at[b]]], at[a : b + 1] - at[a]) for a, b in row_ranges(np.diff(at), 1 << 17)] or [np.zeros((0, CHARS), np.float32)])
        return np.concatenate([self.own[own_rows], chars / np.sqrt(np.maximum(np.diff(at), 1))[:, None].astype(np.float32)], axis=1)

    def forward(self, words: np.ndarray, sizes: np.ndarray, inputs: np.ndarray, keep: bool = False):
        """Logits of windows: words is a row of WINDOW word numbers each, of which the first `sizes` count. With keep, all
        that the way back needs as well. Arrays hold a column for each window."""
        w, count, length = self.weights, len(words), words.shape[1]
        states = np.empty((2, length, UNITS, count), np.float32)
        turned = np.ascontiguousarray(words.T)
        rows, x = np.empty((count, 3 * UNITS), np.float32), np.empty((3 * UNITS, count), np.float32)
        u, gates, new = np.empty_like(x), np.empty((2 * UNITS, count), np.float32), np.empty((UNITS, count), np.float32)
        # gates are logistic: half the hyperbolic tangent of the half, and a half
        half = np.repeat(np.float32([0.5, 1]), [2 * UNITS, UNITS])
        kept = []
        for d, way in enumerate("fb"):
            table = (inputs @ w[f"in_{way}"] + w[f"bias_{way}"]) * half
            on = np.ascontiguousarray((w[f"on_{way}"] * half).T)
            h = np.zeros((UNITS, count), np.float32)
            steps: list = [None] * length
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                np.take(table, turned[t], axis=0, out=rows, mode="clip")
                x[:] = rows.T
                np.matmul(on, h, out=u)
                np.add(x[: 2 * UNITS], u[: 2 * UNITS], out=gates)
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                z, r = gates[:UNITS], gates[UNITS:]
                np.multiply(r, u[2 * UNITS :], out=new)
                new += x[2 * UNITS :]
                np.tanh(new, out=new)
                after = states[d, t]
                np.subtract(h, new, out=after)
                after *= z
                after += new
                if d == 1:
                    after *= t < sizes
                if keep:
                    steps[t] = (h, z.copy(), r.copy(), new.copy(), u[2 * UNITS :].copy())
                h = after
            kept.append(steps)
        look = w["look"][:UNITS] @ states[0] + w["look"][UNITS:] @ states[1]
        look[np.arange(length)[:, None] >= sizes] = -1e9
        look = np.exp(look - look.max(axis=0))
        look /= look.sum(axis=0)
        pooled = np.concatenate([sum(look[t] * states[d, t] for t in range(length)) for d in (0, 1)])
        logits = w["out"] @ pooled + w["bias"][0]
        return (logits, states, look, pooled, kept) if keep else logits

    def backward(self, words: np.ndarray, sizes: np.ndarray, inputs: np.ndarray, kept, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of the weights, of inputs) for the slope of the loss at each logit."""
        w, (_, states, look, pooled, steps) = self.weights, kept
        length, count = words.shape[1], len(words)
        g = {"out": pooled @ slope, "bias": np.array([slope.sum()], np.float32)}
        at_inputs = np.zeros_like(inputs)
        d_pooled = w["out"][:, None] * slope
        d_look = sum((d_pooled[d * UNITS : (d + 1) * UNITS] * states[d]).sum(axis=1) for d in (0, 1))
        d_look = look * (d_look - (look * d_look).sum(axis=0))
        g["look"] = np.concatenate([np.einsum("tn,tun->u", d_look, states[d]) for d in (0, 1)])
        for d, way in enumerate("fb"):
            part = slice(d * UNITS, (d + 1) * UNITS)
            on = np.zeros((UNITS, 3 * UNITS), np.float32)
            at_words = np.empty((length, count, 3 * UNITS), np.float32)
            back = np.zeros((UNITS, count), np.float32)
            for t in range(length - 1, -1, -1) if d == 0 else range(length):
                h, z, r, new, u = steps[d][t]
                back = back + look[t] * d_pooled[part] + d_look[t] * w["look"][part][:, None]
                if d == 1:
                    back = back * (t < sizes)
                d_new = back * (1 - z) * (1 - new * new)
                d_z = back * (h - new) * z * (1 - z)
                d_r = d_new * u * r * (1 - r)
                at_words[t] = np.concatenate([d_z, d_r, d_new]).T
                at_u = np.concatenate([d_z, d_r, d_new * r])
                on += h @ at_u.T
                back = back * z + w[f"on_{way}"] @ at_u
            table = scattered(words.T.ravel(), at_words.reshape(-1, 3 * UNITS), len(inputs))
            g[f"on_{way}"], g[f"bias_{way}"], g[f"in_{way}"] = on, table.sum(axis=0), inputs.T @ table
            at_inputs += table @ w[f"in_{way}"].T
        return g, at_inputs


def scattered(rows: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    """A table of `many` rows with the values of each row summed."""
    order = np.argsort(rows, kind="stable")
    return sum_rows(values[order], np.searchsorted(rows[order], np.arange(many + 1)))


class _Adam:
    """Steps of Adam for the arrays of a dict; of a table only the rows that a step touches."""

    def __init__(self, rate: float):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def step(self, arrays: dict[str, np.ndarray], slopes: dict[str, tuple]) -> None:
        self.n += 1
        for k, (rows, slope) in slopes.items():
            m, v = (x.setdefault(k, np.zeros_like(arrays[k])) for x in (self.m, self.v))
            m[rows] = 0.9 * m[rows] + 0.1 * slope
            v[rows] = 0.99 * v[rows] + 0.01 * slope * slope
            arrays[k][rows] -= self.rate * (m[rows] / (1 - 0.9**self.n)) / (np.sqrt(v[rows] / (1 - 0.99**self.n)) + 1e-6)


def _index(first: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A row of WINDOW word numbers for each window; behind its end the last word is repeated."""
    return number[first[:, None] + np.minimum(np.arange(WINDOW), sizes[:, None] - 1)]


def train(texts, labels: np.ndarray, epochs: int = 14, ranked_at: tuple[int, ...] = (1, 2, 4, 7, 11), batch: int = 96, seed: int = 5) -> Network:
    """A network for texts (an Arrow string column) with labels 0 and 1, as long as there are both.

    A text's label is that of its worst window, so all windows of all texts are scored before the epochs ranked_at, and an
    epoch learns from the worst of each text, and for label 0 from the second and one of chance as well; at first, windows are ranked by the log-odds of their words and character
    sequences, which also start the first component of both tables. Texts of which another sample text is a near copy (equal least
    shingle of words) share one weight, else a large group of copies would be learned by heart."""
    hashes, grams, at, number, before = distinct_words(texts)
    first, sizes, row = windows(before)
    words = np.unique(np.repeat(np.arange(len(before) - 1), np.diff(before)) * np.int64(len(hashes)) + number)
    words = np.stack([words // len(hashes), words % len(hashes)])
    in_texts = np.bincount(words[1], minlength=len(hashes))
    net = Network.start(hashes[in_texts > 1])
    own = net.own_rows(hashes)
    weight = _copy_weights(hashes, number, before)
    weight = weight * np.where(labels == 1, 1 / max(1e-9, weight[labels == 1].sum()), 1 / max(1e-9, weight[labels == 0].sum()))
    weight = (weight / weight.mean()).astype(np.float32)

    def odds(counts: np.ndarray) -> np.ndarray:
        return np.clip(np.log((counts[1] + 1.0) / (counts[0] + 1.0)), -4, 4).astype(np.float32)

    def counted(texts_of: np.ndarray, feature: np.ndarray, many: int) -> np.ndarray:
        return np.stack([np.bincount(feature, weights=(labels[texts_of] == k) * weight[texts_of], minlength=many) for k in (0, 1)])

    word_odds, gram_counts = odds(counted(words[0], words[1], len(hashes))), np.zeros((2, GRAMS))
    for a, b in row_ranges(np.bincount(words[0], weights=np.diff(at)[words[1]], minlength=len(labels)).astype(np.int64), 1 << 19):
        some = slice(*np.searchsorted(words[0], [a, b]))
        held, held_at = taken_rows(grams, at, words[1][some])
        pairs = np.unique(np.repeat(words[0][some], np.diff(held_at)) * np.int64(GRAMS) + held)
        gram_counts += counted(pairs // GRAMS, pairs % GRAMS, GRAMS)
    gram_odds = odds(gram_counts)
    net.own[own[own < len(net.known)], 0] = 0.5 * word_odds[own < len(net.known)]
    net.grams[:, 0] = 0.5 * gram_odds
    strongest = np.full(len(hashes), -9.0, np.float32)
    some = np.flatnonzero(np.diff(at))
    strongest[some] = np.maximum.reduceat(gram_odds[grams], at[some])
    rank = np.maximum(np.where(own < len(net.known), word_odds, -9.0), strongest)[_index(first, sizes, number)].max(axis=1) if len(first) else np.zeros(0)
    r = np.random.default_rng(seed)
    adam, tables = _Adam(0.01), _Adam(0.01)
    for epoch in range(epochs):
        if epoch in ranked_at:
            rank = _logits(net, first, sizes, number, net.inputs(own, grams, at))
        order = np.lexsort((-rank, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        chosen = np.concatenate([order[place < 1], order[(place == 1) & (labels[row[order]] == 0)]])
        chance = r.integers(0, len(first), len(order[place < 1]))
        chosen = np.concatenate([chosen, chance[labels[row[chance]] == 0]])
        chosen = chosen[r.permutation(len(chosen))]
        for a in range(0, len(chosen), batch):
            c = chosen[a : a + batch]
            used, index = np.unique(_index(first[c], sizes[c], number), return_inverse=True)
            index = index.reshape(len(c), WINDOW)
            sub_grams, sub = taken_rows(grams, at, used)
            x = net.inputs(own[used], sub_grams, sub)
            # some words are not seen as themselves, so that characters are learned too
            unseen = r.random(len(used)) < 0.3
            x[unseen, :OWN] = net.own[-1]
            kept = net.forward(index, sizes[c], x, keep=True)
            slope = (weight[row[c]] * (_sigmoid(kept[0]) - (0.02 + 0.96 * labels[row[c]])) / len(c)).astype(np.float32)
            g, at_x = net.backward(index, sizes[c], x, kept, slope)
            adam.step(net.weights, {k: (slice(None), v) for k, v in g.items()})
            seen, own_index = np.unique(np.where(unseen, len(net.known), own[used]), return_inverse=True)
            gram_rows, gram_index = np.unique(sub_grams, return_inverse=True)
            at_grams = np.repeat(at_x[:, OWN:] / np.sqrt(np.maximum(np.diff(sub), 1))[:, None].astype(np.float32), np.diff(sub), axis=0)
            tables.step({"own": net.own, "grams": net.grams}, {"own": (seen, scattered(own_index, at_x[:, :OWN], len(seen))), "grams": (gram_rows, scattered(gram_index, at_grams, len(gram_rows)))})
    return net


def _copy_weights(hashes: np.ndarray, number: np.ndarray, before: np.ndarray) -> np.ndarray:
    """1 by how many texts share the least hash of three words in a row."""
    word = hashes[number]
    least = np.zeros(len(before) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(before[:-1], before[1:], strict=True)):
        own = word[a:b]
        least[i] = mix(own[:-2] + own[1:-1] * np.uint64(3) + own[2:] * np.uint64(5)).min() if len(own) > 2 else (own.min() if len(own) else 0)
    _, group, size = np.unique(least, return_inverse=True, return_counts=True)
    return 1.0 / size[group]


def _logits(net: Network, first: np.ndarray, sizes: np.ndarray, number: np.ndarray, inputs: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """Logits of all windows."""
    out = np.zeros(len(first), np.float32)
    for a in range(0, len(first), at_once):
        part = slice(a, a + at_once)
        out[part] = net.forward(_index(first[part], sizes[part], number), sizes[part], inputs)
    return out


def worst_windows(net: Network, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, first word, words) of the worst of all windows of each text; 0, 0 and 0 for a text without words."""
    hashes, grams, at, number, before = distinct_words(texts)
    first, sizes, row = windows(before)
    logits = _logits(net, first, sizes, number, net.inputs(net.own_rows(hashes), grams, at))
    score, where, size = np.zeros(len(before) - 1), np.zeros(len(before) - 1, np.int64), np.zeros(len(before) - 1, np.int64)
    if len(first):
        order = np.lexsort((first, -logits, row))
        top = order[np.searchsorted(row[order], np.unique(row))]
        score[row[top]] = np.round(_sigmoid(logits[top].astype(np.float64)), 5)
        where[row[top]], size[row[top]] = first[top] - before[row[top]], sizes[top]
    return score, where, size


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2_048, text_bytes: int = 1 << 16, **training) -> Network | None:
    """A network fitted on at most `sample` labelled rows: half of each label where there are enough, those of least hash;
    None without both labels.

    labels has doc_id and toxic (0 or 1; others and nulls are left out); of several labels of one doc_id 1 counts. Of
    several rows of docs with one doc_id the least text counts. Only ids are sent to the scan of docs. Training runs on
    the driver, on whole texts: those of more than text_bytes bytes are left out, so it holds sample * text_bytes at most."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(29))
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample // 2).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(sample // 2))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= text_bytes).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = rows.toArrow().sort_by("doc_id")
    y = found.column("toxic").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    return train(found.column("text"), y.astype(np.float32), **training)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, held_out: int = 0, **parameters) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (0 or 1), and
    the worst window as first_word (from 0) and n_words.

    The network is fitted on labelled rows whose crc32(doc_id as text) modulo folds is not held_out, and broadcast (its
    size does not depend on the tables). Words are runs without space, \\t, \\n, \\v, \\f, \\r. A text's score is that of
    the worst of all its windows of WINDOW words, which start STRIDE words apart; a score takes nothing but the text.
    Null and empty texts, and all texts where the labels lack 0 or 1, have score 0. A null doc_id is not held out. Equal
    texts get equal scores to within 0.00001. Columns other than doc_id and text are not read.
    """
    fold = lambda c: F.crc32(F.col(c).cast("string")) % folds == held_out
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(~fold("doc_id")), **parameters))

    def score(batches):
        import pyarrow as pa

        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text")
            worst = worst_windows(net.value, texts) if net.value is not None else (np.zeros(len(batch)), *np.zeros((2, len(batch)), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in worst)], ["doc_id", "score", "first_word", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, first_word long, n_words long")
    return out.select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "first_word", "n_words")
