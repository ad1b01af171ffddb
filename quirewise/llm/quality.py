"""Quality classifier: supervised subword embeddings.

Features are hashed whitespace-delimited words and their character n-grams (with word boundaries); a text
is the average of its features' learned vectors, a softmax layer turns it into class probabilities, and
numpy stochastic gradient descent trains both. As the output layer is linear in the average, scoring
folds vectors and output into one number a feature and averages those over the whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_caches, mix64, small_batches

BUCKETS = 1 << 18
NGRAMS = (3, 4)
_SPACE = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)
_Q = [np.uint64(pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64)) for k in range(8)]
_STEP = np.uint64(0x94D049BB133111EB)
_PIECE = 1 << 18


def features(text: str) -> np.ndarray:
    """Bucket of every feature of a whole text, with repeats. Empty texts have none."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(points, _SPACE) if (points > 127).any() else (points == 32) | ((points >= 9) & (points <= 13))
    points = np.where(space, np.uint32(32), points)
    out, at = [], 0
    gaps = np.flatnonzero(space)
    while at < len(points) - 1:  # in pieces that end at spaces, so that a long text needs little memory
        to = gaps[min(len(gaps) - 1, max(np.searchsorted(gaps, at, "right"), np.searchsorted(gaps, at + _PIECE)))]
        out.append(_piece(points[at : to + 1].astype(np.uint64), space[at : to + 1]))
        at = int(to)
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _piece(p: np.ndarray, space: np.ndarray) -> np.ndarray:
    out = []
    for n in NGRAMS:
        if len(p) >= n:
            m = len(p) - n + 1
            h = np.full(m, np.uint64(n), np.uint64)
            inner = np.zeros(m, bool)
            for k in range(n):
                h += p[k : k + m] * _Q[k]
                if 0 < k < n - 1:
                    inner |= space[k : k + m]
            out.append(mix64(h[~inner]))
    cut = np.flatnonzero(space)
    full = np.diff(cut) > 1
    starts, ends = cut[:-1][full] + 1, cut[1:][full]
    if len(starts):
        # order-sensitive word hash: sum of mixed (point, place in word)
        place = np.arange(len(p), dtype=np.uint64)
        word = np.cumsum(space) - 1
        origin = np.where(word >= 0, cut[np.maximum(word, 0)], 0).astype(np.uint64)
        cells = mix64(p + (place - origin) * _STEP)
        total = np.concatenate([[np.uint64(0)], np.cumsum(cells)])
        out.append(mix64(total[ends] - total[starts]))
    return (np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int32) if out else np.empty(0, np.int32)


class Model:
    """One number a bucket and a bias: the margin of label 1 over label 0."""

    def __init__(self, margin: np.ndarray, bias: float):
        self.margin, self.bias = margin, bias

    def score(self, text: str) -> float:
        f = features(text)
        z = self.bias + (float(self.margin[f].mean(dtype=np.float64)) if len(f) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[str, int]], dim: int = 8, epochs: int = 5, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit vectors and softmax by stochastic gradient descent, a text a step; one class alone gives its certainty."""
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 6.0 if not rows or rows[0][1] else -6.0)
    rng = np.random.default_rng(seed)
    bags = []
    for text, y in rows:
        f, n = np.unique(features(text), return_counts=True)
        bags.append((f, (n / max(1, n.sum())).astype(np.float32), y))
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            f, w, y = bags[i]
            step = rate * (1 - done / steps)
            done += 1
            v = vectors[f]
            mean = w @ v
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            # the average's gradient reaches each feature by its share of the text, scaled to the text's size
            vectors[f] = v - step * np.outer(w * min(len(f), 64), out @ p)
            out -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200) -> Model:
    """Train on at most ``per_class`` labelled, not held-out texts of either class, chosen by a hash of the id."""
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id")))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.dropDuplicates(["doc_id", "quality"])
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).where(F.col("doc_id").isNotNull())
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality")
    # a repeated id could bring many rows: the bound holds for texts as well
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "quality").limit(2 * per_class).collect()
    return train([(r["text"], int(r["quality"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["quality"], r["text"]))])


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of ``docs``, from whole texts.

    Null and empty texts get the bias's score; a null id is not held out; repeated rows stay; an empty
    table gives no rows; other columns are ignored. The model's size is fixed, so it is broadcast.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.margin, model.bias))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        drop_caches()
        m = Model(*shared.value)
        return pd.Series([m.score(t or "") for t in texts])

    scored = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(held_out(docs["doc_id"]), F.lit(False)).alias("held_out"), score(docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their own columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.margin, model.bias))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        drop_caches()
        m = Model(*shared.value)
        return pd.Series([m.score(t or "") for t in texts])

    return docs.where(score(docs["text"]) >= threshold)
