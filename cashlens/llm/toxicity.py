"""Toxicity by a classifier chain: categories in a fixed order, later linear models see earlier probabilities.

Categories come from the labels: toxic text of low quality, toxic text of good quality, toxic text of any kind (the
verdict). A later model's training features are the *out-of-fold* probabilities of the earlier ones, so it learns how
far these can be trusted on unseen rows; when predicting, the models fitted on all rows feed it.

A text's features are the presence of words and word beginnings (4 and 5 letters, for families of derived words)
among those chosen from the training rows; long texts are not diluted. Fitting uses a bounded sample: at most
``max_toxic`` toxic and ``max_clean`` other labelled rows, smallest key hash first; counting the features of their
whole texts is a Spark aggregation, and at most ``max_features`` of them come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from cashlens.llm.common import held_out, memo, per_batch, stage, with_scores

CATEGORIES = ("toxic_junk", "toxic_prose", "toxic")
WORDS = regex.compile(r"[\p{L}\p{M}]+").findall


def word_features(word: str) -> list[str]:
    """The whole word and, for longer words, its beginnings; a mark tells them apart."""
    return [word + "."] + [word[:k] for k in (4, 5) if len(word) > k]


def text_features(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(WORDS(text.lower())):
        out.update(word_features(w))
    return out


class Presence:
    """Chosen features of a text; remembers the blank-separated chunks that hold none of them."""

    def __init__(self, chosen: dict[str, int], room: int = 300_000):
        self.chosen, self.room, self.plain, self.known = chosen, room, set(), {}

    def of(self, text: str) -> list[int]:
        found: set[int] = set()
        for chunk in set(text.lower().split()).difference(self.plain):
            hit = self.known.get(chunk)
            if hit is None:
                hit = [self.chosen[f] for w in WORDS(chunk) for f in word_features(w) if f in self.chosen]
                if len(self.plain) + len(self.known) > self.room:
                    self.plain, self.known = set(), {}
                if not hit:
                    self.plain.add(chunk)
                    continue
                self.known[chunk] = hit
            found.update(hit)
        return sorted(found)


class Sparse:
    """Rows of feature numbers with value 1, plus a few dense columns."""

    def __init__(self, rows: list, width: int, dense: np.ndarray):
        self.col = np.fromiter((c for r in rows for c in r), np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.width, self.dense = len(rows), width, dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.dense @ w[self.width:]

    def tdot(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, v[self.row], self.width), self.dense.T @ v])


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_linear(x: Sparse, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 250) -> np.ndarray:
    """Weights and bias (last) of an L2-regularised logistic regression by accelerated gradient steps."""
    if y.min() == y.max():                                             # a category without examples of both kinds
        w = np.zeros(x.width + x.dense.shape[1] + 1)
        w[-1] = logit(float(y[0]) if len(y) else 0.0)
        return w
    size = 1 + np.bincount(x.row, minlength=x.n) + (x.dense ** 2).sum(1)
    lip = 0.25 * np.sum(weight * size) + ridge                         # a safe bound on the curvature, then adapted
    w = np.zeros(x.width + x.dense.shape[1] + 1)
    v, t, lip = w.copy(), 1.0, max(lip / 64, ridge)

    def loss(u):
        z = x.dot(u[:-1]) + u[-1]
        return np.sum(weight * (np.logaddexp(0, z) - y * z)) + ridge / 2 * np.sum(u[:-1] ** 2), z
    for _ in range(steps):
        fv, z = loss(v)
        r = weight * (sigmoid(z) - y)
        g = np.append(x.tdot(r) + ridge * v[:-1], r.sum())
        while True:
            new = v - g / lip
            if loss(new)[0] <= fv - (g @ g) / (2 * lip) + 1e-9:
                break
            lip *= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        lip *= 0.95
    return w


def fit_chain(rows: list, width: int, y: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> tuple[list, np.ndarray]:
    """Models of the chain in order, and the out-of-fold probabilities of every category."""
    n, models = len(rows), []
    oof = np.zeros((n, y.shape[1]))
    for k in range(y.shape[1]):
        dense = logit(oof[:, :k]) / 4
        for f in np.unique(fold):
            tr, te = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part = tr if len(tr) else te
            w = fit_linear(Sparse([rows[i] for i in part], width, dense[part]), y[part, k], weight[part])
            oof[te, k] = sigmoid(Sparse([rows[i] for i in te], width, dense[te]).dot(w[:-1]) + w[-1])
        models.append(fit_linear(Sparse(rows, width, dense), y[:, k], weight))
    return models, oof


def predict_chain(rows: list, width: int, models: list) -> np.ndarray:
    out = np.zeros((len(rows), len(models)))
    for k, w in enumerate(models):
        out[:, k] = sigmoid(Sparse(rows, width, logit(out[:, :k]) / 4).dot(w[:-1]) + w[-1])
    return out


def threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray, most_false: float) -> float:
    """Lowest cut on out-of-fold probabilities (0.5 at least) that rejects at most this share of clean rows."""
    clean, w = p[y == 0], weight[y == 0]
    order = np.argsort(-clean)
    over = np.cumsum(w[order]) / max(w.sum(), 1e-12) > most_false
    return float(max(0.5, clean[order][over][0] + 1e-6 if over.any() else 0.5))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_features: int, most_false: float, least_z: float,
        folds: int = 5) -> dict | None:
    keys = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"),
                          F.col("quality").cast("int").alias("quality"))
            .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), 4))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality")))
    totals = {r["toxic"]: r["count"] for r in keys.groupBy("toxic").count().collect()}      # two rows
    if len(totals) < 2:
        return None
    some = [keys.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(m)
            for v, m in ((1, max_toxic), (0, max_clean))]
    sample = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .join(F.broadcast(some[0].union(some[1])), "doc_id"), "toxicity-sample")

    def spell(batch: pa.RecordBatch):
        feats = [sorted(text_features(t or "")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(feats, pa.list_(pa.string()))], names=["toxic", "f"])

    counts = (per_batch(sample, ["toxic", "text"], spell, "toxic int, f array<string>").select("toxic", F.explode("f").alias("f"))
              .groupBy("f").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")))
    size = sample.agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).first()
    np_, nn = int(size["a"] or 0), int(size["n"]) - int(size["a"] or 0)
    if not np_ or not nn:
        return None
    pos, neg = F.col("a") / np_, (F.col("n") - F.col("a")) / nn
    z = (pos - neg) / F.sqrt(pos / np_ + neg / nn + F.lit(1) / (np_ * nn))
    chosen = [r["f"] for r in counts.withColumn("z", z).where((F.col("z") >= least_z) & (pos > 2 * neg))
              .orderBy(F.desc("z"), "f").limit(max_features).collect()]
    number = {f: i for i, f in enumerate(chosen)}

    def numbered(batch: pa.RecordBatch):
        p = Presence(number)
        rows = [p.of(t or "") for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.int32()))],
                                         names=["doc_id", "toxic", "quality", "f"])

    got = sorted(per_batch(sample, ["doc_id", "toxic", "quality", "text"], numbered,
                           "doc_id bigint, toxic int, quality int, f array<int>").collect(), key=lambda r: (r["doc_id"], r["f"]))
    rows, t = [r["f"] for r in got], np.array([r["toxic"] for r in got], float)
    junk = np.array([r["quality"] == 0 for r in got], float)
    weight = np.where(t == 1, totals[1] / max(t.sum(), 1), totals[0] / max((1 - t).sum(), 1))
    weight = weight / weight.mean()
    fold = np.array([(r["doc_id"] * 2654435761 >> 7) % folds for r in got])
    y = np.stack([t * junk, t * (1 - junk), t], 1)
    models, oof = fit_chain(rows, len(number), y, fold, weight)
    return {"number": number, "models": models, "cut": threshold(oof[:, -1], t, weight, most_false)}


def score(docs: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_clean: int = 8000, max_features: int = 4096,
          most_false: float = 0.002, least_z: float = 1.7,
          prefix: str = "", carry: bool = False) -> DataFrame:
    """Every document's chances: doc_id (or all columns of ``docs``), toxic_junk, toxic_prose, toxic (0 to 1), predicted (1: reject).

    ``most_false`` is the share of clean training rows that the cut may reject out of fold; ``least_z`` the least
    standardised difference between toxic and clean rows that a feature must show. Null and empty texts have no
    feature and get the base chance; without labels of both kinds every chance is 0. Null keys stay, repeated rows
    score alike, other columns are ignored.
    """
    model = fit(docs, labels, max_toxic, max_clean, max_features, most_false, least_z)
    shared = docs.sparkSession.sparkContext.broadcast(model)           # bounded by max_features

    def run(texts: list[str]):
        m, p, cut = shared.value, np.zeros((len(texts), 3)), 2.0
        if m is not None:
            presence = memo("presence", lambda: Presence(m["number"]))
            p, cut = predict_chain([presence.of(t) for t in texts], len(m["number"]), m["models"]), m["cut"]
        return [*(np.ascontiguousarray(p[:, k]) for k in range(3)), (p[:, 2] >= cut).astype(np.int32)]

    names = [prefix + c for c in (*CATEGORIES, "predicted")]
    return with_scores(docs, run, names, ", ".join(f"{n} {t}" for n, t in zip(names, ("double", "double", "double", "int"))), carry)
