"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are the pairs of adjacent character classes of the whole text (64 classes, so 4,096 terms), and how
often words and lines come again. Square roots of term shares, weighted by inverse document frequency and projected on
the leading singular vectors of the labelled texts, make its latent vector. The labelled vectors are a sample of at
most ``per_class`` rows of each label, so what is broadcast has a fixed bound: 2 x per_class x dims numbers and the
4,104 x dims projection. Every document meets all of them in blocks of exact cosines; the ``k`` nearest vote, weighted
by similarity and by the share of keys that a class has among all labelled ones that aren't held out. One narrow pass, no shuffle of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cashlens.llm.common import held_out, per_batch, with_scores

CLASSES, EXTRA = 64, 8
TERMS = CLASSES * CLASSES + EXTRA


def _classes() -> np.ndarray:
    """Class of each byte: a small letter, any capital, digit, blank, line end, single symbols, bytes above 127."""
    lut = np.full(256, 63, np.int32)
    for i in range(26):
        lut[97 + i], lut[65 + i] = 1 + i, 27
    lut[48:58], lut[32], lut[10] = 28, 29, 30
    for i, c in enumerate(b".,;:!?'\"#*$%&|<>()[]{}/\\-_=+@"):
        lut[c] = 31 + i
    lut[128:192], lut[192:] = 61, 62
    return lut


LUT = _classes()


def term_shares(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of every term, a row for each whole text; zeros for an empty text."""
    raw = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.zeros((len(raw), TERMS), np.float32)
    c = LUT[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw)), sizes)
    if len(c) > 1:
        same = doc[1:] == doc[:-1]
        code = (doc[1:] * (CLASSES * CLASSES) + c[:-1] * CLASSES + c[1:])[same]
        n = np.bincount(code, minlength=len(raw) * CLASSES * CLASSES).reshape(len(raw), -1)
        out[:, :-EXTRA] = np.sqrt(n / np.maximum(sizes - 1, 1)[:, None])
    for i, t in enumerate(texts):
        words, lines = t.split(), [x for x in t.split("\n") if x.strip()]
        if words:
            again = 1 - len(set(lines)) / len(lines)
            repeat = 1 - len(set(words)) / len(words)
            out[i, -EXTRA:-EXTRA + 4] = (again ** .5, (again > .2) * .5, max(0, repeat - .5) ** .5, (len(words) < 20) * .2)
    return out


def latent(texts: list[str], model: dict) -> np.ndarray:
    """Unit latent vectors (zero rows for texts without a term)."""
    v = (term_shares(texts) * model["idf"]) @ model["axes"]
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def labelled_keys(labels: DataFrame, label: Column, folds: int = 4) -> DataFrame:
    """The rows that may be learnt from: each key that isn't held out once, with its label (0, 1): doc_id, y."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("y"))
            .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), folds))
            .groupBy("doc_id").agg(F.max("y").alias("y")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, per_class: int, folds: int = 4) -> DataFrame:
    """At most ``per_class`` rows of each label (0, 1), those with the smallest hash of the key: doc_id, text, y."""
    keys = labelled_keys(labels, label, folds)
    some = [keys.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    picked = F.broadcast(some[0].union(some[1]))                       # 2 x per_class small rows at most
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, dims: int = 48, seed: int = 7) -> dict | None:
    """The model: idf, axes, labelled vectors, their labels and class weights. None where a class has no row."""
    def features(batch: pa.RecordBatch):
        rows = term_shares([t or "" for t in batch.column(1).to_pylist()]).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())],
                                         names=["doc_id", "y", "f"])

    sample = labelled_sample(docs, labels, F.col("quality"), per_class)
    got = per_batch(sample, ["doc_id", "text", "y"], features, "doc_id bigint, y int, f binary").toArrow()
    order = np.lexsort((np.asarray(got["f"].to_pylist(), object), got["doc_id"].to_numpy()))
    y = got["y"].to_numpy()[order].astype(np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x = np.frombuffer(b"".join(got["f"].to_pylist()), np.float16).reshape(len(y), TERMS)[order].astype(np.float32)
    share = {r["y"]: r["n"] for r in labelled_keys(labels, F.col("quality")).groupBy("y")
             .agg(F.count(F.lit(1)).alias("n")).collect()}             # two rows
    idf = np.log((1 + len(y)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(1)
    x *= idf
    # randomised range finder: power steps on a fixed random start, then the exact small decomposition
    q = np.linalg.qr(x.T @ (x @ np.random.default_rng(seed).standard_normal((TERMS, dims + 16), np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ v[:dims].T).astype(np.float32)
    z = x @ axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    weight = np.array([share[c] / max(1, (y == c).sum()) for c in (0, 1)], np.float32)
    return {"idf": idf, "axes": axes, "vectors": z.astype(np.float32), "y": y, "weight": weight / weight.sum()}


def vote(z: np.ndarray, model: dict, k: int, power: float) -> np.ndarray:
    """Share of label 1 among the k nearest labelled vectors, weighted by similarity and class weight."""
    k = min(k, len(model["y"]))
    sim = z @ model["vectors"].T
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    s = np.maximum(np.take_along_axis(sim, near, 1), 1e-6).astype(np.float64) ** power
    y = model["y"][near]
    s *= np.where(y > 0, model["weight"][1], model["weight"][0])
    return (s * y).sum(1) / s.sum(1)


def score(docs: DataFrame, labels: DataFrame, per_class: int = 1500, dims: int = 48, k: int = 15, power: float = 8.0,
          block: int = 256, name: str = "score", carry: bool = False) -> DataFrame:
    """Every document's chance of label 1: doc_id, score (or all columns of ``docs`` and the score under ``name``).

    Learns from labelled rows whose key is not held out. A null or empty text has the zero vector, whose similarity to
    all is equal, and gets the share of label 1 among labelled rows. If labels hold one class or none, every score is
    0.5. Null keys stay; repeated rows score alike; other columns are ignored.
    """
    model = fit(docs, labels, per_class, dims)
    shared = docs.sparkSession.sparkContext.broadcast(model)           # bounded by per_class x dims

    def run(texts: list[str]):
        m, out = shared.value, np.full(len(texts), 0.5)
        if m is not None:
            prior = float(m["weight"][1] * (m["y"] == 1).sum() / sum(m["weight"][c] * (m["y"] == c).sum() for c in (0, 1)))
            for lo in range(0, len(texts), block):
                z = latent(texts[lo:lo + block], m)
                got = vote(z, m, k, power)
                out[lo:lo + len(got)] = np.where(np.abs(z).sum(1) > 0, got, prior)
        return [out]

    return with_scores(docs, run, [name], f"{name} double", carry)
