"""Bootstrap of average precision: every replicate is one more number beside a row, never one more row."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cashlens.functions.ranking import BUCKET_ROWS, bucketed
from cashlens.sources.staging import write_once

# P(N <= k) of a Poisson(1) draw
POISSON_CDF = np.array([0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759])
SLICE = 2048                              # rows whose weights exist at a time
PARTS = "part string, b long, score double, n array<long>, pos array<long>"


def weights(keys: np.ndarray, n_boot: int) -> np.ndarray:
    """Poisson(1) weights, rows x replicates, drawn by a mixing function of the row's key and the replicate."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] + np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(POISSON_CDF, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53))


def totals(keys, y, n_boot):
    """Weighted rows and weighted positives of every replicate."""
    n = pos = np.zeros(n_boot, np.int64)
    for i in range(0, len(keys), SLICE):
        w = weights(keys[i:i + SLICE], n_boot)
        n, pos = n + w.sum(axis=0), pos + y[i:i + SLICE] @ w
    return n, pos


def _columns(g: pa.Table):
    order = np.argsort(-g["s"].to_numpy(), kind="stable")
    return tuple(g[c].to_numpy()[order] for c in ("s", "y", "h"))


def precision_of_replicates(df: DataFrame, p: str, n_boot: int, rows: int = BUCKET_ROWS) -> DataFrame:
    """(rep, ap): average precision of column ``p`` under each replicate's weights; ``df`` has y and the row key h.

    Rows are cut into buckets by (score, key), so a score that half the rows have is many buckets. Each bucket gives the
    weighted totals of its first score, its last score and what lies between; these few arrays are summed from the top
    in one task (at most three rows a bucket), which settles the scores at bucket ends, wherever their rows lie, and
    gives every bucket the totals above its inner rows. A second pass adds up the inner rows from there.
    """
    d = write_once(bucketed(df.where(F.col(p).isNotNull()).select(F.col(p).cast("double").alias("s"), F.col("y").cast("long").alias("y"), "h"),
                            ["s", "h"], rows).withColumn("__b", F.col("__b").cast("long")), "resampled")

    def parts(g: pa.Table) -> pa.Table:
        s, y, h = _columns(g)
        inner = (s != s[0]) & (s != s[-1])
        out = []
        for part, mask in (("end", s == s[0]), ("end", (s == s[-1]) & (s != s[0])), ("inner", inner)):
            if mask.any():
                n, pos = totals(h[mask], y[mask], n_boot)
                out.append((part, g["__b"][0].as_py(), float(s[mask][0]), n, pos))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
            (pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["part", "b", "score", "n", "pos"])

    sums = write_once(d.groupBy("__b").applyInArrow(parts, PARTS), "resampled-parts")

    def from_top(g: pa.Table) -> pa.Table:
        """Value of the scores at bucket ends, and the totals above each bucket's inner rows."""
        order = sorted(range(len(g)), key=lambda i: -g["score"][i].as_py())
        n, pos = (np.stack([np.asarray(v, np.int64) for v in g[c].to_pylist()])[order] for c in ("n", "pos"))
        part, b, score = (np.array(g[c].to_pylist())[order] for c in ("part", "b", "score"))
        everything = np.maximum(pos.sum(axis=0), 1)
        above_n = above_pos = np.zeros(n.shape[1], np.int64)
        ap, out, i = np.zeros(n.shape[1]), [], 0
        while i < len(score):
            j = i + 1
            while j < len(score) and part[i] == "end" and part[j] == "end" and score[j] == score[i]:
                j += 1
            if part[i] == "inner":
                out.append(("inner", b[i], None, above_n, above_pos))
            above_n, above_pos = above_n + n[i:j].sum(axis=0), above_pos + pos[i:j].sum(axis=0)
            if part[i] == "end":
                ap += pos[i:j].sum(axis=0) / everything * above_pos / np.maximum(above_n, 1)
            i = j
        out.append(("ends", None, ap, pos.sum(axis=0), None))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
            (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["part", "b", "ap", "n", "pos"])

    settled = write_once(sums.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(from_top, "part string, b long, ap array<double>, n array<long>, pos array<long>"), "resampled-ends")

    def inner(key, g: pa.Table, above: pa.Table) -> pa.Table:
        ap = np.zeros(n_boot)
        if len(above) and len(g):
            s, y, h = _columns(g)
            mask = (s != s[0]) & (s != s[-1])
            s, y, h = s[mask], y[mask], h[mask]
            n, pos = (np.asarray(above[c][0].as_py(), np.int64) for c in ("n", "pos"))
            group_pos = np.zeros(n_boot, np.int64)                     # of a score that a slice has begun
            for i in range(0, len(s), SLICE):
                w, t, v = weights(h[i:i + SLICE], n_boot), y[i:i + SLICE], s[i:i + SLICE + 1]
                cn, cp = n + np.cumsum(w, axis=0), pos + np.cumsum(t[:, None] * w, axis=0)
                last = np.flatnonzero(np.append(v[1:] != v[:-1], [True] if i + SLICE >= len(s) else []))   # rows that end a score
                before = np.concatenate([(pos - group_pos)[None], cp[last]])[:-1] if len(last) else cp[:0]
                ap += ((cp[last] - before) * cp[last] / np.maximum(cn[last], 1)).sum(axis=0)
                group_pos = cp[-1] - cp[last[-1]] if len(last) else group_pos + cp[-1] - pos
                n, pos = cn[-1], cp[-1]
        return pa.table({"ap": pa.array([ap.tolist()], pa.list_(pa.float64()))})

    offsets = settled.where("part = 'inner'").select("b", "n", "pos")
    inside = d.groupBy("__b").cogroup(offsets.groupBy("b")).applyInArrow(inner, "ap array<double>")
    one = settled.where("part = 'ends'")
    summed = inside.select(F.posexplode("ap").alias("rep", "v")).groupBy("rep").agg(F.sum("v").alias("v"))     # buckets x replicates
    ends = one.select(F.posexplode(F.arrays_zip("ap", "n")).alias("rep", "e")).select("rep", F.col("e.ap").alias("ends"), F.col("e.n").alias("positives"))
    return (ends.where("positives > 0").join(summed, "rep", "left")
            .select("rep", (F.col("ends") + F.coalesce("v", F.lit(0.0)) / F.col("positives")).alias("ap")))


def bootstrap(df: DataFrame, a: str, b: str, n_boot: int = 1000, seed: int = 42, rows: int = BUCKET_ROWS) -> DataFrame:
    """Paired row resampling: interval of average precision for A, B and the lift B - A.

    A row's weight in a replicate depends on its (company, month) only, so both scores see the same draws and repeated
    runs agree. Rows without a score are left out of that score's figure.
    """
    keyed = df.withColumn("h", F.xxhash64(F.lit(seed), "company_id", "T"))
    scores = [precision_of_replicates(keyed, p, n_boot, rows).withColumnRenamed("ap", name) for p, name in ((a, "ap_a"), (b, "ap_b"))]
    both = reduce(lambda x, z: x.join(z, "rep"), scores).withColumn("lift", F.col("ap_b") - F.col("ap_a"))
    q = [F.percentile(x, p).alias(f"{x}_{n}") for x in ("ap_a", "ap_b", "lift") for n, p in (("lo", 0.025), ("hi", 0.975))]   # n_boot rows
    return both.agg(*q, F.avg("lift").alias("lift_mean"), F.avg((F.col("lift") <= 0).cast("int")).alias("p_lift_le_0"),
                    F.count(F.lit(1)).alias("replicates"))
