"""Exact k nearest neighbours through a partition tree.

The space is cut by a k-d tree, grown on a bounded sample until its leaves should hold ``LEAF_ROWS`` rows; every pool row
lies in one leaf. A target is first searched in its own leaf, whose rows are cut further, by their counts, into buckets
of a few hundred: nearest buckets first, until the next one is farther than the k-th row found. That distance is the
target's radius, and the target then visits only those other leaves whose box the radius touches. Best rows of all
leaves are merged. The tree decides the balance of the work and never the result.

At most ``need`` rows of one state can ever be chosen, so a state that a third of the pool shares is thinned first, and a
leaf that many targets fall into is searched by several tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from cashlens.sources.staging import write_once

LEAF_ROWS, MAX_LEAVES, SAMPLE_ROWS, BUCKET, TARGETS_A_TASK = 4096, 4096, 100_000, 256, 4096
SALTS = 32


# ---------------------------------------------------------------------------------------- tree
class Tree:
    """A k-d tree: inner nodes (dimension, value, left, right); a negative child -1 - i is leaf i."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        cut = None
        if leaves > 1 and len(x) > 1:
            for dim in np.argsort(-(x.max(0) - x.min(0)), kind="stable"):
                value = float(np.partition(x[:, dim], (len(x) - 1) // 2)[(len(x) - 1) // 2])
                left = x[:, dim] <= value
                if left.all():                                          # the upper half is one value: cut below it
                    lower = x[x[:, dim] < value, dim]
                    if not len(lower):
                        continue
                    value = float(lower.max())
                    left = x[:, dim] <= value
                cut = int(dim), value, left
                break
        if cut is None:
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append((cut[0], cut[1], 0, 0))
        share = min(max(round(leaves * cut[2].mean()), 1), leaves - 1)
        self.nodes[at] = (cut[0], cut[1], self._grow(x[cut[2]], share), self._grow(x[~cut[2]], leaves - share))
        return at

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out[rows] = -1 - node
                continue
            dim, value, left, right = self.nodes[node]
            go = x[rows, dim] <= value
            todo += [(left, rows[go]), (right, rows[~go])]
        return out


def gap(lo: np.ndarray, hi: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Distances from one point to many boxes."""
    d = np.maximum(np.maximum(lo - z, z - hi), 0.0)
    return np.sqrt((d * d).sum(1))


def buckets(z: np.ndarray, size: int = BUCKET) -> list[np.ndarray]:
    """Rows cut at medians of the widest dimension until no part holds more than ``size`` rows (or all are alike)."""
    out, todo = [], [np.arange(len(z))]
    while todo:
        rows = todo.pop()
        spread = z[rows].max(0) - z[rows].min(0)
        dim = int(spread.argmax())
        if len(rows) <= size or spread[dim] == 0:
            out.append(rows)
            continue
        order = rows[np.argsort(z[rows, dim], kind="stable")]
        todo += [order[:len(order) // 2], order[len(order) // 2:]]
    return out


def search(pool: dict, z: np.ndarray, raw: np.ndarray, own, k: int, radius: float, measure) -> np.ndarray:
    """Rows of the k smallest (distance, tie order) within ``radius`` of one target, best buckets first."""
    far = gap(pool["lo"], pool["hi"], z)
    order = np.argsort(far, kind="stable")
    sizes = np.cumsum([len(pool["buckets"][b]) for b in order])
    at = int(np.searchsorted(sizes, k)) + 1                             # as many buckets at once as hold k rows
    rows, dist, limit, todo = np.zeros(0, np.int64), np.zeros(0), radius, order[:at]
    while len(todo) and far[todo[0]] <= limit * (1 + 1e-9) + 1e-9:
        new = np.concatenate([pool["buckets"][b] for b in todo])
        new = new[pool["own"][new] != own]
        d = measure(pool["raw"][new], raw)
        near = d <= limit
        rows, dist = np.concatenate([rows, new[near]]), np.concatenate([dist, d[near]])
        if len(rows) > k:
            best = np.lexsort((pool["tie"][rows], dist))[:k]
            rows, dist = rows[best], dist[best]
        if len(rows) == k:
            limit = min(limit, dist.max())
        todo, at = order[at:at + 1], at + 1
    return rows[np.lexsort((pool["tie"][rows], dist))]


# --------------------------------------------------------------------------------------- search
def nearest(targets: DataFrame, pool: DataFrame, scale: DataFrame, dims: list[str], weights: list[float], k: int,
            own: str, own_rows: int, target_id: list[str], pool_order: list[str], carry: list[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The k nearest pool rows of every target that do not share its ``own`` value.

    ``scale`` is one row with column ``s_<dim>`` per dimension; ``own_rows`` bounds how many pool rows share an ``own``
    value; ``pool_order`` breaks ties; ``carry`` are kept pool columns.
    """
    need, zs = k + own_rows, [f"z_{d}" for d in dims]
    s = scale.first()                                                  # one row
    spread = [s[f"s_{d}"] or 1.0 for d in dims]                       # no spread: an empty pool

    def scaled(df):
        return df.withColumns({f"z_{d}": F.col(d) / F.lit(x) * F.lit(w) for d, x, w in zip(dims, spread, weights)})

    def measure(p: np.ndarray, t: np.ndarray) -> np.ndarray:
        total = np.zeros(len(p))
        for i, (x, w) in enumerate(zip(spread, weights)):
            e = (p[:, i] - t[i]) / x * w
            total = total + e * e
        return np.sqrt(total)

    # of equal states only the first `need` in tie order can ever be chosen: within salts, then among what is left
    def first(df, *salt):
        w = W.partitionBy(*dims, *salt).orderBy(*pool_order)
        return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= need).drop("__r")
    columns = list(dict.fromkeys([own, *pool_order, *carry]))
    p = pool.withColumn("__salt", F.pmod(F.xxhash64(*pool_order), F.lit(SALTS)))
    p = write_once(scaled(first(first(p, "__salt").drop("__salt")).select(*dict.fromkeys([*dims, *columns]))), "knn-pool")
    rows = p.count()
    leaves = min(MAX_LEAVES, max(1, -(-rows // max(leaf_rows, 2 * need))))
    step = max(1, rows // SAMPLE_ROWS)
    sample = p.where(F.pmod(F.xxhash64(*pool_order), F.lit(step)) == 0).select(*zs) if leaves > 1 else None
    tree = Tree(np.column_stack([np.asarray(c) for c in sample.toArrow().columns]) if leaves > 1 else np.zeros((0, len(dims))), leaves)

    @F.pandas_udf(T.IntegerType())
    def leaf(*z: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(np.column_stack([c.to_numpy(float) for c in z])))

    def in_leaf(df):
        return df.withColumn("leaf", leaf(*zs) if leaves > 1 else F.lit(0))

    p, t = in_leaf(p), in_leaf(scaled(targets.select(*dict.fromkeys([*target_id, own, *dims]))))
    if leaves > 1:
        p, t = write_once(p, "knn-pool"), write_once(t, "knn-targets")
    hit = T.StructType([T.StructField("dist", T.DoubleType()), *[p.schema[c] for c in dict.fromkeys([*pool_order, *columns])]])
    found = T.StructType([*[t.schema[c] for c in dict.fromkeys([*target_id, own, *dims, *zs])], T.StructField("leaf", T.IntegerType()),
                          T.StructField("radius", T.DoubleType()), T.StructField("hits", T.ArrayType(hit))])
    asked_columns = [f.name for f in found.fields[:-3]]

    def look(pool_rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({f.name: pa.array([], t_.type) for f, t_ in zip(found.fields, _arrow(found))})
        grid = lambda x, cols: np.column_stack([x[c].to_numpy() for c in cols]).astype(float) if x.num_rows else np.zeros((0, len(cols)))
        z, raw = grid(pool_rows, zs), grid(pool_rows, dims)
        parts = buckets(z) if len(z) else []
        tie = np.lexsort([pool_rows[c].to_numpy() for c in reversed(pool_order)])
        order = np.empty(len(z), np.int64)
        order[tie] = np.arange(len(z))
        held = {"raw": raw, "own": pool_rows[own].to_numpy(), "tie": order, "buckets": parts,
                "lo": np.array([z[b].min(0) for b in parts]).reshape(-1, len(zs)), "hi": np.array([z[b].max(0) for b in parts]).reshape(-1, len(zs))}
        tz, traw, towns, reach = grid(asked, zs), grid(asked, dims), asked[own].to_numpy(), asked["radius"].to_numpy()
        got = [search(held, tz[i], traw[i], towns[i], k, reach[i], measure) for i in range(len(tz))]
        ends = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
        flat = np.concatenate(got) if got else np.zeros(0, np.int64)
        dist = np.concatenate([measure(raw[g], traw[i]) for i, g in enumerate(got)])
        picked = pool_rows.take(pa.array(flat))
        fields = [pa.array(dist), *[picked[f.name].combine_chunks() for f in hit.fields[1:]]]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=[f.name for f in hit.fields]))
        # exactly k rows were found: the last one's distance bounds the search elsewhere
        limit = np.array([dist[b - 1] if b - a == k else r for a, b, r in zip(ends, ends[1:], reach)])
        return pa.table([*(asked[c] for c in asked_columns), asked["leaf"], pa.array(limit), lists], names=[f.name for f in found.fields])

    def visit(asked: DataFrame) -> DataFrame:
        """Every asked (target, leaf) searched in its leaf; leaves that many targets ask are met by several tasks."""
        per = {r["leaf"]: -(-r["n"] // TARGETS_A_TASK) for r in asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}   # a row a leaf
        parts = F.create_map(*[F.lit(x) for kv in per.items() for x in kv])[F.col("leaf")] if per else F.lit(None).cast("int")
        left = p.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        right = asked.withColumn("part", F.pmod(F.xxhash64(*target_id), parts).cast("int"))
        return left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(lambda a, b: look(a, b), found)

    one = visit(t.withColumn("radius", F.lit(float("inf"))))
    if leaves > 1:
        one = write_once(one, "knn-own")
        box = p.groupBy("leaf").agg(*[f(z).alias(f"{n}_{z}") for z in zs for n, f in (("lo", F.min), ("hi", F.max))]).toArrow()    # a row a leaf
        lo, hi = (np.column_stack([box[f"{n}_{z}"].to_numpy() for z in zs]) for n in ("lo", "hi"))
        number = box["leaf"].to_numpy()

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def others(home: pd.Series, radius: pd.Series, *z: pd.Series) -> pd.Series:
            at = np.column_stack([c.to_numpy(float) for c in z])
            return pd.Series([number[(gap(lo, hi, x) <= r * (1 + 1e-9) + 1e-9) & (number != h)].tolist() for h, r, x in zip(home, radius, at)])

        more = one.drop("hits").withColumn("leaf", F.explode(others("leaf", "radius", *zs)))
        one = one.unionByName(visit(write_once(more, "knn-asked")))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k)
    g = one.groupBy(*target_id).agg(best.alias("hits"))
    return g.select(*target_id, F.posexplode("hits").alias("rank", "h")).select(
        *target_id, (F.col("rank") + 1).alias("rank"), F.col("h.dist").alias("dist"), *[F.col(f"h.{c}").alias(f"p_{c}") for c in columns])


def _arrow(schema: T.StructType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    return list(to_arrow_schema(schema))
