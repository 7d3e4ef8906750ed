"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected by fixed random matrices to blocks of eight numbers, scaled by the cell width, and every
block is decoded to its nearest point of the E8 lattice (the nearer of the nearest points of D8 and of D8 shifted by
one half). The points of a table's blocks name its cell. A vector is filed in its own cell of each table and also in
the ``probes`` neighbouring cells whose lattice points are next nearest. Pairs that share a cell, one of them by its own
point, are compared by exact cosine in double precision.

Equal vectors are one class and are filed once; their numbers count in the degrees. A pair found in several cells
counts in the first only (in order of table, then cell), which both sides' cell lists decide on the spot, so no pair
is ever emitted: a cell's task gives degrees, and links that join its parts. A cell above ``block`` vectors is split and its
pairs of blocks are separate tasks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cashlens.llm.common import components, grouped, per_batch, stage


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point of even sum: round all, and if the sum is odd, round the worst the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - r[odd]
        worst = np.abs(off).argmax(1)
        r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the differences to a cell's neighbours."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) * 0.5 for s in itertools.product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = _roots()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def cells(x: np.ndarray, tables: int, blocks: int, probes: int, width: float, seed: int) -> np.ndarray:
    """Cell numbers of unit rows: (rows, tables, 1 + probes); the vector's own cell first.

    A cell's number is a sum of its (doubled, whole) coordinates times random odd numbers, mixed; a neighbour's is the
    own sum plus the neighbour's fixed difference."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 62, (tables, 8 * blocks), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    for t in range(tables):
        y = x @ rng.standard_normal((x.shape[1], 8 * blocks)) / width
        own = np.concatenate([decode_e8(y[:, 8 * b:8 * b + 8]) for b in range(blocks)], 1)
        near = np.zeros((len(x), blocks, len(ROOTS)))
        for b in range(blocks):                                        # distance gained by each neighbour of a block
            off = y[:, 8 * b:8 * b + 8] - own[:, 8 * b:8 * b + 8]
            near[:, b] = 2.0 - 2 * off @ ROOTS.T
        best = np.argpartition(near.reshape(len(x), -1), probes - 1, axis=1)[:, :probes]
        whole = lambda v: np.rint(2 * v).astype(np.int64).astype(np.uint64)                            # noqa: E731
        step = (whole(ROOTS)[None] * factor[t].reshape(blocks, 1, 8)).sum(2).ravel()
        base = (whole(own) * factor[t]).sum(1)
        out[:, t, 0], out[:, t, 1:] = mixed(base), mixed(base[:, None] + step[best])
    return out


def usable(v) -> np.ndarray | None:
    """The unit vector in double precision; None for null, zero or non-finite ones."""
    if v is None or not len(v) or any(c is None for c in v):
        return None
    a = np.asarray(v, np.float64)
    if not np.isfinite(a).all() or not (big := np.abs(a).max()):
        return None
    a = a / big
    return a / np.linalg.norm(a)


class CellSearch:
    """Degrees and joining links of the pairs of one cell, or of two blocks of it."""

    def __init__(self, group: pa.Table, cosine: float):
        cols = {c: group[c] for c in ("v", "own", "probe", "class_id", "copies", "side")}
        self.x = np.stack([np.frombuffer(b, np.float64) for b in cols["v"].to_pylist()])
        self.own = np.stack([np.frombuffer(b, np.int64) for b in cols["own"].to_pylist()])
        self.probe = np.stack([np.frombuffer(b, np.int64) for b in cols["probe"].to_pylist()]).reshape(len(self.x), self.own.shape[1], -1)
        self.ids, self.copies, self.side = (cols[c].to_numpy() for c in ("class_id", "copies", "side"))
        self.table, self.cell, self.cosine = group["t"][0].as_py(), group["cell"][0].as_py(), cosine
        self.degree = np.zeros(len(self.x), np.int64)
        self.parent = np.arange(len(self.x))

    def first_here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether this is the first cell, by table and then by cell number, in which the pairs meet."""
        oi, oj = self.own[i], self.own[j]
        in_j = (oi[:, :, None] == self.probe[j]).any(2) | (oi == oj)    # they meet in i's own cell
        in_i = (oj[:, :, None] == self.probe[i]).any(2) | (oi == oj)
        t = self.table
        before = (in_j[:, :t] | in_i[:, :t]).any(1)
        big = np.iinfo(np.int64).max
        here = np.minimum(np.where(in_j[:, t], oi[:, t], big), np.where(in_i[:, t], oj[:, t], big))
        return ~before & (here == self.cell)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def run(self, split: bool):
        own_here = self.own[:, self.table] == self.cell
        links = []
        for lo in range(0, len(self.x), 512):
            hi = min(lo + 512, len(self.x))
            i, j = np.nonzero(self.x[lo:hi] @ self.x.T >= self.cosine - 1e-9)
            i += lo
            ok = (i < j) & (own_here[i] | own_here[j])
            if split:
                ok &= self.side[i] != self.side[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            exact = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= self.cosine
            i, j = i[exact], j[exact]
            first = self.first_here(i, j)
            i, j = i[first], j[first]
            np.add.at(self.degree, i, self.copies[j])
            np.add.at(self.degree, j, self.copies[i])
            for a, b in zip(i.tolist(), j.tolist()):
                ra, rb = self.root(a), self.root(b)
                if ra != rb:
                    self.parent[max(ra, rb)] = min(ra, rb)
                    links.append((a, b))
        return links


def near_vectors(vectors: DataFrame, cosine: float = 0.9, tables: int = 10, blocks: int = 2, probes: int = 8, width: float = 1.8,
                 block: int = 4096, seed: int = 11) -> DataFrame:
    """Every vector's links: vec_id, n_links, class_id (smallest vec_id of an equal direction's bytes), component_id.

    Vectors that are null, zero or hold null or non-finite components link with nothing. Vectors of different lengths
    are compared within their length only. A null vec_id is left out of comparison. Rows that share a vec_id count as
    separate vectors of one component. An empty table gives no row; other columns are ignored.
    """
    spark = vectors.sparkSession

    def unit(batch: pa.RecordBatch):
        raw = [usable(v) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None else v.tobytes() for v in raw], pa.binary())], names=["vec_id", "v"])

    src = stage(per_batch(vectors, [F.col("vec_id").cast("long").alias("vec_id"), "embedding"], unit, "vec_id bigint, v binary"), "lattice-units")
    known = src.where("vec_id is not null and v is not null")
    classes = stage(known.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "lattice-classes")

    def place(batch: pa.RecordBatch):
        v, ids, copies = (batch.column(k).to_pylist() for k in range(3))
        for size in sorted(set(map(len, v))):
            of_size = [i for i, b in enumerate(v) if len(b) == size]
            for lo in range(0, len(of_size), 200):
                at = of_size[lo:lo + 200]
                c = cells(np.stack([np.frombuffer(v[i], np.float64) for i in at]), tables, blocks, probes, width, seed + size)
                own, probe = np.ascontiguousarray(c[:, :, 0]), np.ascontiguousarray(c[:, :, 1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in at], pa.int64()), pa.array([copies[i] for i in at], pa.int64()), pa.array([v[i] for i in at], pa.binary()),
                     pa.array([r.tobytes() for r in own], pa.binary()), pa.array([r.tobytes() for r in probe], pa.binary())],
                    names=["class_id", "copies", "v", "own", "probe"])

    placed = stage(per_batch(classes, ["v", "class_id", "copies"], place,
                             "class_id bigint, copies bigint, v binary, own binary, probe binary"), "lattice-placed")

    def file(batch: pa.RecordBatch):
        """Numbers only: a vector goes to each of its cells once, marked where the cell is its own."""
        per = tables * (1 + probes)
        for lo in range(0, batch.num_rows, 200):
            b = batch.slice(lo, 200)
            n = b.num_rows
            own = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(n, tables, 1)
            cell = np.concatenate([own, np.frombuffer(b"".join(b.column(3).to_pylist()), np.int64).reshape(n, tables, probes)], 2)
            table = np.broadcast_to(np.arange(tables)[None, :, None], cell.shape).ravel()
            mine = np.broadcast_to(np.arange(1 + probes) == 0, cell.shape).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), per)), pa.array(table), pa.array(cell.ravel()),
                                              pa.array(np.repeat(b.column(1).to_numpy(), per)), pa.array(mine.astype(np.int32))],
                                             names=["dim", "t", "cell", "class_id", "own_cell"])

    keys = ["dim", "t", "cell"]
    filed = stage(per_batch(placed, [F.length("v").cast("long").alias("dim"), "class_id", "own", "probe"], file,
                            "dim bigint, t bigint, cell bigint, class_id bigint, own_cell int"), "lattice-cells")
    # cells where two vectors meet, one of them by its own point
    sizes = (filed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("own_cell").alias("own_cell")).where("n > 1 and own_cell = 1")
             .select(*keys, F.ceil(F.col("n") / block).cast("int").alias("parts")))
    dealt = (filed.drop("own_cell").join(sizes, keys).withColumn("side", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("b1", F.least("side", "other")).withColumn("b2", F.greatest("side", "other")).drop("other", "parts"))
    dealt = dealt.join(placed, "class_id")

    def search(g: pa.Table):
        if g.num_rows < 2:
            return
        s = CellSearch(g, cosine)
        links = s.run(g["b1"][0].as_py() != g["b2"][0].as_py())
        if links:
            n = np.flatnonzero(s.degree)
            a, b = (s.ids[np.array(k)] for k in zip(*links))
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[n]), pa.array(s.degree[n]), none], names=["a", "degree", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(b)], names=["a", "degree", "b"])

    found = stage(grouped(dealt, [*keys, "b1", "b2"], ["class_id"], search, "a bigint, degree bigint, b bigint"), "lattice-found")
    degrees = found.where("degree is not null").groupBy(F.col("a").alias("class_id")).agg(F.sum("degree").alias("others"))
    comp = components(spark, found.where("b is not null").select("a", "b"), "lattice-links").withColumnRenamed("node", "class_id")
    named = classes.join(degrees, "class_id", "left").join(comp, "class_id", "left").select(
        "v", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    return (src.join(named, "v", "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("class_id", "vec_id")).alias("class_id"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id")))
