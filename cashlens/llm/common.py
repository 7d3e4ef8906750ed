"""Helpers shared by the operators: reading, staging, split keys, and connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cashlens.sources.staging import fresh_path, write_once


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per application, as ``--py-files`` would."""
    app, top = spark.sparkContext.applicationId, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="modules-"), "cashlens_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return write_once(df, name)


def drop_stage(df: DataFrame) -> None:
    """Delete a table that ``stage`` wrote, once everything that reads it is written itself."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared storage, for files that tasks write themselves."""
    return fresh_path(spark, name)


def held_out(key: Column, folds: int) -> Column:
    """True for the rows never learnt from: crc32 of the key as text leaves remainder 2. A null key is learnt from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == 2, F.lit(False))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


_MEMOS: dict[str, object] = {}
_OF_STAGE: dict = {"stage": None, "memos": {}}


def memo(name: str, make, whole_stage: bool = False):
    """What ``make()`` gave, kept for the running task, or for the tasks of its stage that this worker runs.

    ``per_batch`` and ``grouped`` drop a task's memos when its rows end, and a stage's when the worker begins another
    stage, so that reused workers don't pile them up. Memos are bounded by their owners."""
    held = _OF_STAGE["memos"] if whole_stage else _MEMOS
    if name not in held:
        held[name] = make()
    return held[name]


def forgetting(batches: Iterator) -> Iterator:
    """The same rows; memos go at their end, and when the task stops early, and unused memory goes back."""
    now = TaskContext.get().stageId()
    if _OF_STAGE["stage"] != now:
        _OF_STAGE.update(stage=now, memos={})
    try:
        yield from batches
    finally:
        _MEMOS.clear()
        pa.default_memory_pool().release_unused()


def per_batch(df: DataFrame, columns: list, fn, schema, rows: int = 1 << 30) -> DataFrame:
    """``mapInArrow`` over the named columns only. ``fn``: a record batch of at most ``rows`` → any number of record batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                yield from fn(b.slice(lo, rows))
    return df.select(*columns).mapInArrow(lambda batches: forgetting(run(batches)), schema)


def with_scores(docs: DataFrame, fn, names: list[str], types: str, carry: bool) -> DataFrame:
    """Append what ``fn(texts)`` gives for the text column: arrays in the order of ``names``, of Spark ``types``.

    With ``carry`` every column of ``docs`` goes along unchanged (no join by key afterwards, so null and repeated keys
    are safe); otherwise doc_id alone. ``names`` must not be names of carried columns.
    """
    docs = docs if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.columns if carry else ["doc_id"]
    if taken := set(out) & set(names):
        raise ValueError(f"columns {sorted(taken)} exist already")
    schema = T.StructType([docs.schema[c] for c in out] + T._parse_datatype_string(types).fields)

    def run(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 1024):
            b = batch.slice(lo, 1024)
            got = fn([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), *map(pa.array, got)], names=[*out, *names])
    return per_batch(docs, [F.col(f"`{c}`") for c in docs.columns], run, schema)


def components(spark: SparkSession, links: DataFrame, name: str) -> DataFrame:
    """Connected components of ``links`` (a, b long; a != b) as (node, component = smallest node).

    Alternating large-star and small-star steps, each an aggregate and a join on the node, written to the shared
    folder. Edges shrink towards one star per component; a hub's edges are never gathered in one row: minima are
    partial aggregates and the join back is split by adaptive execution. Only the count of edges still moving
    reaches the driver.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: every larger neighbour of u moves to u's minimum
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        large = stage(large, name)
        # small star: u and its smaller neighbours move to their minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        small = stage(small, name)
        moved = small.join(edges, ["u", "v"], "left_anti").limit(1).count()
        edges = small
        if not moved:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def with_components(nodes: DataFrame, key: str, comp: DataFrame, out: str) -> DataFrame:
    """``nodes`` with the component of ``key``; a node without links is its own component."""
    return (nodes.join(comp.withColumnRenamed("node", key), key, "left")
            .withColumn(out, F.coalesce(F.col("component"), F.col(key))).drop("component"))


def grouped(df: DataFrame, keys: list[str], order: list[str], fn, schema: str, partitions: int | None = None) -> DataFrame:
    """Run ``fn(group: pa.Table)`` → record batches on every group of ``keys``, many small groups to a task.

    Rows are dealt by the keys and sorted inside partitions; a task streams through them and holds one group at a time.
    ``fn`` must allow for every group fitting a task: callers split their groups by size beforehand.
    """
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            n = t.num_rows
            new = np.zeros(n, bool)
            for k in keys:
                c = t[k].combine_chunks().to_numpy(zero_copy_only=False)
                new[1:] |= c[1:] != c[:-1]
            cuts = np.flatnonzero(new)
            start = 0
            for c in cuts:
                yield from fn(t.slice(start, c - start))
                start = c
            held = t.slice(start)
        if held is not None and held.num_rows:
            yield from fn(held)

    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: forgetting(run(batches)), schema)


def id_filter(ids: DataFrame, key: str, bits: int = 1 << 25, hashed: bool = False):
    """Broadcast bitmap of hashed ids, 4 MB whatever their number: rows it refuses need no shuffle; an equi-join decides the rest.

    ``hashed``: the ids are hashes, whose low bits are the place."""
    place = F.col(key).bitwiseAND(F.lit(bits - 1)) if hashed else F.pmod(F.xxhash64(key), F.lit(bits))
    rows = (ids.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("b"))
            .agg(F.bitmap_construct_agg((F.col("p") % 32768)).alias("m")).collect())           # bits / 32768 rows of 4 KB
    flags = np.zeros(bits // 8, np.uint8)
    for r in rows:
        flags[r["b"] * 4096:(r["b"] + 1) * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(flags)

    def test(places: np.ndarray) -> np.ndarray:
        return (shared.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0
    return place, test
