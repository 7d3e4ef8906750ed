"""Tables written once between layers, in the shared folder named by ``spark.checkpoint.dir``.

A written table cuts the lineage, survives lost executors, and is read with column pruning.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T_ = TypeVar("T_")


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on a single machine (master ``local[...]``) may go without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: "
                               "layers are written there and read back")
        root = tempfile.mkdtemp(prefix="cashlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def staged(t, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The layer ``name`` of this treasury, built at most once; a second thread that asks for it meanwhile waits."""
    memo, locks = t.__dict__.setdefault("_staged", {}), t.__dict__.setdefault("_locks", {})
    with locks.setdefault(name, threading.RLock()):
        if name not in memo:
            memo[name] = write_once(build(), name)
        return memo[name]


def together(spark: SparkSession, jobs: list[Callable[[], T_]], at_once: int | None = None) -> list[T_]:
    """Results of jobs that don't need one another, run side by side, in order."""
    if min(len(jobs), at_once or len(jobs)) < 2:
        return [job() for job in jobs]
    scratch(spark)                                       # one folder for all
    with ThreadPoolExecutor(at_once or len(jobs)) as pool:
        return list(pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs]))
