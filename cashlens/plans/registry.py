"""Registry of ready-made queries over the star-schema test tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cashlens.sources.treasury import StarTreasury

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register ``fn(t: StarTreasury) -> DataFrame`` as a runnable query."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(treasury(spark, sf_dir))
        return fn
    return wrap


_OPEN: dict[tuple[str, str], StarTreasury] = {}


def treasury(spark: SparkSession, sf_dir: str) -> StarTreasury:
    """One treasury per session and folder, so layers written between queries are shared."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = StarTreasury(spark, sf_dir)
    return _OPEN[key]


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Output columns by spec: ``name`` as is, ``name:i`` whole number, ``name:2`` rounded."""
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind:
            c = F.round(c.cast("double"), int(kind))
        out.append(c.alias(name))
    return df.select(*out)
