"""Exact ranks, cumulative sums and quantiles without one big sort per key.

A window over ``partitionBy(month)`` puts every company of that month in one task. Here rows are
first collapsed to distinct values (so ties cost nothing), values are cut into buckets at
approximate quantiles, and only the buckets are sorted. The cut points decide the balance of the
work and never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET_ROWS = 100_000                     # values that one task sorts, as long as FINEST buckets are enough
FINEST = 1024
WIDTH = 32                                # cuts in a group; a value looks at the groups' ends, then into one group


def thinned(cuts: Column, count: Column, rows: int) -> Column:
    """Groups of ``WIDTH`` of the sorted ``cuts`` that part ``count`` values into buckets of about ``rows``: none for few values, all for many."""
    parts = F.least(F.ceil(count / F.lit(rows)), F.size(cuts) + 1).cast("int")
    step = (F.size(cuts) + 1) / parts
    some = F.when(parts > 1, F.transform(F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1))),
                                         lambda i: F.element_at(cuts, F.floor(i * step).cast("int")))).otherwise(F.slice(cuts, 1, 0))
    groups = F.sequence(F.lit(0), F.floor(F.size(some) / WIDTH).cast("int"))
    return F.transform(groups, lambda g: F.slice(some, g * WIDTH + 1, WIDTH))


def bucket(groups: Column, value: Column) -> Column:
    """Number of cuts below ``value``."""
    whole = F.size(F.filter(groups, lambda g: (F.size(g) == WIDTH) & (F.element_at(g, -1) < value)))
    return whole * WIDTH + F.coalesce(F.size(F.filter(F.get(groups, whole), lambda c: c < value)), F.lit(0))


def cumulative(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None,
               rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per (keys, distinct non-null value), with for every measure m in ``sums``:
    m (in the value), m_before (all smaller values) and m_total (whole key).
    The default measure is the row count, ``n``. A key has as many buckets as its values fill with ``rows`` each.
    """
    sums = sums or {"n": F.lit(1)}
    names = list(sums)
    d = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
         .agg(*[F.sum(c).alias(m) for m, c in sums.items()]))
    probs = [i / FINEST for i in range(1, FINEST)]
    cuts = (d.groupBy(*keys).agg(F.percentile_approx(value, probs, 10_000).alias("__c"), F.count(F.lit(1)).alias("__n"))
            .select(*keys, thinned(F.col("__c"), F.col("__n"), rows).alias("__cuts")))
    if keys:
        d = d.join(cuts, keys)
    else:
        d = d.crossJoin(F.broadcast(cuts))          # a single row of less than FINEST cuts
    d = d.withColumn("__b", bucket(F.col("__cuts"), F.col(value))).drop("__cuts")
    # at most FINEST rows per key from here on
    per = d.groupBy(*keys, "__b").agg(*[F.sum(m).alias(f"__{m}") for m in names])
    wk = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    wb = wk.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*keys, "__b",
                     *[F.coalesce(F.sum(f"__{m}").over(wb), F.lit(0)).alias(f"__{m}_off") for m in names],
                     *[F.sum(f"__{m}").over(wk).alias(f"{m}_total") for m in names])
    wv = W.partitionBy(*keys, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (d.join(per, [*keys, "__b"])
            .select(*keys, value, *names,
                    *[(F.col(f"__{m}_off") + F.sum(m).over(wv) - F.col(m)).alias(f"{m}_before") for m in names],
                    *[f"{m}_total" for m in names]))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key (linear between the two neighbouring order statistics)."""
    c = cumulative(df, keys, value)

    def at(rank: Column) -> Column:
        hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n_total") - 1)
        aggs += [at(F.floor(pos)).alias(f"__lo_{name}"), at(F.ceil(pos)).alias(f"__hi_{name}")]
    out = c.groupBy(*keys).agg(F.max("n_total").alias("n"), *aggs)
    return out.select(*keys, "n", *[
        (F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}"))
         * (F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1)))).alias(k)
        for k, p in probs.items()])


def percent_rank_avg(df: DataFrame, keys: list[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Average-tie percentile rank in (0, 1], joined back on (keys, value)."""
    c = cumulative(df, keys, value)
    below = F.col("n_before") if not descending else F.col("n_total") - F.col("n_before") - F.col("n")
    r = c.select(*keys, value, ((below + (F.col("n") + 1) / 2) / F.col("n_total")).alias(out))
    return df.join(r, [*keys, value], "left")


def bucketed(df: DataFrame, order: list[str], rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``__b``, the bucket of about ``rows`` rows that a row falls into by ``order``.

    Cut points are tuples of the rows with the smallest hashes, as many as the rows fill buckets.
    """
    tup = F.struct(*[F.col(c) for c in order])
    sample = df.select(tup.alias("__t"), F.xxhash64(*order).alias("__h")).orderBy("__h").limit(FINEST - 1)
    cuts = (sample.agg(F.array_sort(F.collect_list("__t")).alias("__t")).crossJoin(df.agg(F.count(F.lit(1)).alias("__n")))
            .select(thinned(F.col("__t"), F.col("__n"), rows).alias("__cuts")))
    return (df.crossJoin(F.broadcast(cuts))          # a single row of less than FINEST tuples
            .withColumn("__b", bucket(F.col("__cuts"), tup)).drop("__cuts"))


def row_numbers(df: DataFrame, order: list[str], out: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Global 1-based row number by ``order`` (which must be unique), without a single-task sort."""
    d = bucketed(df, order, rows)
    per = d.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    wb = W.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("__b", F.coalesce(F.sum("__n").over(wb), F.lit(0)).alias("__off"),
                     F.sum("__n").over(W.partitionBy(F.lit(0))).alias(f"{out}_total"))
    wv = W.partitionBy("__b").orderBy(*order)
    return (d.join(F.broadcast(per), "__b")          # at most FINEST rows
            .withColumn(out, F.col("__off") + F.row_number().over(wv)).drop("__b", "__off"))
