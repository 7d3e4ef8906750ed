"""Six-month health projection from what happened next to company-months in a like state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cashlens.functions.exprs import clip, count_if, health_band
from cashlens.functions.neighbours import nearest

# --- Fixed values -----------------------------------------------------------------------------
HORIZON, K_NEIGHBOURS, BANDWIDTH, MIN_NEAR, MIN_HISTORY = 6, 400, 0.25, 40, 4
LOW_Q, HIGH_Q = 0.10, 0.90
DIMS = ["level", "surprise", "d1", "d3"]
DIM_WEIGHT = [2.0, 0.7, 0.9, 0.9]
NOTES = {
    "structural": "Caída sostenida tres meses seguidos: es deterioro, conviene actuar.",
    "blip": "Bache de un mes que ya se ha recuperado: no actúes.",
    "incipient": "Empieza a torcerse, pero aún no es estructural: vigila el próximo mes.",
    "normal": "Sin caída sostenida: el movimiento está dentro de lo normal.",
}


def states(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """State of every company-month, its position in the history, and the next deltas (NULL if unknown)."""
    o = W.partitionBy("company_id").orderBy("t_idx")
    hs = F.col("health_smooth")
    zero = F.lit(0.0)
    future = F.array(*[F.lead(hs, i).over(o) - hs for i in range(1, horizon + 1)])
    return df.select(
        "company_id", "T", "t_idx", F.row_number().over(o).alias("pos"), hs.alias("level"),
        (F.col("health") - hs).alias("surprise"), F.coalesce(hs - F.lag(hs, 1).over(o), zero).alias("d1"),
        F.coalesce(hs - F.lag(hs, 3).over(o), zero).alias("d3"),
        F.when(F.lead(hs, horizon).over(o).isNotNull(), future).alias("delta"))


def pool(st: DataFrame) -> DataFrame:
    """Company-months with enough history and a fully known future."""
    return st.where((F.col("pos") >= MIN_HISTORY) & F.col("delta").isNotNull())


def pool_scale(pl: DataFrame) -> DataFrame:
    """One row: spread of each state dimension (floored)."""
    return pl.agg(*[F.greatest(F.round(F.stddev_pop(d), 6), F.lit(1e-6)).alias(f"s_{d}") for d in DIMS])


def neighbours(targets: DataFrame, pl: DataFrame, n_months: int, k: int = K_NEIGHBOURS) -> DataFrame:
    return nearest(targets, pl, pool_scale(pl), DIMS, DIM_WEIGHT, k, own="company_id", own_rows=n_months,
                   target_id=["company_id", "t_idx"], pool_order=["company_id", "t_idx"], carry=["delta"])


def kernel(nb: DataFrame, min_near: int = MIN_NEAR, bandwidth: float = BANDWIDTH) -> DataFrame:
    """Gaussian weights; the bandwidth widens until ``min_near`` neighbours are close."""
    w = W.partitionBy("company_id", "t_idx")
    k = F.count(F.lit(1)).over(w)
    near = F.max(F.when(F.col("rank") <= F.least(F.lit(min_near), F.col("k")), F.col("dist"))).over(w)
    df = nb.withColumn("k", k).withColumn("bw", F.greatest(F.lit(bandwidth), near, F.lit(1e-6)))
    df = df.withColumn("__g", F.exp(-0.5 * F.pow(F.col("dist") / F.col("bw"), 2.0)))
    total = F.sum("__g").over(w)
    return df.withColumn("weight", F.when(total > 0, F.col("__g") / total).otherwise(1.0 / F.col("k"))).drop("__g")


def fan(kn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: weighted p10/p50/p90 path values per month ahead, drop and risk probabilities,
    effective neighbours and companies behind the band."""
    key = ["company_id", "t_idx"]
    w = W.partitionBy(*key)
    df = kn.join(targets.select(*key, F.col("level").alias("h0")), key)
    last = clip(F.col("h0") + F.element_at("p_delta", HORIZON), 0, 100)
    base = df.withColumns({"__max": F.max("weight").over(w), "__last": last}).groupBy(*key).agg(
        F.round(1.0 / F.sum(F.col("weight") * F.col("weight"))).cast("long").alias("n_neighbours"),
        F.countDistinct(F.when(F.col("weight") > F.col("__max") / 100, F.col("p_company_id"))).alias("n_companies"),
        F.sum(F.when(F.col("__last") <= F.col("h0") - 5, F.col("weight")).otherwise(0.0)).alias("prob_drop5"),
        F.sum(F.when(F.col("__last") < 50, F.col("weight")).otherwise(0.0)).alias("prob_risk"))
    paths = df.select(*key, "h0", "weight", "rank", F.posexplode("p_delta").alias("i", "d")).withColumn(
        "value", clip(F.col("h0") + F.col("d"), 0, 100))
    wv = W.partitionBy(*key, "i").orderBy("value", "rank").rowsBetween(W.unboundedPreceding, 0)
    cum = paths.withColumn("cum", F.sum("weight").over(wv))

    def at(q):
        return F.min(F.when(F.col("cum") >= q - 1e-9, F.col("value")))
    q = cum.groupBy(*key, (F.col("i") + 1).alias("h")).agg(at(LOW_Q).alias("low"), at(0.5).alias("median"), at(HIGH_Q).alias("high"))
    return q.join(base, key)


def line_fan(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Baseline: least-squares line over the last six smoothed values and a widening band."""
    o = W.partitionBy("company_id").orderBy("t_idx")
    f = o.rowsBetween(-5, 0)
    x, y = F.col("pos").cast("double"), F.col("y")
    d = df.withColumns({"pos": F.row_number().over(o), "y": F.round("health_smooth", 6)})
    n = F.regr_count(y, x).over(f)
    resid = F.sqrt(F.greatest(F.regr_syy(y, x).over(f) - F.coalesce(
        F.pow(F.regr_sxy(y, x).over(f), 2.0) / F.nullif(F.regr_sxx(y, x).over(f), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) / n)
    d = d.select("company_id", "T", "t_idx", "pos", "y",
                 F.coalesce(F.regr_slope(y, x).over(f), F.lit(0.0)).alias("slope"),
                 F.greatest(resid, F.lit(2.0)).alias("sigma"))
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    d = d.select("*", h).withColumn("median", clip(F.col("y") + F.col("slope") * F.col("h"), 0, 100))
    width = 1.96 * F.col("sigma") * F.sqrt(F.col("h").cast("double"))
    return d.withColumns({"low": F.greatest(F.lit(0.0), F.col("median") - width),
                          "high": F.least(F.lit(100.0), F.col("median") + width)})


def backtest(fans: DataFrame, line: DataFrame, st: DataFrame) -> DataFrame:
    """Coverage, error and width of both methods, per month ahead and per starting band."""
    actual = pool(st).select("company_id", "t_idx", "level", F.posexplode("delta").alias("i", "d")).select(
        "company_id", "t_idx", (F.col("i") + 1).alias("h"), (F.col("level") + F.col("d")).alias("actual"),
        health_band("level").alias("band"))
    both = reduce(DataFrame.unionByName, [
        d.select(F.lit(m).alias("method"), "company_id", "t_idx", "h", "low", "median", "high")
        for m, d in (("neighbours", fans), ("line", line))])
    j = both.join(actual, ["company_id", "t_idx", "h"])
    hit = ((F.col("actual") >= F.col("low")) & (F.col("actual") <= F.col("high"))).cast("int")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(hit).alias("coverage"),
            F.avg(F.abs(F.col("median") - F.col("actual"))).alias("mae"), F.avg(F.col("high") - F.col("low")).alias("width")]
    views = {"all": F.lit("all"), "month": F.col("h").cast("string"), "band": F.col("band")}
    return reduce(DataFrame.unionByName, [
        j.groupBy("method", k.alias("key")).agg(*aggs).select("method", F.lit(v).alias("by"), "key", "n", "coverage", "mae", "width")
        for v, k in views.items()])


def verdict(df: DataFrame) -> DataFrame:
    """Structural or dip with its note, per company-month."""
    o = W.partitionBy("company_id").orderBy("t_idx").rowsBetween(-2, 0)
    blip = F.bool_or("is_blip").over(o)
    note = (F.when(F.col("is_structural"), NOTES["structural"]).when(blip, NOTES["blip"])
            .when(F.col("trajectory") == "deteriorándose", NOTES["incipient"]).otherwise(NOTES["normal"]))
    return df.withColumns({"stability": F.when(F.col("is_structural"), "structural").otherwise("dip"), "note": note})


def shift(points: Column, delta: float) -> Column:
    """Move a list of projected values by a plan's effect, within 0–100."""
    return F.transform(points, lambda x: F.least(F.greatest(F.round(x + delta, 1), F.lit(0.0)), F.lit(100.0)))
