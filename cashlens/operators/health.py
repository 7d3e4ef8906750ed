"""Health series: 100·(1−p), smoothed, with trajectory, flags, band and alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cashlens.config import PanelConfig
from cashlens.functions.exprs import flag, health_band

# --- Fixed values: alert texts in priority order --------------------------------------------
ALERTS = ["caída estructural", "caída brusca este mes", "deterioro incipiente", "mejora progresiva",
          "excepcionalmente sólida"]
SEVERITY = {"caída estructural": 3, "caída brusca este mes": 2, "deterioro incipiente": 1}
DOWN, UP, FLAT = "deteriorándose", "mejorando", "estable"


def ema(c: str, order, alpha: float) -> Column:
    """Exponential average up to the current row; missing values carry the last average."""
    past = F.collect_list(c).over(order.rowsBetween(W.unboundedPreceding, 0))
    return F.aggregate(past, F.lit(None).cast("double"),
                       lambda acc, v: F.when(acc.isNull(), v).otherwise(alpha * v + (1 - alpha) * acc))


def alert(structural, d1, trajectory, exceptional, abrupt: float) -> Column:
    return (F.when(structural, ALERTS[0]).when(d1 <= -abrupt, ALERTS[1]).when(trajectory == DOWN, ALERTS[2])
            .when(trajectory == UP, ALERTS[3]).when(exceptional, ALERTS[4]).otherwise(""))


def severity(c: Column) -> Column:
    out = F.when(c == ALERTS[0], SEVERITY[ALERTS[0]])
    for k, v in list(SEVERITY.items())[1:]:
        out = out.when(c == k, v)
    return out.otherwise(0)


def add_health(df: DataFrame, p: str, cfg: PanelConfig, order_by: str = "t_idx") -> DataFrame:
    """One sort per company; three window passes over at most one row per month."""
    o = W.partitionBy("company_id").orderBy(order_by)
    h, hs = F.col("health"), F.col("health_smooth")
    df = df.withColumn("health", 100 * (1 - F.col(p).cast("double")))
    df = df.withColumn("health_smooth", ema("health", o, cfg.smoothing))
    df = df.withColumns({"health_delta_1m": hs - F.lag(hs, 1).over(o), "health_delta_3m": hs - F.lag(hs, 3).over(o),
                         "__raw1": h - F.lag(h, 1).over(o)})
    d1, d3, last3 = F.col("health_delta_1m"), F.col("health_delta_3m"), o.rowsBetween(-2, 0)
    n_ok = F.count(d1).over(last3)
    needed = F.least(F.lit(cfg.trend_consistent), n_ok)

    def consistent(cond):
        return (n_ok > 0) & (F.sum(F.when(cond, 1).otherwise(0)).over(last3) >= needed)
    df = df.withColumn("trajectory", F.when((d3 <= -cfg.trend_delta) & consistent(d1 < 0), DOWN)
                       .when((d3 >= cfg.trend_delta) & consistent(d1 > 0), UP).otherwise(FLAT))
    prev = F.lag("__raw1", 1).over(o)
    down3 = F.sum(flag(F.col("trajectory") == DOWN)).over(last3)
    strong = F.sum(flag(hs >= cfg.exceptional_health)).over(o.rowsBetween(1 - cfg.exceptional_months, 0))
    df = df.withColumns({
        "is_blip": F.coalesce((prev <= -cfg.blip_drop) & (F.col("__raw1") >= 0.6 * F.abs(prev)), F.lit(False)),
        "is_structural": down3 == 3, "is_exceptional": strong == cfg.exceptional_months}).drop("__raw1")
    return df.withColumns({
        "health_band": health_band("health_smooth"),
        "alert": alert(F.col("is_structural"), d1, F.col("trajectory"), F.col("is_exceptional"), cfg.abrupt_drop)})
