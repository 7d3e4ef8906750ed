"""Score contributions: top features, month-over-month changes, drivers in health points, drags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cashlens.config import PanelConfig
from cashlens.functions.wording import FEATURE_METRIC, PROFILE, with_text


def top_features(df: DataFrame, by: str, n: int, keys=("company_id", "T")) -> DataFrame:
    """Rank by |value| (name breaks ties); at most one row per feature and key, so groups are small."""
    w = W.partitionBy(*keys).orderBy(F.desc(F.abs(by)), "feature")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def local(contrib: DataFrame, cfg: PanelConfig, n: int | None = None) -> DataFrame:
    """Largest contributions per company-month with direction and phrase."""
    top = top_features(contrib, "phi", n or cfg.top_contributions)
    return with_text(top).withColumn("direction", F.when(F.col("phi") > 0, "sube").otherwise("baja"))


def global_importance(contrib: DataFrame) -> DataFrame:
    """Mean |contribution| per feature, and each block's share of the total."""
    f = contrib.groupBy("feature", "block").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    total = F.sum("mean_abs").over(W.partitionBy(F.lit(0)))           # one row per feature
    return f.withColumns({"block_share": F.sum("mean_abs").over(W.partitionBy("block")) / total,
                          "behavioural_share": F.sum(F.when(F.col("block") != "A", F.col("mean_abs")).otherwise(0.0))
                          .over(W.partitionBy(F.lit(0))) / total})


def changes(contrib: DataFrame, n: int = 5) -> DataFrame:
    """Features whose contribution moved most since the company's previous month, own signals only."""
    w = W.partitionBy("company_id", "feature").orderBy("t_idx")
    d = (contrib.where(F.col("block") != "E")
         .withColumns({"delta_phi": F.col("phi") - F.lag("phi").over(w), "T_prev": F.lag("T").over(w),
                       "value_prev": F.lag("value").over(w)}).where(F.col("T_prev").isNotNull()))
    top = top_features(d, "delta_phi", n)
    top = with_text(with_text(top, "value_prev", "before"), "value", "after")
    return top.withColumn("direction", F.when(F.col("delta_phi") > 0, "empeora").otherwise("mejora"))


def why(chg: DataFrame, text: Column, n: int) -> DataFrame:
    """The first n texts per company-month, joined in rank order."""
    parts = F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", text.alias("x")))))
    return chg.groupBy("company_id", "T").agg(
        F.array_join(F.transform(parts, lambda s: s["x"]), " | ").alias("why"))


def actionable(ex: DataFrame) -> DataFrame:
    """Without profile features and undefined texts."""
    return ex.where(~F.col("feature").isin(*PROFILE) & ~F.coalesce(F.col("text").contains("nan"), F.lit(True)))


def top_driver(ex: DataFrame) -> DataFrame:
    return actionable(ex).groupBy("company_id", "T").agg(F.min_by("text", "rank").alias("top_driver"))


def with_streak(ex: DataFrame, months: DataFrame) -> DataFrame:
    """Start of the unbroken run of months in which a feature is listed with the same direction.

    ``months`` holds every (company, T) that has any row; a run breaks where the feature is absent.
    """
    seq = months.withColumn("pos", F.row_number().over(W.partitionBy("company_id").orderBy("T")))
    w = W.partitionBy("company_id", "feature", "direction").orderBy("pos")
    island = F.col("pos") - F.row_number().over(w)
    return (ex.join(seq, ["company_id", "T"]).withColumn("__island", island)
            .withColumn("since", F.min("T").over(W.partitionBy("company_id", "feature", "direction", "__island")))
            .drop("__island", "pos"))


def points(p: Column, phi: Column) -> Column:
    """Log-odds contribution → health points with the slope of the sigmoid at p."""
    return -100 * p * (1 - p) * phi


def drivers(ex: DataFrame, n: int = 5) -> DataFrame:
    """First n actionable contributions per company-month in health points, with streak start.
    ``ex`` is the local explanation (with score)."""
    act = actionable(ex)
    act = with_streak(act, act.select("company_id", "T").distinct())
    w = W.partitionBy("company_id", "T").orderBy("rank")
    impact = points(F.col("score"), F.col("phi"))
    return (act.withColumns({"pos": F.row_number().over(w), "impact": impact}).where(F.col("pos") <= n)
            .withColumn("sense", F.when(F.col("impact") > 0, "up").otherwise("down")))


def metric_of(feature: Column) -> Column:
    out = None
    for f, m in FEATURE_METRIC.items():
        out = F.when(feature == f, m) if out is None else out.when(feature == f, m)
    return out


def drags(contrib: DataFrame, n: int = 6) -> DataFrame:
    """What lowers health now and can be acted on: points, and the metric that fixes it."""
    t = with_text(contrib.where((F.col("phi") > 0) & (F.col("block") != "E")))
    top = top_features(actionable(t), "phi", n)
    return top.withColumns({"impact": points(F.col("score"), F.col("phi")), "metric_id": metric_of(F.col("feature"))})
