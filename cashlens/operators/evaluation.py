"""Model evaluation from distinct-score tables: no metric sorts all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cashlens.functions.exprs import count_if
from cashlens.functions.ranking import cumulative, percent_rank_avg


def _tables(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    return cumulative(df, keys, p, {"n": F.lit(1), "pos": F.col("y")})


def pr_points(df: DataFrame, p: str, keys: list[str] = ()) -> DataFrame:
    """Precision and recall at every distinct threshold (score ≥ threshold is flagged)."""
    c = _tables(df, list(keys), p)
    tp, flagged = F.col("pos_total") - F.col("pos_before"), F.col("n_total") - F.col("n_before")
    return c.select(*keys, F.col(p).alias("threshold"), (tp / flagged).alias("precision"),
                    (tp / F.nullif(F.col("pos_total"), F.lit(0))).alias("recall"), F.col("pos"), F.col("pos_total"))


def auc_pr(df: DataFrame, p: str, keys: list[str] = ()) -> DataFrame:
    """Average precision: precision weighted by the recall step of each threshold."""
    return pr_points(df, p, keys).groupBy(*keys).agg(
        F.sum(F.col("pos") / F.nullif(F.col("pos_total"), F.lit(0)) * F.col("precision")).alias("auc_pr"))


def auc_roc(df: DataFrame, p: str, keys: list[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, ties count half."""
    c = _tables(df, list(keys), p)
    neg = F.col("n") - F.col("pos")
    neg_before = F.col("n_before") - F.col("pos_before")
    neg_total = F.max(F.col("n_total") - F.col("pos_total"))
    return c.groupBy(*keys).agg(
        (F.sum(F.col("pos") * (neg_before + neg / 2)) / F.nullif(neg_total * F.max("pos_total"), F.lit(0))).alias("auc_roc"))


def brier(df: DataFrame, p: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"),
                                 F.avg(F.pow(F.col(p) - F.col("y"), 2.0)).alias("brier"), F.avg("y").alias("base_rate"))


def _hits(k: Column) -> Column:
    """Positives among the k highest scores; ties at the cut share the places that are left."""
    above = F.col("n_total") - F.col("n_before") - F.col("n")
    places = F.greatest(F.least(k - above, F.col("n")), F.lit(0))
    return F.sum(F.col("pos") * places / F.col("n"))


def topk_month(df: DataFrame, p: str, k: int = 50) -> DataFrame:
    """Precision and recall of the k highest scores, and recall of the top tenth, per month."""
    c = _tables(df, ["T"], p)
    tenth = F.greatest(F.floor(F.col("n_total") * 0.1), F.lit(1))
    g = c.groupBy("T").agg(_hits(F.lit(k)).alias("hit"), _hits(tenth).alias("hit10"),
                           F.max("n_total").alias("n"), F.max("pos_total").alias("pos"))
    pos = F.greatest("pos", F.lit(1))
    return g.select("T", (F.col("hit") / F.least(F.lit(k), F.col("n"))).alias("precision_k"),
                    (F.col("hit") / pos).alias("recall_k"), (F.col("hit10") / pos).alias("recall_top10"))


def metrics(df: DataFrame, p: str) -> DataFrame:
    """All figures of one evaluation block in one row."""
    top = topk_month(df, p).agg(F.avg("precision_k").alias("precision_k"), F.avg("recall_k").alias("recall_k"),
                                F.avg("recall_top10").alias("recall_top10"))
    return brier(df, p).crossJoin(auc_pr(df, p)).crossJoin(auc_roc(df, p)).crossJoin(top)      # single rows


def calibration_curve(df: DataFrame, p: str, bins: int = 10) -> DataFrame:
    b = F.least(F.width_bucket(F.col(p), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return (df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("pred_mean"),
                                           F.avg("y").alias("obs_rate"))
            .where("n >= 10").select(((F.col("bin") - 1) / bins).alias("bin_lo"), (F.col("bin") / bins).alias("bin_hi"),
                                     "n", "pred_mean", "obs_rate"))


def confusion(df: DataFrame, p: str, share: float = 0.15) -> DataFrame:
    """TP / FN / FP / TN when the top share of each month is flagged."""
    r = percent_rank_avg(df, ["T"], p, "rank_pct", descending=True)
    flagged = F.col("rank_pct") <= share
    cls = (F.when(F.col("y") == 1, F.when(flagged, "TP").otherwise("FN")).otherwise(F.when(flagged, "FP").otherwise("TN")))
    return r.withColumn("cls", cls)


def dominant(df: DataFrame, cols: list[str]) -> Column:
    """Name of the largest of several columns, NULLs ignored, first wins ties."""
    best = F.greatest(*cols)
    out = F.when(F.col(cols[0]) == best, cols[0])
    for c in cols[1:]:
        out = out.when(F.col(c) == best, c)
    return out


def rate_by(df: DataFrame, kind: str, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.avg("y").alias("share"), F.count(F.lit(1)).alias("n")).select(
        F.lit(kind).alias("kind"), "key", "share", "n")


def class_profile(c: DataFrame, zcols: list[str]) -> DataFrame:
    """Per class: size, mean z of each component, coverage and history."""
    return c.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(z).alias(z) for z in zcols], F.avg("has_invoices").alias("has_invoices"),
        F.avg("months_in_panel").alias("months_in_panel"), F.avg("n_debt_products").alias("n_debt_products"),
        *[(count_if(F.col("size_cohort") == q) / F.count(F.lit(1))).alias(f"share_{q}") for q in ("q1", "q2", "q3", "q4")])
