"""Deterioration label: composite of outcome-window components, z-scored within size cohorts.

Every threshold (winsor bounds, cohort edges and statistics, label cut) is fitted on companies
that are not reserved, then applied to all. Quantiles are exact and never sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cashlens.functions.exprs import clip, flag
from cashlens.functions.ranking import quantiles
from cashlens.operators import company_month as cm
from cashlens.operators.panel import dense, order
from cashlens.sources.staging import staged, write_once
from cashlens.sources.treasury import Treasury


# ------------------------------------------------------------------------- reserved companies
def group_holdout(t: Treasury) -> DataFrame:
    """Whole groups reserved in hash order until enough companies are held out.

    Each group adds at least one company, so only the first ``holdout_companies`` groups in that
    order can matter: a distributed top-n, then a running sum over that many rows.
    """
    c = t.table("companies", "company_id", "group_id").withColumn(
        "g", F.coalesce("group_id", F.col("company_id").cast("string")))
    order = F.md5(F.concat(F.lit(f"{t.cfg.seed}:"), F.col("g")))
    groups = (c.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
              .where(F.col("size") <= t.cfg.holdout_max_group)
              .withColumn("o", order).orderBy("o", "g").limit(t.cfg.holdout_companies))
    before = F.coalesce(F.sum("size").over(
        W.partitionBy(F.lit(0)).orderBy("o", "g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = groups.withColumn("before", before).where(F.col("before") < t.cfg.holdout_companies)
    return c.join(chosen.select("g"), "g", "left_semi").select("company_id", "group_id")


# --------------------------------------------------------------------------------- components
def label_components(t: Treasury, gap: int | None = None, outcome: int | None = None) -> DataFrame:
    """Outcome-window components per eligible company-month (active lately, already in the panel)."""
    gap = t.cfg.gap_months if gap is None else gap
    outcome = t.cfg.outcome_months if outcome is None else outcome
    after, before = order().rowsBetween(gap + 1, gap + outcome), order().rowsBetween(-5, 0)
    payable = cm.monthly(t, "cm_invoice_outcome").where("is_payable").select("company_id", "t_idx", "n_classifiable", "n_bad")
    df = dense(t, ["n_tx", "inflow_oper", "outflow_oper", "cash_balance", "credit_drawn", "credit_granted"])
    df = df.join(payable, ["company_id", "t_idx"], "left")
    util = F.when(F.col("credit_granted") > 0, F.col("credit_drawn") / F.col("credit_granted"))
    out = df.select(
        "company_id", "T", "t_idx",
        F.sum(F.coalesce("n_classifiable", F.lit(0))).over(after).alias("n_cls"),
        F.sum(F.coalesce("n_bad", F.lit(0))).over(after).alias("n_bd"),
        F.count("cash_balance").over(after).alias("n_cash"),
        F.avg(flag(F.col("cash_balance") < 0)).over(after).alias("neg"),
        F.avg("inflow_oper").over(after).alias("in_after"), F.avg("inflow_oper").over(before).alias("in_before"),
        F.avg(util).over(after).alias("credit_util"),
        F.avg(flag(F.col("n_tx") == 0)).over(after).alias("inactivity"),
        F.avg("outflow_oper").over(before).alias("size_outflow_6m"),
        F.sum("n_tx").over(order().rowsBetween(-2, 0)).alias("recent"))
    # active in the last three months implies the first active month is not later than T
    return (out.where((F.col("t_idx") <= t.cfg.n_months - 1 - gap - outcome) & (F.col("recent") > 0))
            .select("company_id", "T", "t_idx",
                    F.when(F.col("n_cls") >= 3, F.col("n_bd") / F.col("n_cls")).alias("late_pay_rate"),
                    F.when(F.col("n_cash") > 0, F.col("neg")).alias("neg_cash_share"),
                    F.when(F.col("in_before") > 0, clip(1 - F.col("in_after") / F.col("in_before"), -1, 1))
                    .alias("collection_drop"),
                    "credit_util", "inactivity", "size_outflow_6m"))


def _component_rows(df: DataFrame, comps: list[str]) -> DataFrame:
    return df.unpivot([], comps, "component", "value")


def cohort_z(df: DataFrame, comps: list[str]) -> DataFrame:
    """Size cohort and winsorised z-scores; ``is_reserved`` rows are transformed, never fitted."""
    fit = df.where(~F.col("is_reserved"))
    edges = quantiles(fit, [], "size_outflow_6m", {"e1": 0.25, "e2": 0.5, "e3": 0.75}).drop("n")
    size = F.col("size_outflow_6m")
    cohort = (F.when(size <= F.col("e1"), "q1").when(size <= F.col("e2"), "q2")
              .when(size <= F.col("e3"), "q3").otherwise("q4"))
    bounds = quantiles(_component_rows(fit, comps), ["component"], "value", {"lo": 0.01, "hi": 0.99})
    bounds = bounds.groupBy().pivot("component", comps).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    one = edges.crossJoin(bounds)                       # single rows
    df = df.crossJoin(F.broadcast(one)).withColumn("size_cohort", cohort)
    df = df.withColumns({f"v_{c}": F.when(F.col(c).isNotNull(), F.least(F.greatest(c, f"{c}_lo"), f"{c}_hi"))
                         for c in comps})
    stats = df.where(~F.col("is_reserved")).groupBy("size_cohort").agg(
        *[F.avg(f"v_{c}").alias(f"mu_{c}") for c in comps],
        *[F.stddev_samp(f"v_{c}").alias(f"sd_{c}") for c in comps])
    df = df.join(F.broadcast(stats), "size_cohort", "left")    # four cohorts
    return df.withColumns({f"z_{c}": F.when(F.col(f"sd_{c}") != 0, (F.col(f"v_{c}") - F.col(f"mu_{c}"))
                                            / F.col(f"sd_{c}")) for c in comps})


def _available(weights: dict[str, float]) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    have = {c: F.col(f"z_{c}").isNotNull() for c in weights}
    wsum = reduce(lambda a, b: a + b, [F.when(have[c], w).otherwise(0.0) for c, w in weights.items()])
    num = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"z_{c}") * w, zero) for c, w in weights.items()])
    n = reduce(lambda a, b: a + b, [F.when(have[c], 1).otherwise(0) for c in weights])
    return num, wsum, n


def index_table(t: Treasury, gap: int | None = None, outcome: int | None = None) -> DataFrame:
    """Components, z-scores and index D per company-month with two components at least."""
    weights, comps = t.cfg.label_weights, list(t.cfg.label_weights)
    reserved = group_holdout(t).select("company_id", F.lit(True).alias("is_reserved"))
    rows = (label_components(t, gap, outcome).join(reserved, "company_id", "left")
            .withColumn("is_reserved", F.coalesce("is_reserved", F.lit(False))))
    rows = write_once(rows, "label_components")        # read several times below
    num, wsum, n = _available(weights)
    scored = cohort_z(rows, comps).select(
        "company_id", "T", "t_idx", "is_reserved", "size_cohort", "size_outflow_6m", *comps,
        *[f"z_{c}" for c in comps], n.alias("n_components"), F.when(wsum > 0, num / wsum).alias("D"))
    return scored.where("n_components >= 2")


def thresholds(index: DataFrame, percentiles: dict[str, float]) -> DataFrame:
    """One row: the label cuts at several percentiles of D, by name."""
    return quantiles(index.where(~F.col("is_reserved")), [], "D", percentiles).select(*percentiles)


def label_table(t: Treasury, gap: int | None = None, outcome: int | None = None,
                percentile: float | None = None) -> DataFrame:
    """Components, z-scores, index D, threshold and label per company-month."""
    index = index_table(t, gap, outcome)
    thr = thresholds(index, {"threshold": t.cfg.label_percentile if percentile is None else percentile})
    return (index.crossJoin(F.broadcast(thr))          # a single row
            .withColumn("y", (F.col("D") > F.col("threshold")).cast("int")))


def labels(t: Treasury) -> DataFrame:
    return staged(t, "labels", lambda: label_table(t))


def label_profile(t: Treasury) -> DataFrame:
    """Positive rates, component availability and correlation with D, as (metric, key, value)."""
    lab, comps = labels(t), list(t.cfg.label_weights)

    def part(df, metric, key="all"):
        return df.select(F.lit(metric).alias("metric"), F.lit(key).alias("key") if isinstance(key, str) else key,
                         F.col("value").cast("double").alias("value"))
    parts = [part(lab.agg(F.avg("y").alias("value")), "positive_rate"),
             part(lab.where("is_reserved").agg(F.avg("y").alias("value")), "positive_rate_reserved"),
             part(lab.groupBy("T").agg(F.avg("y").alias("value")), "positive_rate_month", F.col("T").alias("key"))]
    wide = lab.agg(*[F.avg(flag(F.col(c).isNotNull())).alias(f"a_{c}") for c in comps],
                   *[F.corr(c, "D").alias(f"r_{c}") for c in comps])
    for c in comps:
        parts.append(part(wide.select(F.col(f"a_{c}").alias("value")), "availability", c))
        parts.append(part(wide.select(F.col(f"r_{c}").alias("value")), "correlation", c))
    return reduce(DataFrame.unionByName, parts)
