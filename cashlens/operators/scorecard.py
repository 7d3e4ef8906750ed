"""A frozen linear scorecard on the log-odds scale.

It gives the series, alerts, projections and explanations a deterministic score that needs no
fitted model; a trained pipeline's probability column can take its place everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cashlens.functions.exprs import platt, sigmoid
from cashlens.operators.health import add_health
from cashlens.operators.panel import FEATURES, FEATURE_BLOCK, panel
from cashlens.sources.staging import staged
from cashlens.sources.treasury import Treasury

INTERCEPT = -1.9
# feature → (weight, training mean); a missing value counts as the mean
WEIGHTS = {
    "cash_neg_months_w3": (0.45, 1.2),
    "cash_months_of_outflow": (-0.05, 1.0),
    "days_of_cash": (-0.001, 20.0),
    "io_ratio_w3": (-0.5, 1.1),
    "inflow_w3_vs_w12": (-0.6, 1.0),
    "pay_open_overdue_share_w3": (1.4, 0.35),
    "pay_bad_share_w6": (1.1, 0.4),
    "rec_dpd_mean_w6": (0.015, 20.0),
    "interest_n_w3": (0.08, 1.0),
    "credit_util_T": (0.9, 0.05),
    "top1_in_share": (0.8, 0.15),
    "stress_terms_rate_w3": (0.7, 0.25),
    "months_in_panel": (-0.01, 12.0),
    "group_size": (0.005, 5.0),
    "sib_cash_neg_months_w6": (0.05, 2.4),
    "cash_conversion_days_w6": (0.004, 45.0),
    "pay_dpd_mean_w6": (0.012, 12.0),
    "debt_service_ratio_w6": (0.6, 0.2),
}
WEIGHTS_A = {f: WEIGHTS[f] for f in ("cash_months_of_outflow", "credit_util_T", "months_in_panel", "group_size")}
CALIBRATION = (0.9, -0.1)


def contribution(feature: str, weights=WEIGHTS, source: Column | None = None) -> Column:
    w, mean = weights[feature]
    x = F.col(feature) if source is None else source
    return F.coalesce(F.lit(w) * (x - mean), F.lit(0.0))


def log_odds(weights=WEIGHTS, values: dict[str, Column] | None = None) -> Column:
    values = values or {}
    return reduce(lambda a, b: a + b, [contribution(f, weights, values.get(f)) for f in weights], F.lit(INTERCEPT))


def raw_score(values: dict[str, Column] | None = None) -> Column:
    return F.round(sigmoid(log_odds(WEIGHTS, values)), 8)


def score(values: dict[str, Column] | None = None) -> Column:
    """Calibrated probability, six decimals."""
    return F.round(platt(raw_score(values), *CALIBRATION), 6)


def card(df: DataFrame, out: str) -> DataFrame:
    """The scorecard as a score: appends the calibrated probability as ``out``."""
    return df.withColumn(out, score())


def feature_panel(t: Treasury) -> DataFrame:
    """The full feature panel, written once."""
    return staged(t, "panel", lambda: panel(t, FEATURES + ["size_cohort"]).withColumns(
        {"score_raw": raw_score(), "score": score(), "score_A": F.round(sigmoid(log_odds(WEIGHTS_A)), 6)}))


def scored(t: Treasury) -> DataFrame:
    """Panel with score and health series, written once."""
    return staged(t, "scored", lambda: add_health(feature_panel(t), "score", t.cfg))


def contributions(t: Treasury, df: DataFrame | None = None) -> DataFrame:
    """One row per (company, month, feature): value, contribution, block."""
    df = feature_panel(t) if df is None else df
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(FEATURE_BLOCK[f]).alias("block"),
                              F.col(f).cast("double").alias("value"), F.round(contribution(f), 8).alias("phi"))
                     for f in WEIGHTS])
    return df.select("company_id", "T", "t_idx", "score", F.inline(rows))
