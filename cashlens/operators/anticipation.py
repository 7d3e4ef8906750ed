"""How early alerts come: deterioration events in the data against the health series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cashlens.config import PanelConfig
from cashlens.functions.exprs import count_if
from cashlens.operators import company_month as cm
from cashlens.operators.health import DOWN
from cashlens.operators.panel import dense, order
from cashlens.sources.treasury import Treasury


def bad_months(t: Treasury) -> DataFrame:
    """Months with negative cash, mostly late payables, or no movement after the first active month."""
    pay = cm.monthly(t, "cm_invoice_outcome").where("is_payable").select("company_id", "t_idx", "n_classifiable", "n_bad")
    df = dense(t, ["n_tx", "cash_balance"]).join(pay, ["company_id", "t_idx"], "left")
    first = F.min(F.when(F.col("n_tx") > 0, F.col("t_idx"))).over(W.partitionBy("company_id"))
    bad = (F.coalesce(F.col("cash_balance") < 0, F.lit(False))
           | F.coalesce((F.col("n_classifiable") >= 3) & (F.col("n_bad") / F.nullif(F.col("n_classifiable"), F.lit(0)) >= 0.5),
                        F.lit(False))
           | ((F.col("n_tx") == 0) & F.coalesce(F.col("t_idx") > first, F.lit(False))))
    return df.select("company_id", "T", "t_idx", bad.alias("bad"))


def with_series(bad: DataFrame, scored: DataFrame) -> DataFrame:
    s = scored.select("company_id", "t_idx", "health_smooth", "trajectory", "health_band")
    return bad.join(scored.select("company_id").distinct(), "company_id", "left_semi").join(
        s, ["company_id", "t_idx"], "left")


def events(m: DataFrame, cfg: PanelConfig, t_min: int) -> DataFrame:
    """First month with two bad months in a row after three good ones, per company, with its alert."""
    n, b = cfg.n_months, F.col("bad")
    prev_bad = F.bool_or("bad").over(order().rowsBetween(-3, -1))
    marked = m.withColumns({
        "__event": (F.col("t_idx") >= F.lit(max(t_min + 1, 3))) & (F.col("t_idx") <= n - 2) & b
        & F.lead("bad").over(order()) & ~prev_bad,
        "__h6": F.lag("health_smooth", 6).over(order())})
    ev = marked.where("__event").groupBy("company_id").agg(
        F.min_by(F.struct(F.col("t_idx").alias("e"), F.col("T").alias("event_month"),
                          F.col("health_smooth").alias("health_at_event"), F.col("__h6").alias("health_6m_before")),
                 "t_idx").alias("r")).select("company_id", "r.*")
    alarm = (F.col("health_smooth") < cfg.alert_health) | (F.col("trajectory") == DOWN)
    al = (m.where(alarm & (F.col("t_idx") >= t_min)).join(ev.select("company_id", "e"), "company_id")
          .where(F.col("t_idx").between(F.col("e") - 12, F.col("e")))
          .groupBy("company_id").agg(F.min(F.struct("t_idx", "T")).alias("a")))
    return ev.join(al, "company_id", "left").select(
        "company_id", "event_month", F.col("a.T").alias("alert_month"),
        (F.col("e") - F.col("a.t_idx")).alias("lead_months"), "health_at_event", "health_6m_before")


def false_alerts(m: DataFrame, cfg: PanelConfig, t_min: int) -> DataFrame:
    """First downward crossing of the alert level per company; false without a bad month in ten."""
    h, prev = F.col("health_smooth"), F.lag("health_smooth").over(order())
    crossing = (h < cfg.alert_health) & (prev.isNull() | (prev >= cfg.alert_health))
    after = F.bool_or("bad").over(order().rowsBetween(0, 9))
    return (m.withColumns({"__x": crossing, "__bad": after})
            .where(F.col("__x") & F.col("t_idx").between(t_min, cfg.n_months - 10))
            .groupBy("company_id").agg(F.min_by(F.struct("T", (~F.col("__bad")).alias("is_false")), "t_idx").alias("r"))
            .select("company_id", F.col("r.T").alias("crossing_month"), "r.is_false"))


def band_flips(m: DataFrame, cfg: PanelConfig, t_min: int) -> DataFrame:
    """Band changes and whether the next month takes them back."""
    band, prev, nxt = F.col("health_band"), F.lag("health_band").over(order()), F.lead("health_band").over(order())
    return (m.withColumns({"__p": prev, "__n": nxt})
            .where((F.col("__p") != band) & F.col("t_idx").between(t_min + 1, cfg.n_months - 2))
            .select("company_id", "T", F.coalesce(F.col("__n") == F.col("__p"), F.lit(False)).alias("reverted")))


def summary(ev: DataFrame, fa: DataFrame, bf: DataFrame) -> DataFrame:
    """One row. The share of anticipated events is given over detected and over all events."""
    lead = F.col("lead_months")
    e = ev.agg(F.count(F.lit(1)).alias("n_events"), count_if(lead >= 1).alias("n_anticipated"),
               F.count(lead).alias("n_detected"), F.percentile(lead, 0.5).alias("lead_median"),
               F.avg(lead).alias("lead_mean"), F.percentile(lead, 0.25).alias("lead_p25"),
               F.percentile(lead, 0.75).alias("lead_p75"),
               F.avg(F.col("health_at_event") - F.col("health_6m_before")).alias("health_drop_mean"))
    f = fa.agg(F.count(F.lit(1)).alias("n_alert_windows"), F.avg(F.col("is_false").cast("int")).alias("false_alert_rate"))
    b = bf.agg(F.count(F.lit(1)).alias("n_band_changes"), F.avg(F.col("reverted").cast("int")).alias("band_flip_rate"))
    return (e.crossJoin(f).crossJoin(b)                     # three single rows
            .withColumns({"share_of_detected": F.col("n_anticipated") / F.nullif(F.col("n_detected"), F.lit(0)),
                          "share_of_all": F.col("n_anticipated") / F.nullif(F.col("n_events"), F.lit(0)),
                          "share_detected": F.col("n_detected") / F.nullif(F.col("n_events"), F.lit(0))}))


def lead_distribution(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("lead_months").isNotNull()).groupBy("lead_months").agg(F.count(F.lit(1)).alias("n"))


def last_event(ev: DataFrame) -> DataFrame:
    """Newest event with an alert per company (several event sets may be concatenated)."""
    return ev.where(F.col("alert_month").isNotNull()).groupBy("company_id").agg(
        F.max_by(F.struct("alert_month", "event_month", "lead_months"), "event_month").alias("r")).select("company_id", "r.*")
