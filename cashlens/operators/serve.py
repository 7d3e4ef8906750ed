"""Served tables and portfolio views, built for all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from cashlens.functions.exprs import (coarse_band, count_if, country_group, group_bucket, inv_slog, risk_band, trend)
from cashlens.functions.ranking import percent_rank_avg, quantiles
from cashlens.operators import explain
from cashlens.operators.health import severity
from cashlens.operators.labels import group_holdout, labels
from cashlens.operators.scorecard import contributions, scored
from cashlens.sources.staging import staged, together
from cashlens.sources.treasury import Treasury

# --- Fixed values: columns of the served tables ----------------------------------------------
KPI_COLS = [
    "cash_balance_T_log", "cash_months_of_outflow", "days_of_cash", "cash_neg_months_w3", "io_ratio_w1", "io_ratio_w3",
    "inflow_w1_log", "outflow_w1_log", "pay_dpd_mean_w3", "pay_open_overdue_share_w3", "pay_bad_share_w6",
    "rec_open_overdue_share_w3", "rec_dpd_mean_w3", "interest_n_w3", "credit_util_T", "hhi_in", "top1_in_share",
    "stress_terms_rate_w3", "no_counterparty_share_w3", "n_tx_w1", "salary_months_share_w6", "tax_months_share_w6",
]
BENCH_KPIS = ["score", "pay_dpd_mean_w3", "pay_open_overdue_share_w3", "io_ratio_w3", "cash_months_of_outflow", "hhi_in",
              "interest_n_w3"]
WORSE_HIGH = {"io_ratio_w3": False, "cash_months_of_outflow": False}
HEALTH_COLS = ["health", "health_smooth", "health_delta_1m", "health_delta_3m", "trajectory", "is_blip",
               "is_structural", "is_exceptional", "health_band", "alert"]


def at_latest(df: DataFrame) -> DataFrame:
    """Rows of the newest month (one aggregated row, broadcast)."""
    return df.join(F.broadcast(df.agg(F.max("T").alias("T"))), "T", "left_semi")


def last_row(df: DataFrame, *cols: str) -> DataFrame:
    """Newest row per company as an aggregate, no sort."""
    return df.groupBy("company_id").agg(F.max_by(F.struct(*cols), "t_idx").alias("r")).select("company_id", "r.*")


def risk_score(t: Treasury) -> DataFrame:
    sc, lab = together(t.spark, [lambda: scored(t), lambda: labels(t)])
    sc = sc.select("company_id", "T", "t_idx", "size_cohort", "score", "score_raw", "score_A", *HEALTH_COLS)
    lab = lab.select("company_id", "T", F.col("y").alias("realized_label"), F.col("D").alias("realized_D"))
    last_labelled = lab.agg(F.max("T").alias("__last"))
    df = percent_rank_avg(sc, ["T"], "score", "percentile")
    df = percent_rank_avg(df, ["T", "size_cohort"], "score", "percentile_cohort")
    return (df.join(lab, ["company_id", "T"], "left").crossJoin(F.broadcast(last_labelled))    # a single row
            .withColumns({"band": risk_band("score"),
                          "delta_1m": F.col("score") - F.lag("score").over(W.partitionBy("company_id").orderBy("t_idx")),
                          "is_out_of_sample": F.col("T") > F.col("__last")}).drop("__last"))


def risk(t: Treasury) -> DataFrame:
    return staged(t, "risk_score", lambda: risk_score(t))


def held_out_flag(df: DataFrame, t: Treasury) -> DataFrame:
    ids = group_holdout(t).select("company_id", F.lit(True).alias("held_out"))
    return df.join(ids, "company_id", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def company_master(t: Treasury) -> DataFrame:
    """Attributes and latest score of every company in the panel."""
    attrs = ["country", "currency", "erp_any", "main_bank", "group_size", "n_bank_accounts", "n_banks",
             "n_debt_products", "debt_granted_total", "size_cohort", "has_invoices", "months_in_panel"]
    last = scored(t).groupBy("company_id").agg(
        F.max_by(F.struct(*attrs), "t_idx").alias("r"), F.min("T").alias("first_month"), F.max("T").alias("last_month"))
    now = last_row(risk(t), F.col("score").alias("latest_score"), F.col("band").alias("latest_band"),
                   F.col("delta_1m").alias("latest_delta_1m"), F.col("percentile").alias("latest_percentile"),
                   F.col("health_smooth").alias("latest_health"), F.col("health_band").alias("latest_health_band"),
                   F.col("trajectory").alias("latest_trajectory"))
    dim = t.table("companies", "company_id", "group_id", "created_at")
    df = last.select("company_id", "r.*", "first_month", "last_month").join(now, "company_id").join(dim, "company_id")
    return held_out_flag(df, t).withColumns({"has_invoices": F.col("has_invoices") > 0}).withColumnsRenamed(
        {"erp_any": "erp", "held_out": "is_test_company", "debt_granted_total": "debt_granted_total_log"})


def company_kpi(t: Treasury) -> DataFrame:
    """Monthly indicators with logs undone, and the realised outcome components where labelled."""
    comps = list(t.cfg.label_weights)
    out = labels(t).select("company_id", "T", *[F.col(c).alias(f"outcome_{c}") for c in comps])
    logs = ["cash_balance_T_log", "inflow_w1_log", "outflow_w1_log"]
    return (scored(t).select("company_id", "T", *KPI_COLS).join(out, ["company_id", "T"], "left")
            .withColumns({"cash_balance": inv_slog("cash_balance_T_log"), "inflow_oper": F.expm1("inflow_w1_log"),
                          "outflow_oper": F.expm1("outflow_w1_log")}).drop(*logs))


def explanations(t: Treasury) -> DataFrame:
    return staged(t, "explanations", lambda: explain.local(contributions(t), t.cfg))


def change_explanations(t: Treasury) -> DataFrame:
    return staged(t, "changes", lambda: explain.changes(contributions(t)))


def alerts(t: Treasury) -> DataFrame:
    """What deserves attention in the newest month, with the two changes that explain it."""
    now = at_latest(risk(t)).where(F.col("alert") != "")
    why = explain.why(change_explanations(t), F.col("after"), 2)
    return now.join(why, ["company_id", "T"], "left").select(
        "company_id", "T", "alert", severity(F.col("alert")).alias("severity"), "health_smooth", "health_delta_1m",
        "health_delta_3m", "trajectory", "why")


def cohort_cells(df: DataFrame, t: Treasury) -> DataFrame:
    return df.withColumns({"country_group": country_group("country", t.cfg.home_countries),
                           "group_bucket": group_bucket("group_size")})


def kpi_rows(t: Treasury) -> DataFrame:
    """One row per (company, month, kpi) with the benchmark cell."""
    cells = cohort_cells(scored(t).select("company_id", "T", "size_cohort", "country", "group_size", *BENCH_KPIS), t)
    return cells.unpivot(["company_id", "T", "size_cohort", "country_group", "group_bucket"],
                         [F.col(k).cast("double").alias(k) for k in BENCH_KPIS], "kpi", "value")


def benchmark(t: Treasury) -> DataFrame:
    """Quartiles per fine cell and per size-only cell, from ``min_cohort`` values up.

    Every value counts once in its fine cell and once in the size cell (two grouping sets)."""
    rows = kpi_rows(t)
    both = rows.select("T", "size_cohort", "kpi", "value", F.inline(F.array(
        F.struct(F.col("country_group"), F.col("group_bucket")),
        F.struct(F.lit("ALL").alias("country_group"), F.lit("ALL").alias("group_bucket")))))
    q = quantiles(both, ["T", "size_cohort", "country_group", "group_bucket", "kpi"], "value",
                  {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return q.where(F.col("n") >= t.cfg.min_cohort)


def benchmarks(t: Treasury) -> DataFrame:
    return staged(t, "benchmark", lambda: benchmark(t))


def company_benchmark(t: Treasury) -> DataFrame:
    """Own newest value against the fine cell, or the size-only cell when the fine one has no rows at all."""
    own = at_latest(kpi_rows(t))
    b = benchmarks(t)
    cell = ["T", "size_cohort", "country_group", "group_bucket"]
    fine = b.where(F.col("country_group") != "ALL")
    wide = (b.where(F.col("country_group") == "ALL").drop("country_group", "group_bucket"))
    has_fine = fine.select(*cell).distinct().withColumn("has_fine", F.lit(True))
    cols = ["n", "p25", "p50", "p75"]
    j = (own.join(has_fine, cell, "left").join(fine.select(*cell, "kpi", *[F.col(c).alias(f"f_{c}") for c in cols]),
                                               [*cell, "kpi"], "left")
         .join(wide.select("T", "size_cohort", "kpi", *[F.col(c).alias(f"w_{c}") for c in cols]),
               ["T", "size_cohort", "kpi"], "left"))
    fallback = F.col("has_fine").isNull()
    return j.select("company_id", *cell, "kpi", "value", fallback.alias("fallback"), *[
        F.when(fallback, F.col(f"w_{c}")).otherwise(F.col(f"f_{c}")).alias(c) for c in cols]).where("n IS NOT NULL")


def benchmark_position(df: DataFrame) -> DataFrame:
    """good / mid / bad against the quartiles, oriented by whether high values are worse."""
    worse_high = ~F.col("kpi").isin(*[k for k, v in WORSE_HIGH.items() if not v])
    v = F.col("value")
    bad = F.when(worse_high, v > F.col("p75")).otherwise(v < F.col("p25"))
    good = F.when(worse_high, v < F.col("p25")).otherwise(v > F.col("p75"))
    return df.withColumn("position", F.when(v.isNull(), "").when(bad, "bad").when(good, "good").otherwise("mid"))


# ------------------------------------------------------------------------------------ portfolio
def portfolio_rows(t: Treasury) -> DataFrame:
    """One row per company in the newest month with its first actionable driver."""
    now = at_latest(risk(t))
    attrs = company_master(t).select("company_id", "group_id", "country", "erp", "main_bank", "is_test_company")
    top = explain.top_driver(at_latest(explanations(t))).select("company_id", "top_driver")
    return now.join(attrs, "company_id").join(top, "company_id", "left").select(
        "company_id", "T", F.round("health_smooth", 1).alias("score"), coarse_band("health_band").alias("band"),
        trend("trajectory").alias("trend"), F.round(F.coalesce("health_delta_3m", F.lit(0.0)), 1).alias("delta3m"),
        F.round(F.coalesce("health_delta_1m", F.lit(0.0)), 1).alias("delta1m"), F.col("is_test_company").alias("held_out"),
        F.coalesce("top_driver", F.lit("—")).alias("top_driver"), "health_band", "trajectory",
        F.col("alert").alias("signal"), F.round("score", 4).alias("p_deterioration"), "group_id", "size_cohort",
        "country", "erp", "main_bank")


def portfolio(t: Treasury) -> DataFrame:
    return staged(t, "portfolio", lambda: portfolio_rows(t))


def search(df: DataFrame, text: str | None, *cols: str) -> DataFrame:
    """Case-insensitive substring on any of the columns; blank text keeps everything."""
    text = (text or "").strip().lower()
    if not text:
        return df
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.col(c).cast("string")).contains(text), F.lit(False))
    return df.where(cond)


def portfolio_filter(df: DataFrame, direction=None, band=None, cohort=None, text=None) -> DataFrame:
    for name, value in (("trend", direction), ("health_band", band), ("size_cohort", cohort)):
        if value:
            df = df.where(F.col(name) == value)
    return search(df, text, "company_id", "group_id")


PORTFOLIO_ORDERS: dict[str, list[Column | str]] = {
    "movement": ["-abs(delta3m)"], "fall": ["delta3m"], "rise": ["-delta3m"], "lowest": ["score"], "highest": ["-score"]}


def portfolio_order(df: DataFrame, order: str = "movement", limit: int | None = None) -> DataFrame:
    """Rows in a report order, ties by company; only the first ``limit`` where one is given."""
    out = df.orderBy(*[F.expr(e) for e in PORTFOLIO_ORDERS[order]], "company_id")
    return out if limit is None else out.limit(limit)


def alert_order(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Alerts, gravest and fastest falling first; only the first ``limit`` where one is given."""
    out = df.orderBy(F.desc("severity"), "health_delta_1m", "company_id")
    return out if limit is None else out.limit(limit)


def portfolio_history(t: Treasury) -> DataFrame:
    band = F.col("health_band")
    return scored(t).groupBy("T").agg(
        count_if(band == "sólida").alias("solid"), count_if(band == "sana").alias("healthy"),
        count_if(band == "vigilar").alias("watch"), count_if(band == "riesgo").alias("risk"),
        F.avg("health_smooth").alias("mean_health"))


def portfolio_counts(df: DataFrame) -> DataFrame:
    return df.agg(count_if(F.col("band") == "healthy").alias("healthy"), count_if(F.col("band") == "stable").alias("stable"),
                  count_if(F.col("band") == "risk").alias("risk"), count_if(F.col("trend") == "up").alias("improving"),
                  count_if(F.col("trend") == "down").alias("slipping"), count_if(F.col("held_out")).alias("held_out"))


def score_distribution(t: Treasury) -> DataFrame:
    """Counts by band, health band and trajectory now, and mean score and high-risk count per month."""
    now = at_latest(risk(t))
    parts = [now.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
             .select(F.lit(kind).alias("kind"), "key", "n", "mean_score", F.lit(None).cast("long").alias("n_high"))
             for kind, c in (("band", "band"), ("health_band", "health_band"), ("trajectory", "trajectory"))]
    month = risk(t).groupBy(F.col("T").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"),
        count_if(F.col("band").isin("alto", "crítico")).alias("n_high")).select(
        F.lit("month").alias("kind"), "key", "n", "mean_score", "n_high")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(month)


PAGE_ORDERS = {
    "score": ("score", False), "delta": ("delta_1m", False), "delta_asc": ("delta_1m", True), "company": ("company_id", True),
    "percentile": ("percentile", False), "health": ("health_smooth", True), "health_desc": ("health_smooth", False),
    "health_delta": ("health_delta_3m", True), "health_delta_desc": ("health_delta_3m", False)}


def list_companies(t: Treasury, month=None, band=None, cohort=None, country=None, text=None, trajectory=None,
                   health_band=None) -> DataFrame:
    """Portfolio search over the risk table and the company master."""
    r = risk(t)
    r = r.where(F.col("T") == month) if month else at_latest(r)
    c = company_master(t).select("company_id", "group_id", "country", "erp", "main_bank", "group_size", "has_invoices")
    df = r.join(c, "company_id")
    for name, value in (("band", band), ("size_cohort", cohort), ("country", country), ("trajectory", trajectory),
                        ("health_band", health_band)):
        if value:
            df = df.where(F.col(name) == value)
    if text:
        df = df.where(F.col("company_id").cast("string").contains(text) | F.coalesce(
            F.col("group_id").contains(text), F.lit(False)))
    return df


def page(df: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    """One page of a sorted listing, NULLs last, ties by company."""
    c, asc = PAGE_ORDERS.get(order, PAGE_ORDERS["score"])
    key = F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last()
    return df.orderBy(key, "company_id").offset(offset).limit(limit)


def alert_feed(t: Treasury, leads: DataFrame) -> DataFrame:
    """Alerts as a feed: direction, months ahead of the detected event, message, company attributes."""
    attrs = company_master(t).select("company_id", "group_id", "size_cohort", "country")
    a = alerts(t).join(attrs, "company_id").join(leads, "company_id", "left")
    cap = F.concat(F.upper(F.substring("alert", 1, 1)), F.lower(F.substring("alert", 2, 100)))
    return a.select(
        F.concat_ws("-", "company_id", "T").alias("id"), "company_id",
        F.when(F.col("severity") == 0, "improving").otherwise("slipping").alias("kind"),
        F.round("health_smooth", 1).alias("score"), F.round(F.coalesce("health_delta_3m", F.lit(0.0)), 1).alias("delta"),
        F.col("lead_months").alias("months_ahead"),
        F.when(F.coalesce("why", F.lit("")) != "", F.concat(cap, F.lit(": "), F.col("why"))).otherwise(cap).alias("message"),
        F.concat("T", F.lit("-01T08:00:00Z")).alias("created_at"), F.col("alert").alias("signal"), "severity",
        F.round(F.coalesce("health_delta_1m", F.lit(0.0)), 1).alias("delta1m"), F.coalesce("why", F.lit("")).alias("why"),
        "group_id", "size_cohort", "country")


def run_summary(t: Treasury) -> DataFrame:
    """Size of the run and counts at the newest month as (metric, key, n)."""
    sc, now = scored(t), at_latest(scored(t))
    parts = [sc.agg(F.countDistinct("company_id").alias("n")).select(F.lit("companies").alias("metric"), F.lit("all").alias("key"), "n"),
             sc.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("metric"), F.lit("all").alias("key"), "n")]
    for m, c in (("band", "health_band"), ("trajectory", "trajectory")):
        parts.append(now.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("metric"), "key", "n"))
    flags = now.agg(*[count_if(F.col(f"is_{c}")).alias(c) for c in ("exceptional", "structural", "blip")])
    parts.append(flags.unpivot([], ["exceptional", "structural", "blip"], "key", "n").select(F.lit("flag").alias("metric"), "key", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
