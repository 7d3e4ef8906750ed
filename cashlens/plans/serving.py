"""Queries: served tables, portfolio, alerts, benchmarks, providers, explanations, anticipation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.functions.exprs import risk_band
from cashlens.operators import anticipation as an, explain as ex, providers as pv, serve as sv
from cashlens.operators.labels import group_holdout
from cashlens.operators.panel import panel
from cashlens.operators.scorecard import WEIGHTS, contributions, scored
from cashlens.functions.wording import dictionary, with_text
from cashlens.plans.registry import query, shape
from cashlens.sources.staging import staged

T_MIN = 8           # first month scored out of sample
LEVERS = "score:6 score_raw:6 score_A:6"
SERIES = "health health_smooth health_delta_1m health_delta_3m trajectory is_blip is_structural is_exceptional health_band alert"
PORT = ("company_id score:1 band trend delta3m:1 delta1m:1 held_out top_driver health_band trajectory signal "
        "p_deterioration:4 group_id size_cohort country erp main_bank")
ALERT = "company_id T alert severity:i health_smooth health_delta_1m health_delta_3m trajectory why"
CELL = "T size_cohort country_group group_bucket kpi"
PROV = ("bank_name kind services companies:i products:i n_risk:i n_watch:i n_healthy:i n_solid:i mean_health:4 risk_share:6 "
        "slipping:i improving:i granted:2 outstanding:2")
EVENT = "company_id event_month alert_month lead_months:i health_at_event health_6m_before"
SPECS = {
    "risk_score": f"company_id T {LEVERS} percentile:6 percentile_cohort:6 band delta_1m:6 is_out_of_sample {SERIES} realized_label:i realized_D:5",
    "pct_rank_avg": "company_id T percentile:6 percentile_cohort:6", "delta_1m": "company_id T delta_1m:6",
    "risk_band": "company_id T band", "last_row": "company_id score:6 T",
    "company_master": "company_id group_id country currency erp main_bank group_size:i n_bank_accounts:i n_banks:i n_debt_products:i "
                      "debt_granted_total_log:6 size_cohort has_invoices first_month last_month months_in_panel:i created_at "
                      "latest_score:6 latest_band latest_delta_1m:6 latest_percentile:6 latest_health latest_health_band latest_trajectory is_test_company",
    "company_kpi": "company_id T " + " ".join(f"{c}:6" for c in sv.KPI_COLS if not c.endswith("_log"))
                   + " cash_balance:2 inflow_oper:2 outflow_oper:2 outcome_late_pay_rate:6 outcome_neg_cash_share:6 "
                   "outcome_collection_drop:6 outcome_credit_util:8 outcome_inactivity:6",
    "alerts": ALERT, "alert_order": ALERT, "alert_why": "company_id why",
    "alert_filter": "id company_id kind score:1 delta:1 months_ahead:i message created_at signal severity:i delta1m:1 why group_id size_cohort country",
    "benchmark": f"{CELL} n:i p25:8 p50:8 p75:8", "j_fallback": f"company_id {CELL} value:6 fallback n:i p25:8 p50:8 p75:8",
    "benchmark_position": "company_id kpi value:6 position", "cohort_cells": "company_id T country_group group_bucket",
    "portfolio_rows": PORT, "portfolio_filter": PORT, "portfolio_order": PORT, "watch_row": "company_id",
    "portfolio_history": "T solid:i healthy:i watch:i risk:i mean_health:4",
    "portfolio_counts": "healthy:i stable:i risk:i improving:i slipping:i held_out:i",
    "score_distribution": "kind key n:i mean_score:10 n_high:i", "signal_counts": "what key n:i",
    "connector_counts": "what name n:i", "run_summary": "metric key n:i", "latest_month": "T",
    "company_filter": "company_id group_id score:6 band trajectory health_band country",
    "page_companies": "company_id score:6 health_smooth health_delta_3m total:i",
    "company_lookup": "company_id T score:6 percentile:6 band health_smooth group_id country cash_months_of_outflow:6 io_ratio_w3:6",
    "movers": "what company_id score:1 delta3m:1 signal", "top_driver": "company_id top_driver",
    "held_out_flag": "company_id held_out", "compact_rows": "company_id score:1 health_band trajectory delta3m:1 delta1m:1 signal p_deterioration:4 size_cohort group_id main_bank erp",
    "provider_rollup": PROV, "provider_filter": PROV, "provider_order": PROV, "provider_kind": "bank_name kind",
    "provider_types": "bank_name type n:i", "provider_totals": "providers:i connectors:i products:i companies:i",
    "provider_companies": "bank_name company_id rank:i score:1 products:i granted:2 outstanding:2",
    "j_company_provider": "company_id providers:i products:i outstanding:2",
    "contrib": "company_id T feature block value:6 phi:8", "contrib_global": "feature block mean_abs:6 block_share:6 behavioural_share:6",
    "contrib_local": "company_id T rank:i feature block phi:8 direction text", "top_contrib": "company_id T rank:i feature phi:8",
    "contrib_change": "company_id T T_prev rank:i feature block delta_phi:8 direction before after",
    "change_rank": "company_id T rank:i feature delta_phi:8", "driver_points": "company_id T rank:i feature text impact:4 sense since",
    "streak_since": "company_id T feature direction since", "actionable": "company_id T feature text", "drags": "company_id T rank:i feature text impact:4 block metric_id",
    "reasons_top3": "company_id why", "describe": "company_id T feature text", "j_lookup_text": "feature label unit n:i",
    "event_detect": EVENT, "alert_lead": "company_id event_month alert_month lead_months:i", "union_events": EVENT,
    "last_event": "company_id alert_month event_month lead_months:i", "false_alert": "company_id crossing_month is_false",
    "band_flip": "company_id T reverted",
    "anticipation_summary": "n_events:i n_anticipated:i n_detected:i lead_median:4 lead_mean:4 lead_p25:4 lead_p75:4 health_drop_mean:4 "
                            "n_alert_windows:i false_alert_rate:6 n_band_changes:i band_flip_rate:6 share_of_detected:6 share_of_all:6 share_detected:6",
    "lead_distribution": "lead_months:i n:i",
}
DESCRIBED = ["debt_granted_total", "n_tx_w3_log", "country_missing", "reconciled_delta_w3_w12", "credit_util_T", "pay_dpd_mean_w6",
             "io_ratio_w3", "months_since_last_invoice"]
_Q = {}


def q(name):
    def wrap(fn):
        query(name)(lambda t: shape(fn(t), SPECS[name]))
        return fn
    return wrap


for _n in ("risk_score", "pct_rank_avg", "delta_1m"):
    q(_n)(sv.risk_score if _n == "risk_score" else sv.risk)
q("risk_band")(lambda t: scored(t).withColumn("band", risk_band("score")))
q("last_row")(lambda t: sv.last_row(scored(t), F.col("score"), F.col("T")))
q("company_master")(lambda t: sv.company_master(t).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd")))
q("company_kpi")(sv.company_kpi)
q("alerts")(sv.alerts)
q("alert_order")(lambda t: sv.alert_order(sv.alerts(t)))
q("alert_why")(sv.alerts)


def _events(t):
    return staged(t, "events", lambda: an.events(an.with_series(an.bad_months(t), scored(t)), t.cfg, T_MIN))


def _feed(t):
    return sv.alert_feed(t, an.last_event(_events(t)).select("company_id", "lead_months"))


q("alert_filter")(lambda t: sv.search(_feed(t).where(F.col("signal").isin(
    "caída estructural", "caída brusca este mes", "deterioro incipiente", "mejora progresiva")), "", "company_id", "group_id"))
SPECS["alert_feed"] = SPECS["alert_filter"]
q("alert_feed")(_feed)
q("benchmark")(sv.benchmark)
SPECS["union_benchmarks"] = SPECS["benchmark"]
q("union_benchmarks")(sv.benchmarks)
q("j_fallback")(sv.company_benchmark)
q("benchmark_position")(lambda t: sv.benchmark_position(sv.company_benchmark(t)))
q("cohort_cells")(lambda t: sv.cohort_cells(scored(t), t))
q("portfolio_rows")(sv.portfolio_rows)
q("portfolio_filter")(lambda t: sv.portfolio_filter(sv.portfolio(t), band="vigilar", text="1"))
q("portfolio_order")(lambda t: sv.portfolio_order(sv.portfolio(t)))
q("watch_row")(lambda t: sv.portfolio(t).where((F.col("band") == "healthy") & (F.col("trend") == "down")))
q("portfolio_history")(sv.portfolio_history)
q("portfolio_counts")(lambda t: sv.portfolio_counts(sv.portfolio(t)))
q("score_distribution")(sv.score_distribution)
q("signal_counts")(lambda t: sv.alerts(t).groupBy(F.col("alert").alias("key")).agg(F.count(F.lit(1)).alias("n"))
                   .select(F.lit("signal").alias("what"), "key", "n").unionByName(
    pv.rollup(t).groupBy(F.col("kind").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kind").alias("what"), "key", "n")))
q("connector_counts")(lambda t: pv.connector_counts(pv.rollup(t), sv.portfolio(t)))
q("run_summary")(sv.run_summary)
q("latest_month")(lambda t: scored(t).agg(F.max("T").alias("T")))
q("company_filter")(lambda t: sv.list_companies(t, band="medio", text="1"))


@q("page_companies")
def _page(t):
    df = sv.list_companies(t)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return sv.page(df, "health_delta", 20, 5).crossJoin(F.broadcast(total))     # a single row


q("company_lookup")(lambda t: sv.risk(t).join(scored(t).select("company_id", "T", "cash_months_of_outflow", "io_ratio_w3"), ["company_id", "T"])
                    .join(sv.company_master(t).select("company_id", "group_id", "country"), "company_id"))


@q("movers")
def _movers(t):
    p, cols = sv.portfolio(t), ["company_id", "score", "delta3m", "signal"]
    parts = {"fall": [F.asc("delta3m")], "rise": [F.desc("delta3m")], "low": [F.asc("score")]}
    out = [p.orderBy(*o, "company_id").limit(8).select(F.lit(k).alias("what"), *cols) for k, o in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


q("top_driver")(lambda t: ex.top_driver(sv.at_latest(sv.explanations(t))))
q("held_out_flag")(lambda t: sv.held_out_flag(t.table("companies", "company_id"), t))
q("compact_rows")(sv.portfolio)
q("provider_rollup")(pv.rollup)
q("provider_filter")(lambda t: pv.provider_filter(pv.rollup(t), kind="banco", relevant=True, financing=True, text="svc_1"))
q("provider_order")(lambda t: pv.provider_order(pv.rollup(t), "risk"))
q("provider_kind")(lambda t: pv.provider_kinds(pv.products(t)))
q("provider_types")(lambda t: pv.provider_types(pv.products(t), sv.portfolio(t)))
q("provider_totals")(lambda t: pv.provider_totals(pv.products(t), sv.portfolio(t)))
q("provider_companies")(lambda t: pv.lowest_companies(pv.company_rows(pv.products(t), sv.portfolio(t))))
q("j_company_provider")(lambda t: pv.company_providers(pv.products(t), sv.portfolio(t)))
q("contrib")(contributions)
q("contrib_global")(lambda t: ex.global_importance(contributions(t)))
q("contrib_local")(lambda t: ex.local(contributions(t), t.cfg))
q("top_contrib")(lambda t: ex.top_features(contributions(t), "phi", 3))
q("contrib_change")(lambda t: ex.changes(contributions(t)))
q("change_rank")(sv.change_explanations)
q("driver_points")(lambda t: ex.drivers(sv.explanations(t)))
q("streak_since")(lambda t: ex.with_streak(sv.explanations(t), sv.explanations(t).select("company_id", "T").distinct()))
q("actionable")(lambda t: ex.actionable(sv.explanations(t)))
q("drags")(lambda t: ex.drags(contributions(t)))
q("reasons_top3")(lambda t: sv.at_latest(ex.why(sv.explanations(t), F.concat(
    F.when(F.col("phi") > 0, "↑ ").otherwise("↓ "), F.col("text")), 3)))


@q("describe")
def _describe(t):
    rows = scored(t).select("company_id", "T", *[F.col(c).cast("double").alias(c) for c in DESCRIBED]).unpivot(
        ["company_id", "T"], DESCRIBED, "feature", "value")
    return with_text(rows)


@q("j_lookup_text")
def _lookup(t):
    d = F.broadcast(dictionary(t.spark).select("feature", "label", "unit"))    # one row per feature
    return sv.explanations(t).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).join(d, "feature", "left")


q("event_detect")(_events)
q("alert_lead")(_events)


@q("union_events")
def _union_events(t):
    ids = group_holdout(t).select("company_id")
    return _events(t).join(ids, "company_id", "left_anti").unionByName(_events(t).join(ids, "company_id", "left_semi"))


q("last_event")(lambda t: an.last_event(_events(t)))
q("false_alert")(lambda t: an.false_alerts(an.with_series(an.bad_months(t), scored(t)), t.cfg, T_MIN))
q("band_flip")(lambda t: an.band_flips(an.with_series(an.bad_months(t), scored(t)), t.cfg, T_MIN))
q("lead_distribution")(lambda t: an.lead_distribution(_events(t)))


@q("anticipation_summary")
def _summary(t):
    m = an.with_series(an.bad_months(t), scored(t))
    return an.summary(_events(t), an.false_alerts(m, t.cfg, T_MIN), an.band_flips(m, t.cfg, T_MIN))
