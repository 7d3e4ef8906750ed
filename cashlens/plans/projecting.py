"""Queries: evaluation figures, calibration, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.functions.exprs import platt, shift_month
from cashlens.functions.ranking import percent_rank_avg
from cashlens.operators import anticipation as an, evaluation as ev, projection as pj, serve as sv
from cashlens.operators.labels import labels
from cashlens.operators.panel import feature_sets
from cashlens.operators.scorecard import CALIBRATION, scored
from cashlens.plans.registry import query, shape
from cashlens.plans.serving import _events
from cashlens.sources.staging import staged

EVAL_FROM = 15          # last two labelled months
ZCOLS = [f"z_{c}" for c in "late_pay_rate neg_cash_share collection_drop credit_util inactivity".split()]
SPECS = {
    "auc_pr": "model auc_pr:6", "auc_roc": "model auc_roc:6", "brier": "model n:i positives:i brier:6 base_rate:6",
    "topk_month": "T precision_k:6 recall_k:6 recall_top10:6", "calib_curve": "bin_lo:4 bin_hi:4 n:i pred_mean:10 obs_rate:6",
    "pr_points": "threshold:6 precision:6 recall:6", "rate_by_band": "kind key share:6 n:i",
    "confusion_profile": "cls n:i " + " ".join(f"{z}:4" for z in ZCOLS) + " has_invoices:6 months_in_panel:4 n_debt_products:4 share_q1:6 share_q2:6 share_q3:6 share_q4:6",
    "fn_dominant": "component n:i", "train_set": "company_id T score:6 y:i D:5", "platt": "company_id T score:6",
    "evidence": "spearman:6 improving_ok:6 blips:i structural:i n_detected:i lead_p25:4 lead_median:4 lead_p75:4",
    "eval_held_out": "metric value:6", "folds": "fold train_max:i eval_from:i eval_to:i n_train:i n_eval:i",
    "future_path": "company_id t_idx:i level surprise d1 d3 delta1 delta6",
    "traj_pool": "n:i s_level:6 s_surprise:6 s_d1:6 s_d3:6", "j_knn": "company_id t_idx:i n:i sum_dist:4 max_dist:6 sum_rank_id:i",
    "knn_kernel": "company_id t_idx:i bw:6 max_weight:6 n_eff:4",
    "fan_quantiles": "company_id t_idx:i h:i low:5 median:5 high:5 n_companies:i prob_drop5:5 prob_risk:5",
    "ols_fan": "company_id t_idx:i h:i low:9 median:9 high:9", "fan_backtest": "method by key n:i coverage:6 mae:5 width:5",
    "forecast_row": "company_id month h:i low:4 median:4 high:4 stability note detected_at evident_at months_ahead:i",
    "fan_shift": "company_id h:i low:1 median:1 high:1",
}


def q(name):
    def wrap(fn):
        query(name)(lambda t: shape(fn(t), SPECS[name]))
        return fn
    return wrap


def rows(t):
    """Labelled, scored rows of companies that are not reserved."""
    lab = labels(t).where(~F.col("is_reserved")).select("company_id", "T", "y", "D", *ZCOLS)
    s = scored(t).select("company_id", "T", "t_idx", "score", "score_A", "health_smooth", "health_band", "trajectory",
                         "is_exceptional", "has_invoices", "months_in_panel", "n_debt_products", "size_cohort")
    return s.join(lab, ["company_id", "T"])


def holdout(t):
    return rows(t).where(F.col("t_idx") >= EVAL_FROM)


def two_models(t):
    return holdout(t).select("company_id", "T", "y", F.inline(F.array(
        F.struct(F.lit("A").alias("model"), F.col("score_A").alias("p")), F.struct(F.lit("B").alias("model"), F.col("score").alias("p")))))


q("auc_pr")(lambda t: ev.auc_pr(two_models(t), "p", ["model"]))
q("auc_roc")(lambda t: ev.auc_roc(two_models(t), "p", ["model"]))
q("brier")(lambda t: ev.brier(two_models(t), "p", ["model"]))
q("topk_month")(lambda t: ev.topk_month(holdout(t), "score", 50))
q("calib_curve")(lambda t: ev.calibration_curve(rows(t), "score"))
q("pr_points")(lambda t: ev.pr_points(holdout(t), "score"))
q("platt")(lambda t: scored(t).select("company_id", "T", platt("score_raw", *CALIBRATION).alias("score")))
q("train_set")(rows)


def reserved_rows(t):
    s = scored(t).select("company_id", "T", "score", "score_A", "health", "health_smooth", "health_band", "trajectory", "is_exceptional")
    return s.join(labels(t).where("is_reserved").select("company_id", "T", "y", "D"), ["company_id", "T"])


@q("rate_by_band")
def _rates(t):
    r = rows(t)
    return (ev.rate_by(r, "band", F.col("health_band")).unionByName(ev.rate_by(r, "trajectory", F.col("trajectory")))
            .unionByName(ev.rate_by(r.where("is_exceptional"), "exceptional", F.lit("all"))))


q("confusion_profile")(lambda t: ev.class_profile(ev.confusion(holdout(t), "score"), ZCOLS))
q("fn_dominant")(lambda t: ev.confusion(holdout(t), "score").where(F.col("cls") == "FN")
                 .groupBy(ev.dominant(None, ZCOLS).alias("component")).agg(F.count(F.lit(1)).alias("n")))


@q("evidence")
def _evidence(t):
    r = percent_rank_avg(percent_rank_avg(reserved_rows(t), [], "health", "rh"), [], "D", "rd")
    rho = r.agg((-F.corr("rh", "rd")).alias("spearman"))
    up = (scored(t).select("company_id", "T", "trajectory").join(labels(t).select("company_id", "T", "y"), ["company_id", "T"])
          .where(F.col("trajectory") == "mejorando").agg(F.avg(1.0 - F.col("y")).alias("improving_ok")))
    now = sv.at_latest(scored(t)).agg(F.sum(F.col("is_blip").cast("int")).alias("blips"), F.sum(F.col("is_structural").cast("int")).alias("structural"))
    lead = _events(t).agg(F.count("lead_months").alias("n_detected"), *[
        F.percentile("lead_months", p).alias(n) for n, p in (("lead_p25", .25), ("lead_median", .5), ("lead_p75", .75))])
    return rho.crossJoin(up).crossJoin(now).crossJoin(lead)           # single rows


@q("eval_held_out")
def _held(t):
    r = reserved_rows(t)
    parts = [ev.auc_roc(r, "score").select(F.lit("auc_roc_B").alias("metric"), F.col("auc_roc").alias("value")),
             ev.auc_roc(r, "score_A").select(F.lit("auc_roc_A").alias("metric"), F.col("auc_roc").alias("value")),
             ev.auc_pr(r, "score").select(F.lit("auc_pr_B").alias("metric"), F.col("auc_pr").alias("value")),
             ev.auc_pr(r, "score_A").select(F.lit("auc_pr_A").alias("metric"), F.col("auc_pr").alias("value")),
             ev.auc_roc(r.withColumn("risk", -F.col("health_smooth")), "risk").select(
                 F.lit("auc_roc_health").alias("metric"), F.col("auc_roc").alias("value")),
             r.agg(F.avg("y").alias("value")).select(F.lit("base_rate").alias("metric"), "value"),
             ev.auc_roc(r, "score", ["T"]).select(F.concat(F.lit("auc_roc_"), "T").alias("metric"), F.col("auc_roc").alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@q("folds")
def _folds(t):
    from cashlens.operators.model import temporal_folds
    folds = temporal_folds(t.cfg, t.cfg.last_label_idx)
    r = rows(t)
    out = None
    for f in folds:
        tr, e = F.col("t_idx") <= f["train_max"], F.col("t_idx").between(f["eval"][0], f["eval"][-1])
        one = r.agg(F.count(F.when(tr, 1)).alias("n_train"), F.count(F.when(e, 1)).alias("n_eval")).select(
            F.lit(f["name"]).alias("fold"), F.lit(f["train_max"]).alias("train_max"), F.lit(f["eval"][0]).alias("eval_from"),
            F.lit(f["eval"][-1]).alias("eval_to"), "n_train", "n_eval")
        out = one if out is None else out.unionByName(one)
    return out


# ----------------------------------------------------------------------------------- projection
def states(t):
    return staged(t, "states", lambda: pj.states(scored(t)))


def targets(t):
    return states(t).join(F.broadcast(states(t).agg(F.max("t_idx").alias("t_idx"))), "t_idx", "left_semi")


def fans(t):
    return staged(t, "fans", lambda: pj.fan(pj.kernel(neighbours(t)), targets(t)))


def neighbours(t):
    return staged(t, "neighbours", lambda: pj.neighbours(targets(t), pj.pool(states(t)), t.cfg.n_months))


q("future_path")(lambda t: pj.pool(states(t)).withColumns({"delta1": F.element_at("delta", 1), "delta6": F.element_at("delta", 6)}))
q("traj_pool")(lambda t: pj.pool_scale(pj.pool(states(t))).crossJoin(pj.pool(states(t)).agg(F.count(F.lit(1)).alias("n"))))   # single rows
q("j_knn")(lambda t: pj.neighbours(targets(t), pj.pool(states(t)), t.cfg.n_months).groupBy("company_id", "t_idx").agg(
    F.count(F.lit(1)).alias("n"), F.sum("dist").alias("sum_dist"), F.max("dist").alias("max_dist"),
    F.sum(F.col("rank") * (F.col("p_company_id") * 24 + F.col("p_t_idx"))).alias("sum_rank_id")))
q("knn_kernel")(lambda t: pj.kernel(neighbours(t)).groupBy("company_id", "t_idx").agg(
    F.max("bw").alias("bw"), F.max("weight").alias("max_weight"), (1 / F.sum(F.pow("weight", 2.0))).alias("n_eff")))
q("fan_quantiles")(lambda t: pj.fan(pj.kernel(neighbours(t)), targets(t)))
q("ols_fan")(lambda t: pj.line_fan(scored(t)))


@q("fan_backtest")
def _backtest(t):
    st = states(t)
    ids = labels(t).where("is_reserved").select("company_id").distinct()
    train = pj.pool(st).join(ids, "company_id", "left_anti")
    test = pj.pool(st).join(ids, "company_id", "left_semi")
    f = pj.fan(pj.kernel(pj.neighbours(test, train, t.cfg.n_months)), test)
    return pj.backtest(f, pj.line_fan(scored(t)).join(ids, "company_id", "left_semi"), test)


@q("forecast_row")
def _forecast(t):
    last = sv.at_latest(pj.verdict(scored(t))).select("company_id", "T", "stability", "note")
    det = an.last_event(_events(t)).select("company_id", F.col("alert_month").alias("detected_at"),
                                           F.col("event_month").alias("evident_at"), F.col("lead_months").alias("months_ahead"))
    return (fans(t).join(last, "company_id").join(det, "company_id", "left")
            .withColumn("month", shift_month("T", F.col("h"))))


@q("fan_shift")
def _shift(t):
    key = F.col("h")
    moved = {c: pj.shift(F.array(F.round(c, 1)), -2.5)[0].alias(c) for c in ("low", "median", "high")}
    return fans(t).select("company_id", key, *moved.values())
