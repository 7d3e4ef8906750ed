"""Queries: metrics, levers, decisions, what-if grids, plans, scenarios, text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.operators import decisions as dc, explain as ex, narrative as nv, serve as sv
from cashlens.operators.panel import CATEGORICAL, FEATURES, NUMERIC
from cashlens.operators.scorecard import contributions, scored
from cashlens.plans.registry import query, shape
from cashlens.sources.staging import staged

SPECS = {
    "metric_values": "company_id T dso:6 dpo:6 ccc:6 dscr:6 cash_days:6 credit_usage:8 concentration:6",
    "metric_status": "company_id metric_id unit value:3 reference:3 status",
    "slider_range": "company_id metric_id lo:4 hi:4", "lever_overrides": "company_id metric_id feature new_value:6",
    "decisions": "company_id lever metric_id current_value:3 target_value:3 cash_impact:0 score_impact:1",
    "decision_order": "company_id rank:i lever cash_impact:0 score_impact:1",
    "whatif_grid": "company_id metric_id i:i value:4 score_delta:1 cash_delta:0",
    "grid_interp": "company_id metric_id score_delta:1 cash_delta:0",
    "plan_rescore": "company_id metric_id current:6 target:3 marginal:4 base_health:4 plan_health:4",
    "plan_additive": "company_id score_delta:1 plan_health:1", "plan_ceiling": "company_id plan_health:1 margin:1 ceiling:1",
    "scenario_rescore": "company_id scenario before:4 after:4", "j_scenario": "company_id scenario feature new_value:6",
    "feature_frame": "company_id " + " ".join(f"{f}:6" for f in NUMERIC) + " country currency erp_any main_bank size_cohort", "except_features": "company_id unknown",
    "number_grounding": "doc_id n_numbers:i is_grounded", "insight_validate": "company_id n_insights:i first_title",
}


def q(name):
    def wrap(fn):
        query(name)(lambda t: shape(fn(t), SPECS[name]))
        return fn
    return wrap


def now(t):
    """Newest row of every company."""
    return sv.last_row(scored(t), *[c for c in scored(t).columns if c not in ("company_id", "t_idx")])


def status(t):
    return staged(t, "metric_status", lambda: dc.metric_status(scored(t)))


def grid(t):
    return staged(t, "whatif_grid", lambda: dc.whatif_grid(now(t), status(t)))


q("metric_values")(lambda t: scored(t).select("company_id", "T", *[v.alias(m) for m, v in dc.metric_values().items()]))
q("metric_status")(lambda t: dc.metric_status(scored(t)))


@q("slider_range")
def _slider(t):
    lo, hi = dc.slider_range(F.col("value"), F.col("reference"))
    return status(t).withColumns({"lo": lo, "hi": hi})


q("lever_overrides")(lambda t: dc.override_rows(now(t).join(dc.default_targets(status(t)), "company_id")))
q("decisions")(lambda t: dc.decisions(now(t), status(t)))
q("decision_order")(lambda t: dc.decision_order(dc.decisions(now(t), status(t))))
q("whatif_grid")(lambda t: dc.whatif_grid(now(t), status(t)))
q("grid_interp")(lambda t: dc.grid_interp(grid(t), dc.default_targets(status(t))))
q("plan_rescore")(lambda t: dc.plan_rescore(now(t), dc.default_targets(status(t))))
q("plan_additive")(lambda t: dc.plan_additive(dc.grid_interp(grid(t), dc.default_targets(status(t))), sv.portfolio(t)))
q("plan_ceiling")(lambda t: dc.plan_ceiling(
    dc.plan_rescore(now(t), dc.default_targets(status(t))),
    ex.drags(sv.at_latest(contributions(t))).withColumn("impact", F.round("impact", 1)), dc.default_targets(status(t))))
q("scenario_rescore")(lambda t: dc.scenario_rescore(now(t)))
q("j_scenario")(lambda t: dc.scenario_vectors(now(t)))


def payloads(t):
    """Feature payloads as text maps: every feature, one bad number, missing categories, one unknown key."""
    texts = {f: F.col(f).cast("string") for f in (*NUMERIC, *CATEGORICAL)}
    texts["hhi_in"] = F.when(F.col("company_id") % 4 == 0, "n/a").otherwise(texts["hhi_in"])
    texts["country"] = F.when(F.col("country") != "UNK", F.col("country"))
    known = F.map_from_arrays(F.array(*[F.lit(f) for f in texts]), F.array(*texts.values()))
    return now(t).select("company_id", F.map_concat(known, F.when(F.col("company_id") % 3 == 0, F.create_map(F.lit("zz_extra"), F.lit("EUR")))
                                                    .otherwise(F.expr("cast(map() as map<string,string>)"))).alias("payload"))


def frame(df, numeric, categorical):
    """Typed features of a payload: bad or missing numbers NULL, missing categories UNK."""
    return df.select("company_id", *[F.col("payload")[f].try_cast("double").alias(f) for f in numeric],
                     *[F.coalesce(F.col("payload")[f], F.lit("UNK")).alias(f) for f in categorical])


q("feature_frame")(lambda t: frame(payloads(t), NUMERIC, CATEGORICAL))


@q("except_features")
def _unknown(t):
    known = F.array(*[F.lit(f) for f in (*FEATURES, "size_cohort")])
    return payloads(t).select("company_id", F.array_join(F.array_sort(F.array_except(F.map_keys("payload"), known)), ",").alias("unknown"))


@q("number_grounding")
def _grounding(t):
    d = t.source("documents")
    digest = F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"),
                         F.size(F.split("text", " ")).cast("string"), F.lit("3 7,5 0.12 1.250 2024"))
    return d.select("doc_id", F.size(nv.tokens(F.col("text"))).alias("n_numbers"),
                    nv.grounded(F.col("text"), nv.known_values(digest)).alias("is_grounded"))


@q("insight_validate")
def _insights(t):
    """Insights drafted from the newest explanations, checked against all of their texts."""
    e = sv.at_latest(sv.explanations(t))
    kind = F.when(F.col("phi") > 0, "risk").when(F.col("rank") % 5 == 0, "praise").otherwise("opportunity")
    sev = F.when(F.abs("phi") > 0.3, "alert").otherwise("watch")
    one = F.struct("rank", kind.alias("kind"), sev.alias("severity"), F.col("text").alias("title"),
                   F.col("direction").alias("explanation"), F.array("text").alias("evidence"))
    g = e.groupBy("company_id").agg(
        F.array_sort(F.collect_list(one)).alias("insights"),           # at most eight per company
        F.concat_ws(" ", F.collect_list("text")).alias("digest"))
    ok = g.withColumn("ok", nv.valid_insights(F.col("insights"), nv.known_values(F.col("digest"))))
    return ok.where(F.col("ok").isNotNull()).select("company_id", F.size("ok").alias("n_insights"),
                                                    F.element_at("ok", 1)["title"].alias("first_title"))
