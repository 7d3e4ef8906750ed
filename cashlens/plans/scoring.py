"""Queries: reserved groups, labels, health series."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.operators import labels as lb
from cashlens.operators.scorecard import scored
from cashlens.plans.registry import query, shape

COMPS = "late_pay_rate neg_cash_share collection_drop credit_util inactivity".split()
SPECS = {
    "group_holdout": "company_id group_id",
    "label_components": "company_id T t_idx:i " + " ".join(f"{c}:6" for c in COMPS) + " size_outflow_6m:4",
    "cohort_z": "company_id T size_cohort is_reserved " + " ".join(f"z_{c}:5" for c in COMPS),
    "label_index": "company_id T size_cohort n_components:i D:5 threshold:5 y:i",
    "label_profile": "metric key value:5",
    "add_health": "company_id T score:6 health health_smooth health_delta_1m health_delta_3m trajectory is_blip "
                  "is_structural is_exceptional health_band alert",
    "ema": "company_id T health health_smooth",
    "trajectory": "company_id T health_delta_1m health_delta_3m trajectory",
    "blip": "company_id T is_blip", "structural": "company_id T is_structural", "exceptional": "company_id T is_exceptional",
    "health_band": "company_id T health_band", "alert_rule": "company_id T alert",
}
query("group_holdout")(lambda t: shape(lb.group_holdout(t), SPECS["group_holdout"]))
query("label_components")(lambda t: shape(lb.label_components(t), SPECS["label_components"]))
for _n in ("cohort_z", "label_index"):
    query(_n)(lambda t, n=_n: shape(lb.labels(t), SPECS[n]))
query("label_profile")(lambda t: shape(lb.label_profile(t), SPECS["label_profile"]))
for _n in ("add_health", "ema", "trajectory", "blip", "structural", "exceptional", "health_band", "alert_rule"):
    query(_n)(lambda t, n=_n: shape(scored(t), SPECS[n]))
