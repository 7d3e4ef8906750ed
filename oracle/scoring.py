"""SQL of label and health queries."""

from cashlens.plans.scoring import COMPS, SPECS
from oracle import shape
import oracle.scored  # noqa: F401

SQL = {
    "group_holdout": shape("reserved", SPECS["group_holdout"]),
    "label_components": shape("lab_comp", SPECS["label_components"]),
    "cohort_z": shape("label_rows", SPECS["cohort_z"]),
    "label_index": shape("label_rows", SPECS["label_index"]),
    "label_profile": shape("(" + " UNION ALL ".join(
        ["SELECT 'positive_rate' AS metric, 'all' AS key, avg(y) AS value FROM label_rows",
         "SELECT 'positive_rate_reserved', 'all', avg(y) FROM label_rows WHERE is_reserved",
         "SELECT 'positive_rate_month', T, avg(y) FROM label_rows GROUP BY T"]
        + [f"SELECT 'availability', '{c}', avg(CASE WHEN {c} IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FROM label_rows" for c in COMPS]
        + [f"SELECT 'correlation', '{c}', corr({c}, D) FROM label_rows" for c in COMPS]) + ")", SPECS["label_profile"]),
}
SQL |= {n: shape("sc_scored", SPECS[n]) for n in ("add_health", "ema", "trajectory", "blip", "structural", "exceptional",
                                                  "health_band", "alert_rule")}
