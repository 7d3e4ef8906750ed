"""Queries: sources, star schema, company-month tables, feature blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashlens.operators import company_month as cm, panel as pn, star
from cashlens.plans.registry import query, shape

KEY = "company_id t_idx:i"
SPECS = {
    "cm_tx": "company_id t_idx:i " + " ".join(
        c + (":2" if c.startswith(("amt_", "inflow", "outflow")) else ":6" if c.endswith("_day_mean") else ":i")
        for c in cm.TX_COLS),
    "cm_cash": "company_id t_idx:i cash_balance:2 cash_min_account:2 n_cash_accounts_neg:i n_cash_accounts:i "
               "credit_drawn:2 credit_granted:2 card_drawn:2",
    "cm_invoice_lag": "company_id t_idx:i is_payable lag:i n:i amt:2 dpd_mean:6 dpd_p50:6 dpd_p90:6 bad_share:6 "
                      "open_overdue_share:6 amt_open_overdue:2 amt_open:2 max_open_dpd:i term_days_mean:6",
    "cm_invoice_issued": "company_id t_idx:i n_inv_issued:i n_inv_payable:i n_inv_receivable:i amt_inv_payable:2 "
                         "amt_inv_receivable:2 n_inv_no_counterparty:i n_inv_stress_terms:i n_inv_counterparties:i",
    "cm_invoice_outcome": "company_id t_idx:i is_payable n_classifiable:i n_bad:i amt_classifiable:2 amt_bad:2",
    "cm_concentration": "company_id t_idx:i inflow_res:2 outflow_res:2 hhi_in:6 hhi_out:6 top1_in_share:6 "
                        "top1_out_share:6 n_cp_in:i n_cp_out:i n_cp_in_prev:i n_cp_in_lost:i cp_in_churn:6",
}


def _digits(feature: str) -> str:
    return f"{feature}:8" if feature.startswith("credit_util") else f"{feature}:6"


for _b in "ABCDEF":
    SPECS[f"feat_{_b}"] = f"{KEY} T " + " ".join(_digits(f) for f in pn.BLOCKS[_b])
SPECS["feat_A"] += " country currency erp_any"
SPECS["feat_E"] += " main_bank"
SPECS["panel_assemble"] = f"{KEY} T size_cohort " + " ".join(
    _digits(f) for f in pn.NUMERIC) + " country currency erp_any main_bank"

for _name in ("cm_tx", "cm_cash", "cm_invoice_lag", "cm_invoice_issued", "cm_invoice_outcome", "cm_concentration"):
    query(_name)(lambda t, n=_name: shape(getattr(cm, n)(t), SPECS[n]))
for _b in "ABCDEF":
    query(f"feat_{_b}")(lambda t, b=_b: shape(
        pn.panel(t, [f for f in pn.FEATURES if pn.FEATURE_BLOCK[f] == b]), SPECS[f"feat_{b}"]))
query("panel_assemble")(lambda t: shape(pn.panel(t), SPECS["panel_assemble"]))
