"""Dense panel and features in SQL."""

from __future__ import annotations

from oracle.base import cte

WINDOWS = ", ".join(f"w{k} AS (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
                    for k in (1, 3, 6, 12))
WINDOWS += (", wo AS (PARTITION BY company_id ORDER BY t_idx), "
            "wa AS (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def S(x, k): return f"sum({x}) OVER w{k}"
def M(x, k): return f"avg({x}) OVER w{k}"
def SD(x, k): return f"stddev_samp({x}) OVER w{k}"
def div(a, b): return f"(CASE WHEN abs({b}) > 1e-9 THEN ({a}) / ({b}) END)"
def clip(x, lo, hi): return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(({x}), {lo}), {hi}) END)"
def slope(x, k=6): return f"(CASE WHEN regr_count({x}, t_idx) OVER w{k} >= 3 THEN regr_slope({x}, t_idx) OVER w{k} END)"
def l1(x): return f"ln(1 + ({x}))"
def slog(x): return f"(sign({x}) * ln(1 + abs({x})))"


# ------------------------------------------------------------------------------ static profile
cte("static_counts", """
SELECT company_id,
    count(*) FILTER (NOT is_debt AND type = 'checking') AS n_bank_accounts, count(*) FILTER (NOT is_debt AND type = 'card') AS n_cards,
    count(*) AS n_products, count(*) FILTER (is_debt) AS n_debt_products, count(*) FILTER (is_debt AND type = 'loan') AS n_loans,
    count(*) FILTER (is_debt AND type = 'lineofcredit') AS n_credit_lines, count(*) FILTER (is_debt AND type = 'leasing') AS n_leasing,
    count(*) FILTER (is_debt AND type = 'guarantee') AS n_guarantees,
    count(*) FILTER (is_debt AND type IN ('confirming','factoring')) AS n_confirming_factoring,
    count(DISTINCT bank_name) FILTER (bank_name NOT LIKE 'Other%') AS n_banks,
    coalesce(sum(abs(granted)) FILTER (is_debt), 0) AS debt_granted, coalesce(sum(abs(granted)) FILTER (is_debt AND type IN ('loan','mortgage','leasing')), 0) AS loan_granted
FROM dim_product GROUP BY 1""")
cte("bank_rank", """
SELECT company_id, bank_name AS main_bank, n AS main_bank_n FROM (
  SELECT company_id, bank_name, count(*) AS n, row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, bank_name) AS r
  FROM dim_product WHERE bank_name NOT LIKE 'Other%' GROUP BY 1, 2) WHERE r = 1""")
cte("loan_terms", """
SELECT company_id, sum((abs(granted_balance) + 1) * coalesce(rate, 0)) / sum(abs(granted_balance) + 1) AS wavg_interest_rate,
       avg(total_periods) AS total_periods_mean, avg(CASE WHEN interest_type = 'variable' THEN 1.0::DOUBLE ELSE 0 END) AS share_variable_rate
FROM debt_schedule GROUP BY 1""")
cte("static_profile", """
SELECT c.company_id, main_bank, coalesce(n_bank_accounts, 0)::DOUBLE AS n_bank_accounts, coalesce(n_cards, 0)::DOUBLE AS n_cards,
    ln(1 + coalesce(n_products, 0)::DOUBLE) AS n_products_total, coalesce(n_banks, 0)::DOUBLE AS n_banks, main_bank_n / n_products AS main_bank_share,
    coalesce(n_debt_products, 0)::DOUBLE AS n_debt_products, coalesce(n_loans, 0)::DOUBLE AS n_loans, coalesce(n_credit_lines, 0)::DOUBLE AS n_credit_lines,
    coalesce(n_leasing, 0)::DOUBLE AS n_leasing, coalesce(n_guarantees, 0)::DOUBLE AS n_guarantees,
    coalesce(n_confirming_factoring, 0)::DOUBLE AS n_confirming_factoring,
    ln(1 + coalesce(debt_granted, 0)) AS debt_granted_total, ln(1 + coalesce(loan_granted, 0)) AS loan_granted_total,
    wavg_interest_rate, total_periods_mean, share_variable_rate
FROM companies c LEFT JOIN static_counts USING (company_id) LEFT JOIN bank_rank USING (company_id) LEFT JOIN loan_terms USING (company_id)""")

# --------------------------------------------------------------------------- invoice windows
for _side, _flag in (("pay", "is_payable"), ("rec", "NOT is_payable")):
    for _k in (3, 6, 12):
        cte(f"{_side}{_k}", f"""
SELECT company_id, t_idx, sum(n) AS n, sum(dpd_mean * n) / sum(n) AS dpd_mean, sum(dpd_p90 * n) / sum(n) AS dpd_p90,
    sum(bad_share * n) / sum(n) AS bad_share, sum(open_overdue_share * n) / sum(n) AS open_overdue_share,
    sum(term_days_mean * n) / sum(n) AS term_days_mean, {div('sum(amt_open_overdue)', 'sum(amt)')} AS amt_open_overdue_ratio,
    {div('sum(amt_open)', 'sum(amt)')} AS amt_open_ratio, max(max_open_dpd) AS max_open_dpd
FROM cm_invoice_lag WHERE {_flag} AND lag < {_k} GROUP BY 1, 2""")

# --------------------------------------------------------------------------------- dense grid
_flows = ["n_tx", "inflow_oper", "outflow_oper", "inflow_total", "amt_debt_repayment", "n_salary", "n_social_security", "n_tax",
          "amt_salary", "amt_social_security", "amt_tax", "n_interest_charge", "amt_interest_charge", "amt_fee", "n_active_days",
          "n_cash_withdrawal", "n_refund", "n_counterparties", "n_stress_terms", "n_no_counterparty", "n_no_accounting",
          "n_discarded", "n_reconciled", "n_status_pending", "n_uncategorized"]
_issued = ["n_inv_issued", "n_inv_stress_terms", "n_inv_no_counterparty", "n_inv_counterparties"]
_inv = ["n", "dpd_mean", "dpd_p90", "bad_share", "open_overdue_share", "term_days_mean", "amt_open_overdue_ratio",
        "amt_open_ratio", "max_open_dpd"]
cte("cells", """
SELECT c.company_id, c.group_id, c.country, c.currency, c.erp_any, c.created_at, CAST(c.group_size AS DOUBLE) AS group_size,
       g.t_idx, g.T, g.T_next FROM dim_company c CROSS JOIN grid g""")
cte("dense_cash", "SELECT company_id, t_idx, T, cash_balance, n_cash_accounts_neg, credit_drawn, credit_granted, card_drawn "
    "FROM cells LEFT JOIN cm_cash USING (company_id, t_idx)")
cte("dense_tx", "SELECT company_id, t_idx, T, " + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in _flows)
    + ", salary_day_mean, ss_day_mean FROM cells LEFT JOIN cm_tx USING (company_id, t_idx)")
cte("active_from", "SELECT company_id, min(t_idx) AS first_active FROM dense_tx WHERE n_tx > 0 GROUP BY 1")

# rolled and plain features from movements
F1 = {}
for _k in (1, 3, 6):
    for _d in ("inflow", "outflow"):
        F1[f"{_d}_w{_k}_log"] = l1(S(f"{_d}_oper", _k))
for _k in (1, 3, 6, 12):
    F1[f"io_ratio_w{_k}"] = clip(div(S("inflow_oper", _k), S("outflow_oper", _k)), 0, 5)
F1 |= {
    "debt_service_ratio_w6": clip(div(S("amt_debt_repayment", 6), S("inflow_oper", 6)), 0, 5),
    "turnover_out_w12_log": l1(S("outflow_oper", 12)), "turnover_in_w12_log": l1(S("inflow_oper", 12)),
    "net_flow_norm_w3": clip(div(f"{S('inflow_oper', 3)} - {S('outflow_oper', 3)}", S("outflow_oper", 3)), -5, 5),
    "inflow_w3_vs_w12": clip(div(M("inflow_oper", 3), M("inflow_oper", 12)), 0, 5),
    "inflow_vol6": clip(div(SD("inflow_oper", 6), f"({M('inflow_oper', 6)} + 1)"), 0, 5),
    "interest_trend6": slope("n_interest_charge"),
    "interest_amt_ratio_w6": clip(div(S("amt_interest_charge", 6), S("outflow_oper", 6)), 0, 1),
    "fee_amt_ratio_w6": clip(div(S("amt_fee", 6), S("outflow_oper", 6)), 0, 1),
    "n_tx_w1": "n_tx", "n_tx_w3_log": l1(S("n_tx", 3)), "n_tx_w3_vs_w12": clip(div(M("n_tx", 3), M("n_tx", 12)), 0, 5),
    "active_days_w3": S("n_active_days", 3),
    "inactive_months_w6": f"sum(CASE WHEN n_tx = 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w6",
    "cash_withdrawal_share_w6": div(S("n_cash_withdrawal", 6), S("n_tx", 6)),
    "refund_share_w6": div(S("n_refund", 6), S("n_tx", 6)),
    "n_counterparties_w3_mean": M("n_counterparties", 3),
    "stress_terms_n_w3": S("n_stress_terms", 3), "out6": M("outflow_oper", 6), "out3": S("outflow_oper", 3),
    "inflow_total_6": S("inflow_total", 6), "size_outflow_12m": M("outflow_oper", 12),
    "tax_share_of_outflow_w6": clip(div(S("amt_tax", 6), S("outflow_oper", 6)), 0, 1),
    "salary_day_delta": f"{M('salary_day_mean', 3)} - {M('salary_day_mean', 12)}",
}
for _k in (3, 6, 12):
    F1[f"interest_n_w{_k}"] = S("n_interest_charge", _k)
    F1[f"stress_terms_rate_w{_k}"] = div(S("n_stress_terms", _k), S("n_tx", _k))
for _p, _c in (("salary", "salary"), ("ss", "social_security"), ("tax", "tax")):
    F1[f"{_p}_months_share_w6"] = f"CASE WHEN {S('n_' + _c, 12)} > 0 THEN avg(CASE WHEN n_{_c} > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w6 END"
    F1[f"{_p}_amt_ratio_w3_w12"] = clip(div(M("amt_" + _c, 3), M("amt_" + _c, 12)), 0, 5)
    if _p != "tax":
        F1[f"{_p}_day_mean_w3"] = M(f"{_p}_day_mean", 3)
for _c, _n in (("n_no_counterparty", "no_counterparty"), ("n_no_accounting", "no_accounting"), ("n_discarded", "discarded"),
               ("n_reconciled", "reconciled"), ("n_status_pending", "pending_status"), ("n_uncategorized", "uncategorized")):
    F1[f"{_n}_share_w3"] = div(S(_c, 3), S("n_tx", 3))
    if _n in ("no_counterparty", "no_accounting", "reconciled"):
        F1[f"{_n}_delta_w3_w12"] = f"{div(S(_c, 3), S('n_tx', 3))} - {div(S(_c, 12), S('n_tx', 12))}"
cte("tx_monthly", f"""
SELECT *, {clip(div('inflow_oper', 'outflow_oper'), 0, 5)} AS io_m, {l1('inflow_oper')} AS inflow_l, {l1('outflow_oper')} AS outflow_l,
       {l1('n_tx')} AS n_tx_l, {l1('amt_debt_repayment')} AS debt_l, {div('n_stress_terms', 'n_tx')} AS stress_m
FROM dense_tx LEFT JOIN active_from USING (company_id)""")
F1 |= {"io_ratio_trend6": slope("io_m"), "inflow_trend6": slope("inflow_l"), "outflow_trend6": slope("outflow_l"),
       "n_tx_trend6": slope("n_tx_l"), "debt_repayment_trend6": slope("debt_l"), "stress_trend6": slope("stress_m")}
cte("tx_features", "SELECT company_id, t_idx, T, n_tx, inflow_oper, outflow_oper, "
    "coalesce(t_idx >= first_active, FALSE) AS in_panel, "
    "CAST(t_idx - first_active + 1 AS DOUBLE) AS months_in_panel, "
    + ", ".join(f"{e} AS {n}" for n, e in F1.items()) + f" FROM tx_monthly WINDOW {WINDOWS}")

# cash
F2 = {
    "cash_balance_T_log": slog("cash_balance"), "cash_months_of_outflow": clip(div("cash_balance", "out6"), -24, 24),
    "credit_drawn_T_log": l1("CASE WHEN credit_drawn IS NOT NULL THEN greatest(credit_drawn, 0) END"),
    "card_drawn_T_log": l1("CASE WHEN card_drawn IS NOT NULL THEN greatest(card_drawn, 0) END"),
    "cash_trend6": clip(slope("cash_norm"), -10, 10),
    "cash_vol6": clip(div(SD("cash_balance", 6), f"(abs({M('cash_balance', 6)}) + out6 + 1)"), 0, 10),
    "cash_min_w6_norm": clip(div("min(cash_balance) OVER w6", "(out6 + 1)"), -24, 24),
    "n_cash_accounts_neg_T": "CAST(n_cash_accounts_neg AS DOUBLE)",
    "days_of_cash": clip(div("cash_balance", "(out3 / 90 + 1)"), -365, 365),
    "credit_util_trend6": slope("credit_util_T"), "credit_util_max_w6": "max(credit_util_T) OVER w6",
}
for _k in (3, 6, 12):
    F2[f"cash_neg_months_w{_k}"] = S("cash_neg", _k)
cte("cash_monthly", f"""
SELECT c.*, x.out6, x.out3, {clip(div('credit_drawn', 'credit_granted'), 0, 2)} AS credit_util_T, {div('cash_balance', '(out6 + 1)')} AS cash_norm,
       CASE WHEN cash_balance < 0 THEN 1.0::DOUBLE WHEN cash_balance IS NOT NULL THEN 0 END AS cash_neg
FROM dense_cash c JOIN tx_features x USING (company_id, t_idx)""")
cte("cash_features", "SELECT company_id, t_idx, cash_balance, credit_util_T, " + ", ".join(f"{e} AS {n}" for n, e in F2.items())
    + f" FROM cash_monthly WINDOW {WINDOWS}")

# invoices as seen
cte("inv_monthly", "SELECT company_id, t_idx, " + ", ".join(
    f"{s}{k}.{m} AS {s}_{m}_{k}" for s in ("pay", "rec") for k in (3, 6, 12) for m in _inv)
    + " FROM cells " + " ".join(f"LEFT JOIN {s}{k} USING (company_id, t_idx)" for s in ("pay", "rec") for k in (3, 6, 12)))
F3 = {}
for _k in (3, 6, 12):
    for _m in ("dpd_mean", "bad_share", "open_overdue_share"):
        F3[f"pay_{_m}_w{_k}"] = f"pay_{_m}_{_k}"
F3 |= {
    "pay_dpd_p90_w6": "pay_dpd_p90_6", "pay_amt_open_overdue_ratio_w6": "pay_amt_open_overdue_ratio_6",
    "pay_amt_open_overdue_ratio_w12": "pay_amt_open_overdue_ratio_12",
    "pay_max_open_dpd_w12": "CASE WHEN pay_max_open_dpd_12 IS NOT NULL THEN least(pay_max_open_dpd_12, 400) END",
    "pay_n_w6_log": l1("coalesce(pay_n_6, 0)"), "pay_term_days_w6": "pay_term_days_mean_6",
    "pay_open_overdue_trend6": slope("pay_open_overdue_share_3"), "pay_dpd_trend6": slope("pay_dpd_mean_3"),
    "pay_bad_share_delta3": "pay_bad_share_3 - lag(pay_bad_share_3, 3) OVER wo",
    "pay_open_overdue_cv12": div(SD("pay_open_overdue_share_3", 12), f"({M('pay_open_overdue_share_3', 12)} + 0.05)"),
    "rec_dpd_mean_w3": "rec_dpd_mean_3", "rec_dpd_mean_w6": "rec_dpd_mean_6", "rec_bad_share_w6": "rec_bad_share_6",
    "rec_open_overdue_share_w3": "rec_open_overdue_share_3", "rec_open_overdue_share_w6": "rec_open_overdue_share_6",
    "rec_amt_open_overdue_ratio_w6": "rec_amt_open_overdue_ratio_6", "rec_open_overdue_trend6": slope("rec_open_overdue_share_3"),
    "rec_n_w6_log": l1("coalesce(rec_n_6, 0)"),
    "cash_conversion_days_w6": clip("rec_term_days_mean_6 + rec_dpd_mean_6", -60, 400),
}
cte("inv_features", "SELECT company_id, t_idx, " + ", ".join(f"{e} AS {n}" for n, e in F3.items())
    + f" FROM inv_monthly WINDOW {WINDOWS}")

# concentration, issuing
F4 = {
    "n_cp_in_log": l1("n_cp_in"), "n_cp_out_log": l1("n_cp_out"), "n_eff_clients": clip(div("1.0::DOUBLE", "hhi_in"), 0, 500),
    "hhi_in_delta3": "hhi_in - lag(hhi_in, 3) OVER wo", "top1_in_delta3": "top1_in_share - lag(top1_in_share, 3) OVER wo",
}
cte("conc_features", "SELECT company_id, t_idx, hhi_in, hhi_out, top1_in_share, top1_out_share, inflow_res, cp_in_churn, "
    + ", ".join(f"{e} AS {n}" for n, e in F4.items())
    + f" FROM cells LEFT JOIN cm_concentration USING (company_id, t_idx) WINDOW {WINDOWS}")
cte("dense_issued", "SELECT company_id, t_idx, " + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in _issued)
    + " FROM cells LEFT JOIN cm_invoice_issued USING (company_id, t_idx)")
F5 = {
    "inv_issued_w3_log": l1(S("n_inv_issued", 3)),
    "inv_issued_ratio_w3_w12": clip(div(M("n_inv_issued", 3), M("n_inv_issued", 12)), 0, 5),
    "has_invoices": "CASE WHEN sum(n_inv_issued) OVER wa > 0 THEN 1.0::DOUBLE ELSE 0 END",
    "months_since_last_invoice": "CASE WHEN max(CASE WHEN n_inv_issued > 0 THEN t_idx END) OVER wa IS NOT NULL THEN "
                                 "least(t_idx - max(CASE WHEN n_inv_issued > 0 THEN t_idx END) OVER wa, 12) END",
    "inv_stress_rate_w6": div(S("n_inv_stress_terms", 6), S("n_inv_issued", 6)),
    "inv_no_cp_share_w6": div(S("n_inv_no_counterparty", 6), S("n_inv_issued", 6)),
    "inv_n_counterparties_w3": M("n_inv_counterparties", 3),
}
cte("issued_features", "SELECT company_id, t_idx, " + ", ".join(f"{e} AS {n}" for n, e in F5.items())
    + f" FROM dense_issued WINDOW {WINDOWS}")

# ----------------------------------------------------------------------------------- assemble
cte("features0", f"""
SELECT c.*, x.* EXCLUDE (company_id, t_idx, T, out6, out3), h.* EXCLUDE (company_id, t_idx), i.* EXCLUDE (company_id, t_idx),
       k.* EXCLUDE (company_id, t_idx), s.* EXCLUDE (company_id, t_idx), p.* EXCLUDE (company_id, main_bank),
       coalesce(p.main_bank, 'NOBANK') AS main_bank, coalesce(c.group_id, 'NOGROUP') AS gkey,
       (epoch(c.T_next - INTERVAL 1 DAY) - epoch(c.created_at)) / (30.0::DOUBLE * 86400) AS tenure_months,
       {clip(div('inflow_res', 'inflow_total_6'), 0, 1)} AS resolved_inflow_share_w6,
       CASE WHEN c.country IS NULL THEN 1.0::DOUBLE ELSE 0 END AS country_missing,
       CASE WHEN c.erp_any IS NULL THEN 1.0::DOUBLE ELSE 0 END AS erp_missing
FROM cells c JOIN tx_features x USING (company_id, t_idx) JOIN cash_features h USING (company_id, t_idx)
JOIN inv_features i USING (company_id, t_idx) JOIN conc_features k USING (company_id, t_idx)
JOIN issued_features s USING (company_id, t_idx) JOIN static_profile p USING (company_id)""")
_PEERS = [("sib_pay_open_overdue_w6", "pay_open_overdue_share_w6", "gkey"), ("sib_cash_neg_months_w6", "cash_neg_months_w6", "gkey"),
          ("sib_io_ratio_w3", "io_ratio_w3", "gkey"), ("sib_stress_rate_w6", "stress_terms_rate_w6", "gkey"),
          ("sib_interest_n_w6", "interest_n_w6", "gkey"), ("bank_peer_pay_open_overdue_w6", "pay_open_overdue_share_w6", "main_bank"),
          ("bank_peer_cash_neg_months_w6", "cash_neg_months_w6", "main_bank"), ("bank_peer_interest_n_w6", "interest_n_w6", "main_bank")]


def _peer(name, x, key):
    over = f"OVER (PARTITION BY {key}, t_idx)"
    own = f"(CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END)"
    return (f"CASE WHEN count({x}) {over} - {own} >= 1 THEN (sum({x}) {over} - coalesce({x}, 0)) "
            f"/ (count({x}) {over} - {own}) END AS {name}")


cte("features1", "SELECT *, CAST(count(*) OVER (PARTITION BY gkey, t_idx) - 1 AS DOUBLE) AS n_siblings_active, "
    + ", ".join(_peer(*p) for p in _PEERS)
    + ", row_number() OVER (ORDER BY size_outflow_12m, company_id, t_idx) AS size_rank, count(*) OVER () AS n_rows "
    "FROM features0 WHERE in_panel")
cte("features", """
SELECT * EXCLUDE (country, currency, erp_any), coalesce(country, 'UNK') AS country, coalesce(currency, 'UNK') AS currency, coalesce(erp_any, 'NONE') AS erp_any,
       CASE WHEN size_rank <= 1 + (n_rows - 1) * 0.25::DOUBLE THEN 'q1' WHEN size_rank <= 1 + (n_rows - 1) * 0.5::DOUBLE THEN 'q2'
            WHEN size_rank <= 1 + (n_rows - 1) * 0.75::DOUBLE THEN 'q3' ELSE 'q4' END AS size_cohort
FROM features1""")
