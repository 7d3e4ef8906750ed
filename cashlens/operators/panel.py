"""Dense company-month panel and its point-in-time features.

Features are definitions over named columns. ``panel(t, names)`` resolves only what the request
needs: which monthly tables to join, which window frames to compute, in which order. All frames
share one partitioning and ordering (company, month), so they cost one shuffle and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cashlens.functions.exprs import clip, count_if, finite, flag, safe_div, slog
from cashlens.functions.ranking import row_numbers
from cashlens.operators import company_month as cm
from cashlens.operators.star import dim_company, dim_product
from cashlens.sources.staging import write_once
from cashlens.sources.treasury import Treasury



def order():
    """Months of one company, in time order."""
    return W.partitionBy("company_id").orderBy("t_idx")


CATEGORICAL = ["country", "currency", "erp_any", "main_bank", "size_cohort"]


# ---------------------------------------------------------------------------- window helpers
def frame(k: int):
    """The current month and the k-1 before it."""
    return order().rowsBetween(1 - k, 0)


def roll(c: str, k: int, how: str = "sum") -> Column:
    fn = {"sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[how]
    return fn(F.col(c)).over(frame(k))


def roll_slope(c: str, k: int) -> Column:
    """Least-squares slope over the last k months, missing months skipped, at least three points."""
    x = F.col("t_idx").cast("double")
    return F.when(F.regr_count(F.col(c), x).over(frame(k)) >= 3, F.regr_slope(F.col(c), x).over(frame(k)))


def delta(c: str, k: int) -> Column:
    return F.col(c) - F.lag(c, k).over(order())


# ------------------------------------------------------------------------- definition registry
@dataclass
class Definition:
    build: Callable[[], Column]
    deps: tuple[str, ...]
    block: str | None = None


DEFS: dict[str, Definition] = {}
BLOCKS: dict[str, list[str]] = {b: [] for b in "ABCDEF"}


def define(name: str, deps: str, build: Callable[[], Column], block: str | None = None) -> None:
    DEFS[name] = Definition(build, tuple(deps.split()), block)
    if block:
        BLOCKS[block].append(name)


# monthly inputs: column → (table, value where the company-month has no row)
FLOWS = [c for c in cm.TX_COLS if c not in ("salary_day_mean", "salary_day_max", "ss_day_mean")]
INPUTS: dict[str, tuple[str, float | None]] = {c: ("tx", 0.0) for c in FLOWS}
INPUTS |= {c: ("tx", None) for c in ("salary_day_mean", "ss_day_mean")}
INPUTS |= {c: ("cash", None) for c in cm.CASH_COLS}
INPUTS |= {c: ("conc", None) for c in cm.CONC_COLS}
INPUTS |= {c: ("issued", 0.0) for c in cm.ISSUED_COLS}
SIDES = {"pay": True, "rec": False}
INV_MEASURES = ["n", "dpd_mean", "dpd_p90", "bad_share", "open_overdue_share", "term_days_mean",
                "amt_open_overdue_ratio", "amt_open_ratio", "max_open_dpd"]
INPUTS |= {f"{s}_{m}_{k}": ("inv", None) for s in SIDES for k in (3, 6, 12) for m in INV_MEASURES}
STATIC = ["n_bank_accounts", "n_cards", "n_products_total", "n_banks", "main_bank_share", "n_debt_products", "n_loans",
          "n_credit_lines", "n_leasing", "n_guarantees", "n_confirming_factoring", "debt_granted_total",
          "loan_granted_total", "wavg_interest_rate", "total_periods_mean", "share_variable_rate"]
INPUTS |= {c: ("static", None) for c in STATIC + ["main_bank"]}
INPUTS |= {c: ("company", None) for c in ("group_id", "country", "currency", "erp_any", "group_size", "created_at")}


def _div_feature(block, name, num, den, lo=None, hi=None):
    define(name, f"{num} {den}", lambda: clip(safe_div(num, den), lo, hi) if lo is not None or hi is not None
           else safe_div(num, den), block)


def _rolled(name: str, c: str, k: int, how: str = "sum") -> str:
    """Register a rolled helper column and return its name."""
    key = name or f"{c}__{how}{k}"
    if key not in DEFS:
        define(key, c, lambda: roll(c, k, how))
    return key


def S(c, k):
    return _rolled("", c, k)


def M(c, k):
    return _rolled("", c, k, "mean")


def _feature(block, name, deps, build):
    define(name, deps, build, block)


def _alias(block, name, source):
    define(name, source, lambda: F.col(source), block)


# ------------------------------------------------------------------------------------ block A
define("first_active", "n_tx", lambda: F.min(F.when(F.col("n_tx") > 0, F.col("t_idx"))).over(W.partitionBy("company_id")))
define("in_panel", "first_active", lambda: F.coalesce(F.col("t_idx") >= F.col("first_active"), F.lit(False)))
_feature("A", "tenure_months", "created_at", lambda: (
    F.unix_timestamp("month_end") - F.unix_timestamp("created_at")) / (30.0 * 86400.0))
_feature("A", "months_in_panel", "first_active", lambda: (F.col("t_idx") - F.col("first_active") + 1).cast("double"))
BLOCKS["A"].append("group_size")
BLOCKS["A"] += STATIC
_feature("A", "cash_balance_T_log", "cash_balance", lambda: slog("cash_balance"))
_div_feature("A", "cash_months_of_outflow", "cash_balance", M("outflow_oper", 6), -24, 24)
_div_feature("A", "credit_util_T", "credit_drawn", "credit_granted", 0, 2)
for _c in ("credit", "card"):
    _feature("A", f"{_c}_drawn_T_log", f"{_c}_drawn", lambda c=_c: F.log1p(clip(f"{c}_drawn", 0)))
_div_feature("A", "debt_service_ratio_w6", S("amt_debt_repayment", 6), S("inflow_oper", 6), 0, 5)
for _d, _c in (("out", "outflow_oper"), ("in", "inflow_oper")):
    _feature("A", f"turnover_{_d}_w12_log", S(_c, 12), lambda c=_c: F.log1p(F.col(S(c, 12))))

# ------------------------------------------------------------------------------------ block B
for _k in (3, 6, 12):
    for _m in ("dpd_mean", "bad_share", "open_overdue_share"):
        _alias("B", f"pay_{_m}_w{_k}", f"pay_{_m}_{_k}")
_alias("B", "pay_dpd_p90_w6", "pay_dpd_p90_6")
for _k in (6, 12):
    _alias("B", f"pay_amt_open_overdue_ratio_w{_k}", f"pay_amt_open_overdue_ratio_{_k}")
_feature("B", "pay_max_open_dpd_w12", "pay_max_open_dpd_12", lambda: clip("pay_max_open_dpd_12", hi=400))
_feature("B", "pay_n_w6_log", "pay_n_6", lambda: F.log1p(F.coalesce("pay_n_6", F.lit(0))))
_alias("B", "pay_term_days_w6", "pay_term_days_mean_6")
_feature("B", "pay_open_overdue_trend6", "pay_open_overdue_share_w3", lambda: roll_slope("pay_open_overdue_share_w3", 6))
_feature("B", "pay_dpd_trend6", "pay_dpd_mean_w3", lambda: roll_slope("pay_dpd_mean_w3", 6))
_feature("B", "pay_bad_share_delta3", "pay_bad_share_w3", lambda: delta("pay_bad_share_w3", 3))
_feature("B", "pay_open_overdue_cv12", "pay_open_overdue_share_w3", lambda: safe_div(
    roll("pay_open_overdue_share_w3", 12, "std"), roll("pay_open_overdue_share_w3", 12, "mean") + 0.05))
for _k in (3, 6):
    _alias("B", f"rec_dpd_mean_w{_k}", f"rec_dpd_mean_{_k}")
_alias("B", "rec_bad_share_w6", "rec_bad_share_6")
for _k in (3, 6):
    _alias("B", f"rec_open_overdue_share_w{_k}", f"rec_open_overdue_share_{_k}")
_alias("B", "rec_amt_open_overdue_ratio_w6", "rec_amt_open_overdue_ratio_6")
_feature("B", "rec_open_overdue_trend6", "rec_open_overdue_share_w3", lambda: roll_slope("rec_open_overdue_share_w3", 6))
_feature("B", "rec_n_w6_log", "rec_n_6", lambda: F.log1p(F.coalesce("rec_n_6", F.lit(0))))
for _p, _c in (("salary", "salary"), ("ss", "social_security"), ("tax", "tax")):
    define(f"{_p}_paid", f"n_{_c}", lambda c=_c: flag(F.col(f"n_{c}") > 0))
    _feature("B", f"{_p}_months_share_w6", f"{M(f'{_p}_paid', 6)} {S(f'n_{_c}', 12)}",
             lambda p=_p, c=_c: F.when(F.col(S(f"n_{c}", 12)) > 0, F.col(M(f"{p}_paid", 6))))
    if _p != "tax":
        _feature("B", f"{_p}_day_mean_w3", f"{_p}_day_mean", lambda p=_p: roll(f"{p}_day_mean", 3, "mean"))
    if _p == "salary":
        _feature("B", "salary_day_delta", "salary_day_mean",
                 lambda: roll("salary_day_mean", 3, "mean") - roll("salary_day_mean", 12, "mean"))
    _div_feature("B", f"{_p}_amt_ratio_w3_w12", M(f"amt_{_c}", 3), M(f"amt_{_c}", 12), 0, 5)
_div_feature("B", "tax_share_of_outflow_w6", S("amt_tax", 6), S("outflow_oper", 6), 0, 1)

# ------------------------------------------------------------------------------------ block C
for _k in (1, 3, 6):
    for _d in ("inflow", "outflow"):
        _feature("C", f"{_d}_w{_k}_log", S(f"{_d}_oper", _k), lambda d=_d, k=_k: F.log1p(F.col(S(f"{d}_oper", k))))
for _k in (1, 3, 6, 12):
    _div_feature("C", f"io_ratio_w{_k}", S("inflow_oper", _k), S("outflow_oper", _k), 0, 5)
define("io_m", "inflow_oper outflow_oper", lambda: clip(safe_div("inflow_oper", "outflow_oper"), 0, 5))
_feature("C", "io_ratio_trend6", "io_m", lambda: roll_slope("io_m", 6))
define("net_w3", f"{S('inflow_oper', 3)} {S('outflow_oper', 3)}",
       lambda: F.col(S("inflow_oper", 3)) - F.col(S("outflow_oper", 3)))
_div_feature("C", "net_flow_norm_w3", "net_w3", S("outflow_oper", 3), -5, 5)
for _n, _c in (("inflow", "inflow_oper"), ("outflow", "outflow_oper"), ("n_tx", "n_tx"),
               ("debt_repayment", "amt_debt_repayment")):
    define(f"{_n}_log1p", _c, lambda c=_c: F.log1p(F.col(c)))
for _n in ("inflow", "outflow"):
    _feature("C", f"{_n}_trend6", f"{_n}_log1p", lambda n=_n: roll_slope(f"{n}_log1p", 6))
_div_feature("C", "inflow_w3_vs_w12", M("inflow_oper", 3), M("inflow_oper", 12), 0, 5)
_feature("C", "inflow_vol6", "inflow_oper", lambda: clip(safe_div(
    roll("inflow_oper", 6, "std"), roll("inflow_oper", 6, "mean") + 1), 0, 5))
define("cash_norm", f"cash_balance {M('outflow_oper', 6)}",
       lambda: safe_div("cash_balance", F.col(M("outflow_oper", 6)) + 1))
_feature("C", "cash_trend6", "cash_norm", lambda: clip(roll_slope("cash_norm", 6), -10, 10))
_feature("C", "cash_vol6", f"cash_balance {M('outflow_oper', 6)}", lambda: clip(safe_div(
    roll("cash_balance", 6, "std"),
    F.abs(roll("cash_balance", 6, "mean")) + F.col(M("outflow_oper", 6)) + 1), 0, 10))
define("cash_neg", "cash_balance", lambda: F.when(F.col("cash_balance").isNotNull(), flag(F.col("cash_balance") < 0)))
for _k in (3, 6, 12):
    _feature("C", f"cash_neg_months_w{_k}", "cash_neg", lambda k=_k: roll("cash_neg", k))
_feature("C", "cash_min_w6_norm", f"cash_balance {M('outflow_oper', 6)}", lambda: clip(safe_div(
    roll("cash_balance", 6, "min"), F.col(M("outflow_oper", 6)) + 1), -24, 24))
define("n_cash_accounts_neg_T", "n_cash_accounts_neg", lambda: F.col("n_cash_accounts_neg").cast("double"), "C")
_feature("C", "days_of_cash", f"cash_balance {S('outflow_oper', 3)}", lambda: clip(
    safe_div("cash_balance", F.col(S("outflow_oper", 3)) / 90 + 1), -365, 365))
for _k in (3, 6, 12):
    _feature("C", f"interest_n_w{_k}", "n_interest_charge", lambda k=_k: roll("n_interest_charge", k))
_feature("C", "interest_trend6", "n_interest_charge", lambda: roll_slope("n_interest_charge", 6))
_div_feature("C", "interest_amt_ratio_w6", S("amt_interest_charge", 6), S("outflow_oper", 6), 0, 1)
_div_feature("C", "fee_amt_ratio_w6", S("amt_fee", 6), S("outflow_oper", 6), 0, 1)
_feature("C", "credit_util_trend6", "credit_util_T", lambda: roll_slope("credit_util_T", 6))
_feature("C", "credit_util_max_w6", "credit_util_T", lambda: roll("credit_util_T", 6, "max"))
_alias("C", "n_tx_w1", "n_tx")
_feature("C", "n_tx_w3_log", S("n_tx", 3), lambda: F.log1p(F.col(S("n_tx", 3))))
_feature("C", "n_tx_trend6", "n_tx_log1p", lambda: roll_slope("n_tx_log1p", 6))
_div_feature("C", "n_tx_w3_vs_w12", M("n_tx", 3), M("n_tx", 12), 0, 5)
_feature("C", "active_days_w3", "n_active_days", lambda: roll("n_active_days", 3))
define("no_tx", "n_tx", lambda: flag(F.col("n_tx") == 0))
_feature("C", "inactive_months_w6", f"{S('no_tx', 6)} in_panel", lambda: F.when(F.col("in_panel"), F.col(S("no_tx", 6))))
_div_feature("C", "cash_withdrawal_share_w6", S("n_cash_withdrawal", 6), S("n_tx", 6))
_div_feature("C", "refund_share_w6", S("n_refund", 6), S("n_tx", 6))
_feature("C", "cash_conversion_days_w6", "rec_term_days_mean_6 rec_dpd_mean_6",
         lambda: clip(F.col("rec_term_days_mean_6") + F.col("rec_dpd_mean_6"), -60, 400))
_feature("C", "debt_repayment_trend6", "debt_repayment_log1p", lambda: roll_slope("debt_repayment_log1p", 6))

# ------------------------------------------------------------------------------------ block D
BLOCKS["D"] += ["hhi_in", "hhi_out", "top1_in_share", "top1_out_share"]
for _d in ("in", "out"):
    _feature("D", f"n_cp_{_d}_log", f"n_cp_{_d}", lambda d=_d: F.log1p(F.col(f"n_cp_{d}")))
_feature("D", "n_eff_clients", "hhi_in", lambda: clip(safe_div(F.lit(1.0), "hhi_in"), 0, 500))
BLOCKS["D"].append("cp_in_churn")
_feature("D", "hhi_in_delta3", "hhi_in", lambda: delta("hhi_in", 3))
_feature("D", "top1_in_delta3", "top1_in_share", lambda: delta("top1_in_share", 3))
_div_feature("D", "resolved_inflow_share_w6", "inflow_res", S("inflow_total", 6), 0, 1)
_feature("D", "n_counterparties_w3_mean", "n_counterparties", lambda: roll("n_counterparties", 3, "mean"))

# ------------------------------------------------------------------------------------ block F
for _k in (3, 6, 12):
    _div_feature("F", f"stress_terms_rate_w{_k}", S("n_stress_terms", _k), S("n_tx", _k))
_feature("F", "stress_terms_n_w3", "n_stress_terms", lambda: roll("n_stress_terms", 3))
define("stress_m", "n_stress_terms n_tx", lambda: safe_div("n_stress_terms", "n_tx"))
_feature("F", "stress_trend6", "stress_m", lambda: roll_slope("stress_m", 6))
for _c, _n in (("n_no_counterparty", "no_counterparty"), ("n_no_accounting", "no_accounting"),
               ("n_discarded", "discarded"), ("n_reconciled", "reconciled"), ("n_status_pending", "pending_status"),
               ("n_uncategorized", "uncategorized")):
    _div_feature("F", f"{_n}_share_w3", S(_c, 3), S("n_tx", 3))
    if _n in ("no_counterparty", "no_accounting", "reconciled"):
        _feature("F", f"{_n}_delta_w3_w12", f"{S(_c, 3)} {S('n_tx', 3)} {S(_c, 12)} {S('n_tx', 12)}",
                 lambda c=_c: safe_div(S(c, 3), S("n_tx", 3)) - safe_div(S(c, 12), S("n_tx", 12)))
_feature("F", "inv_issued_w3_log", S("n_inv_issued", 3), lambda: F.log1p(F.col(S("n_inv_issued", 3))))
_div_feature("F", "inv_issued_ratio_w3_w12", M("n_inv_issued", 3), M("n_inv_issued", 12), 0, 5)
define("issued_now", "n_inv_issued", lambda: flag(F.col("n_inv_issued") > 0))
_feature("F", "has_invoices", "issued_now", lambda: F.max("issued_now").over(order().rowsBetween(W.unboundedPreceding, 0)))
_feature("F", "months_since_last_invoice", "n_inv_issued", lambda: clip(
    (F.col("t_idx") - F.last(F.when(F.col("n_inv_issued") > 0, F.col("t_idx")), ignorenulls=True)
     .over(order().rowsBetween(W.unboundedPreceding, 0))).cast("double"), hi=12))
_div_feature("F", "inv_stress_rate_w6", S("n_inv_stress_terms", 6), S("n_inv_issued", 6))
_div_feature("F", "inv_no_cp_share_w6", S("n_inv_no_counterparty", 6), S("n_inv_issued", 6))
_feature("F", "inv_n_counterparties_w3", "n_inv_counterparties", lambda: roll("n_inv_counterparties", 3, "mean"))
_feature("F", "country_missing", "country", lambda: flag(F.col("country").isNull()))
_feature("F", "erp_missing", "erp_any", lambda: flag(F.col("erp_any").isNull()))

# ------------------------------------------------------------------------------------ block E
# peer feature → (own feature, peer key)
PEERS = {
    "sib_pay_open_overdue_w6": ("pay_open_overdue_share_w6", "peer_group"),
    "sib_cash_neg_months_w6": ("cash_neg_months_w6", "peer_group"),
    "sib_io_ratio_w3": ("io_ratio_w3", "peer_group"),
    "sib_stress_rate_w6": ("stress_terms_rate_w6", "peer_group"),
    "sib_interest_n_w6": ("interest_n_w6", "peer_group"),
    "bank_peer_pay_open_overdue_w6": ("pay_open_overdue_share_w6", "peer_bank"),
    "bank_peer_cash_neg_months_w6": ("cash_neg_months_w6", "peer_bank"),
    "bank_peer_interest_n_w6": ("interest_n_w6", "peer_bank"),
}
define("peer_group", "group_id", lambda: F.coalesce("group_id", F.lit("NOGROUP")))
define("peer_bank", "main_bank", lambda: F.coalesce("main_bank", F.lit("NOBANK")))
BLOCKS["E"] += ["n_siblings_active", *PEERS]
define("size_outflow_12m", "outflow_oper", lambda: roll("outflow_oper", 12, "mean"))

NUMERIC = [f for b in "ABCDEF" for f in BLOCKS[b]]
FEATURE_BLOCK = {f: b for b, fs in BLOCKS.items() for f in fs} | {
    "country": "A", "currency": "A", "erp_any": "A", "main_bank": "E"}
FEATURES = NUMERIC + ["country", "currency", "erp_any", "main_bank"]


def feature_sets() -> dict[str, list[str]]:
    """A = structural block, B = all, B minus one block, A plus one block."""
    by = {b: [f for f in FEATURES if FEATURE_BLOCK[f] == b] for b in "ABCDEF"}
    sets = {"A": by["A"], "B": [f for b in "ABCDEF" for f in by[b]]}
    sets |= {f"B_minus_{b}": [f for c in "ABCDEF" if c != b for f in by[c]] for b in "ABCDEF"}
    sets |= {f"A_plus_{b}": by["A"] + by[b] for b in "BCDEF"}
    return sets


# ------------------------------------------------------------------------------ input tables
def invoice_window(lag: DataFrame, side: bool, k: int) -> DataFrame:
    """Due months 0…k-1 back rolled to one row per company-month, means weighted by invoices."""
    w, n = F.col("n"), F.sum("n")
    means = ["dpd_mean", "dpd_p90", "bad_share", "open_overdue_share", "term_days_mean"]
    return (lag.where((F.col("is_payable") == side) & (F.col("lag") < k)).groupBy("company_id", "t_idx").agg(
        n.alias("n"), F.sum("amt").alias("amt"), *[(F.sum(F.col(m) * w) / n).alias(m) for m in means],
        safe_div(F.sum("amt_open_overdue"), F.sum("amt")).alias("amt_open_overdue_ratio"),
        safe_div(F.sum("amt_open"), F.sum("amt")).alias("amt_open_ratio"),
        F.max("max_open_dpd").alias("max_open_dpd")))


def invoice_windows(t: Treasury, cols: list[str]) -> DataFrame:
    """All requested side × window × measure columns in one aggregation over the lag table."""
    means = {"dpd_mean", "dpd_p90", "bad_share", "open_overdue_share", "term_days_mean"}
    aggs = []
    for c in cols:
        side, rest = c.split("_", 1)
        m, k = rest.rsplit("_", 1)
        hit = (F.col("is_payable") == SIDES[side]) & (F.col("lag") < int(k))

        def s(x, hit=hit):
            return F.sum(F.when(hit, x))
        if m in means:
            e = s(F.col(m) * F.col("n")) / s(F.col("n"))
        elif m == "n":
            e = s(F.col("n"))
        elif m == "max_open_dpd":
            e = F.max(F.when(hit, F.col(m)))
        else:
            e = safe_div(s(F.col(m.removesuffix("_ratio"))), s(F.col("amt")))
        aggs.append(e.alias(c))
    return cm.cm_invoice_lag(t).groupBy("company_id", "t_idx").agg(*aggs)


def static_profile(t: Treasury) -> DataFrame:
    """Products per company by kind, banks, financing granted and loan terms."""
    p, typ, debt = dim_product(t), F.col("type"), F.col("is_debt")
    real = ~F.coalesce("bank_name", F.lit("Other")).startswith("Other")
    granted = F.coalesce(F.abs("granted"), F.lit(0.0))

    def n(cond):
        return count_if(cond).cast("double")
    counts = p.groupBy("company_id").agg(
        n(~debt & (typ == "checking")).alias("n_bank_accounts"), n(~debt & (typ == "card")).alias("n_cards"),
        F.count(F.lit(1)).alias("__products"), n(debt).alias("n_debt_products"),
        n(debt & (typ == "loan")).alias("n_loans"), n(debt & (typ == "lineofcredit")).alias("n_credit_lines"),
        n(debt & (typ == "leasing")).alias("n_leasing"), n(debt & (typ == "guarantee")).alias("n_guarantees"),
        n(debt & typ.isin("confirming", "factoring")).alias("n_confirming_factoring"),
        F.sum(F.when(debt, granted).otherwise(0.0)).alias("debt_granted_total"),
        F.sum(F.when(debt & typ.isin("loan", "mortgage", "leasing"), granted).otherwise(0.0)).alias("loan_granted_total"))
    per_bank = p.where(real).groupBy("company_id", "bank_name").agg(F.count(F.lit(1)).alias("k"))
    banks = per_bank.groupBy("company_id").agg(
        F.count(F.lit(1)).cast("double").alias("n_banks"),
        F.min(F.struct((-F.col("k")).alias("neg"), F.col("bank_name").alias("bank"))).alias("top"))
    loans = t.table("debt_schedule_config", "company_id", "granted_balance", "total_periods",
                    "annual_interest_rate_or_spread", "interest_type")
    w = F.coalesce(F.abs("granted_balance"), F.lit(0.0)) + 1
    terms = loans.groupBy("company_id").agg(
        (F.sum(w * F.coalesce("annual_interest_rate_or_spread", F.lit(0.0))) / F.sum(w)).alias("wavg_interest_rate"),
        F.avg("total_periods").alias("total_periods_mean"),
        F.avg(flag(F.col("interest_type") == "variable")).alias("share_variable_rate"))
    base = t.table("companies", "company_id").join(counts, "company_id", "left").join(
        banks, "company_id", "left").join(terms, "company_id", "left")
    zero = [c for c in STATIC if c not in ("n_products_total", "main_bank_share", "wavg_interest_rate",
                                           "total_periods_mean", "share_variable_rate")]
    logged = {"debt_granted_total", "loan_granted_total"}
    return base.select(
        "company_id", F.col("top.bank").alias("main_bank"),
        *[(F.log1p(F.coalesce(c, F.lit(0.0))) if c in logged else F.coalesce(c, F.lit(0.0))).alias(c) for c in zero],
        F.log1p(F.coalesce("__products", F.lit(0)).cast("double")).alias("n_products_total"),
        (-F.col("top.neg") / F.col("__products")).alias("main_bank_share"),
        "wavg_interest_rate", "total_periods_mean", "share_variable_rate")


def dense(t: Treasury, cols: list[str]) -> DataFrame:
    """Companies × months with the requested monthly and static columns; flows 0, levels NULL."""
    need: dict[str, list[str]] = {}
    for c in cols:
        need.setdefault(INPUTS[c][0], []).append(c)
    start = F.lit(t.cfg.first_month + "-01").cast("date")
    company = (dim_company(t) if "company" in need else t.table("companies")).select(
        "company_id", *need.get("company", []))
    if "static" in need:
        company = company.join(static_profile(t).select("company_id", *need["static"]), "company_id", "left")
    df = company.withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.lit(t.cfg.n_months - 1))))
    tables = {"tx": "cm_tx", "cash": "cm_cash", "conc": "cm_concentration", "issued": "cm_invoice_issued"}
    cm.write_monthly(t, [name for source, name in tables.items() if source in need])
    makers = {
        **{source: lambda cs, name=name: cm.monthly(t, name).select("company_id", "t_idx", *cs) for source, name in tables.items()},
        "inv": lambda cs: invoice_windows(t, cs),
    }
    for source, make in makers.items():
        if source in need:
            df = df.join(make(need[source]), ["company_id", "t_idx"], "left")
    casts = {c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if INPUTS[c][1] == 0.0 else F.col(c).cast("double"))
             for c in cols if INPUTS[c][0] in ("tx", "cash", "conc", "issued", "inv")}
    if "group_size" in cols:
        casts["group_size"] = F.col("group_size").cast("double")
    return df.withColumns({**casts, "T": F.date_format(F.add_months(start, F.col("t_idx")), "yyyy-MM"),
                           "month_end": F.last_day(F.add_months(start, F.col("t_idx"))).cast("timestamp")})


def resolve(names: list[str]) -> tuple[list[str], list[list[str]]]:
    """Inputs to join and the definitions to evaluate, level by level."""
    level: dict[str, int] = {}

    def visit(n: str) -> int:
        if n not in level:
            if n in DEFS and n not in INPUTS:
                level[n] = 1 + max((visit(d) for d in DEFS[n].deps), default=0)
            elif n in INPUTS:
                level[n] = 0
            else:
                raise KeyError(f"unknown feature: {n}")
        return level[n]
    for n in names:
        visit(n)
    layers: dict[int, list[str]] = {}
    for n, lv in level.items():
        layers.setdefault(lv, []).append(n)
    return layers.get(0, []), [layers[i] for i in sorted(layers) if i > 0]


def with_definitions(df: DataFrame, layers: list[list[str]]) -> DataFrame:
    for layer in layers:
        df = df.withColumns({n: DEFS[n].build() for n in layer})
    return df


def peer_means(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean over same-key companies of the month without the own value, and active siblings. The
    key totals are aggregated and joined back: a key that holds a third of the companies never
    sits in one task."""
    def own(n):
        return F.when(F.col("in_panel"), F.col(PEERS[n][0]))

    count_siblings = "n_siblings_active" in names
    peers = [n for n in names if n in PEERS]
    keys = dict.fromkeys([PEERS[n][1] for n in peers] + (["peer_group"] if count_siblings else []))
    out = df
    for key in keys:
        aggs = [e for n in peers if PEERS[n][1] == key
                for e in (F.sum(own(n)).alias(f"__s_{n}"), F.count(own(n)).alias(f"__n_{n}"))]
        if key == "peer_group" and count_siblings:
            aggs.append(F.sum(flag(F.col("in_panel"))).alias("__active"))
        out = out.join(df.groupBy(key, "t_idx").agg(*aggs), [key, "t_idx"], "left")
    new = {}
    for n in peers:
        others = F.col(f"__n_{n}") - F.when(own(n).isNotNull(), 1).otherwise(0)
        new[n] = F.when(others >= 1, (F.col(f"__s_{n}") - F.coalesce(own(n), F.lit(0.0))) / others)
    if count_siblings:
        new["n_siblings_active"] = F.col("__active") - flag(F.col("in_panel"))
    return out.select(*df.columns, *[c.alias(n) for n, c in new.items()])


def size_cohort(df: DataFrame, edges: list[float] | None = None) -> DataFrame:
    """Quartile of the pooled first-come rank of size: edges at 1 + (n-1)q. With ``edges``, the sizes that bound the
    quartiles of a training run, a row is placed by them and needs no other row."""
    if edges:
        s = F.col("size_outflow_12m")
        return df.withColumn("size_cohort", F.when(s <= edges[0], "q1").when(s <= edges[1], "q2").when(s <= edges[2], "q3").otherwise("q4"))
    order = ["size_outflow_12m", "company_id", "t_idx"]
    r = write_once(row_numbers(df.select("company_id", "t_idx", "size_outflow_12m"), order, "__r"), "size_ranks")

    def edge(q):
        return F.lit(1.0) + (F.col("__r_total") - 1) * q

    def cohort(below):
        return F.when(below(0.25), "q1").when(below(0.5), "q2").when(below(0.75), "q3").otherwise("q4")
    # ranks follow the order of (size, company, month), so a quartile ends at one such tuple and wide rows needn't meet their ranks
    place, name = F.struct(*order), {q: f"__last_{int(q * 100)}" for q in (0.25, 0.5, 0.75)}
    last = r.agg(*[F.max(F.when(F.col("__r") <= edge(q), place)).alias(c) for q, c in name.items()])         # a single row
    # a company-month that comes more than once meets the ranks of all its rows
    several = write_once(r.groupBy("company_id", "t_idx").agg(F.collect_list(cohort(lambda q: F.col("__r") <= edge(q))).alias("__several"))
                         .where(F.size("__several") > 1), "size_repeats")
    out = df.where(F.col("company_id").isNotNull()).crossJoin(F.broadcast(last)).join(several, ["company_id", "t_idx"], "left")
    own = F.array(cohort(lambda q: place <= F.col(name[q])))
    return out.select(*[c for c in df.columns], F.explode(F.coalesce("__several", own)).alias("size_cohort"))


def panel(t: Treasury, names: list[str] | None = None, keep: list[str] = (), size_edges: list[float] | None = None) -> DataFrame:
    """Feature panel: rows from each company's first active month on, requested features only.
    ``size_edges``: bounds of the size quartiles frozen in a training run."""
    names = list(names if names is not None else FEATURES + ["size_cohort"])
    peers = [n for n in names if n in PEERS]
    want = [n for n in names if n not in PEERS and n not in ("size_cohort", "n_siblings_active")]
    extra = ["in_panel"] + [PEERS[n][0] for n in peers] + [PEERS[n][1] for n in peers]
    if "n_siblings_active" in names:
        extra.append("peer_group")
    if "size_cohort" in names:
        extra.append("size_outflow_12m")
    own = list(dict.fromkeys([*want, *extra, *keep]))
    inputs, layers = resolve(own)
    df = with_definitions(dense(t, inputs), layers)
    related = [n for n in names if n in PEERS or n == "n_siblings_active"]
    if related or "size_cohort" in names:
        # the steps below read the panel several times
        df = write_once(df.select("company_id", "T", "t_idx", *own), "panel_own")
    if related:
        df = peer_means(df, related)
    df = df.where("in_panel")
    if "size_cohort" in names:
        df = size_cohort(df, size_edges)
    defaults = {"country": "UNK", "currency": "UNK", "erp_any": "NONE", "main_bank": "NOBANK"}
    return df.select("company_id", "T", "t_idx", *[
        F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults
        else finite(F.col(c)).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c)
        for c in dict.fromkeys([*names, *keep])])
