"""Company-month aggregates.

The large facts are collapsed here, in partial aggregates that survive hot companies: distinct
counts become bit sets or a second small aggregate, look-back windows are exploded only after the
monthly collapse, and range joins against the calendar are replaced by ordinals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cashlens.config import NON_OPERATING_IN, NON_OPERATING_OUT, SNAPSHOT_TYPES, month_name
from cashlens.functions.exprs import count_if, month_idx, sum_if
from cashlens.operators.star import amount, dim_product, fact_invoice
from cashlens.sources.staging import staged, together
from cashlens.sources.treasury import Treasury


def _ts(s):
    return F.lit(s).cast("timestamp")


def counterparty_month(t: Treasury) -> DataFrame:
    """In- and outflow per (company, month, counterparty): one collapse for counts, concentration and churn."""
    a = F.col("amount")
    df = t.table("transactions", "company_id", "counterparty_id", "date", "amount")
    return (df.where(F.col("counterparty_id").isNotNull() & (F.col("date") < _ts(t.cfg.data_end)))
            .groupBy("company_id", month_idx("date", t.cfg.base).alias("m"), "counterparty_id")
            .agg(sum_if(a > 0, a).alias("inflow"), sum_if(a < 0, -a).alias("outflow")))


def _tx_measures(t: Treasury) -> dict:
    a, cat, day = amount(t), F.col("category"), F.dayofmonth("date")
    kind = F.coalesce(cat, F.lit("-"))
    out = {
        "n_tx": F.count(F.lit(1)),
        "inflow_total": sum_if(a > 0, a), "outflow_total": sum_if(a < 0, -a),
        "inflow_oper": sum_if((a > 0) & ~kind.isin(*NON_OPERATING_IN), a),
        "outflow_oper": sum_if((a < 0) & ~kind.isin(*NON_OPERATING_OUT), -a),
        "amt_collection": sum_if((cat == "collection") & (a > 0), a),
        "amt_payment": sum_if((cat == "payment") & (a < 0), -a),
    }
    for c in ("interest_charge", "fee", "debt_repayment", "salary", "social_security", "tax"):
        out[f"n_{c}"] = count_if(cat == c)
        out[f"amt_{c}"] = sum_if(cat == c, -a)
    out |= {
        "salary_day_sum": F.sum(F.when(cat == "salary", day)),
        "salary_day_max": F.max(F.when(cat == "salary", day)),
        "ss_day_sum": F.sum(F.when(cat == "social_security", day)),
        "n_refund": count_if(cat.isin("collection_refund", "payment_refund")),
        "n_cash_withdrawal": count_if(cat == "cash_withdrawal"),
        "n_stress_terms": count_if(F.lower(F.coalesce("description", F.lit(""))).rlike(t.cfg.stress_terms)),
        "n_no_counterparty": count_if(F.col("counterparty_id").isNull()),
        "n_no_accounting": count_if(F.col("accounting_status").isNull()),
        "n_discarded": count_if(F.col("accounting_status") == "DISCARDED"),
        "n_reconciled": count_if(F.col("accounting_status").isin("RECONCILIATION_COMPLETED", "ACCOUNTING_COMPLETED")),
        "n_status_pending": count_if(F.col("status") == "pending"),
        "n_uncategorized": count_if(kind == "-"),
        "days_seen": F.bit_or(F.expr("shiftleft(1L, dayofmonth(date))")),
    }
    return out


# Columns a measure needs beyond company, product, date and amount.
_TX_NEEDS = {
    "description": ("n_stress_terms",), "counterparty_id": ("n_no_counterparty",),
    "accounting_status": ("n_no_accounting", "n_discarded", "n_reconciled"), "status": ("n_status_pending",),
}
_MERGE = {"salary_day_max": F.max, "days_seen": F.bit_or}
TX_COLS = [
    "n_tx", "n_active_accounts", "inflow_total", "outflow_total", "inflow_oper", "outflow_oper", "amt_collection",
    "amt_payment", "n_interest_charge", "amt_interest_charge", "n_fee", "amt_fee", "n_debt_repayment",
    "amt_debt_repayment", "n_salary", "amt_salary", "salary_day_mean", "salary_day_max", "n_social_security",
    "amt_social_security", "ss_day_mean", "n_tax", "amt_tax", "n_refund", "n_cash_withdrawal", "n_stress_terms",
    "n_no_counterparty", "n_no_accounting", "n_discarded", "n_reconciled", "n_status_pending", "n_uncategorized",
    "n_tx_debt_products", "n_counterparties", "n_active_days",
]


def cm_tx(t: Treasury, cols: list[str] | None = None) -> DataFrame:
    """Monthly movement measures per company; ``cols`` limits reads and lookups to what is used."""
    cols = cols or TX_COLS
    every = _tx_measures(t)
    derived = {"salary_day_mean": ("salary_day_sum", "n_salary"), "ss_day_mean": ("ss_day_sum", "n_social_security"),
               "n_active_days": ("days_seen",), "n_tx_debt_products": ("n_tx",)}
    wanted = dict.fromkeys(m for c in cols for m in derived.get(c, (c,)) if m in every)
    reads = ["company_id", "product_id", "date", "amount", "exchange_rate", "category"]
    reads += [c for c, ms in _TX_NEEDS.items() if set(ms) & set(wanted)]
    base = t.table("transactions", *reads).where(F.col("date") < _ts(t.cfg.data_end))
    # first level: per product, so products are counted without a distinct over raw rows
    g1 = base.groupBy("company_id", month_idx("date", t.cfg.base).alias("t_idx"), "product_id").agg(
        *[every[m].alias(m) for m in wanted])
    merge = [_MERGE.get(m, F.sum)(m).alias(m) for m in wanted]
    if "n_active_accounts" in cols:
        merge.append(F.count("product_id").alias("n_active_accounts"))
    if "n_tx_debt_products" in cols:
        debt = dim_product(t).where("is_debt").select("product_id", F.lit(True).alias("is_debt"))
        g1 = g1.join(debt, "product_id", "left")
        merge.append(sum_if(F.col("is_debt"), F.col("n_tx")).cast("long").alias("n_tx_debt_products"))
    g2 = g1.groupBy("company_id", "t_idx").agg(*(merge or [F.count(F.lit(1)).alias("__n")]))
    if "n_counterparties" in cols:
        cp = monthly(t, "counterparty_month").groupBy("company_id", F.col("m").alias("t_idx")).agg(
            F.count(F.lit(1)).alias("n_counterparties"))
        g2 = g2.join(cp, ["company_id", "t_idx"], "left")
    final = {"salary_day_mean": F.col("salary_day_sum") / F.nullif(F.col("n_salary"), F.lit(0)),
             "ss_day_mean": F.col("ss_day_sum") / F.nullif(F.col("n_social_security"), F.lit(0)),
             "n_active_days": F.bit_count("days_seen").cast("long"),
             "n_counterparties": F.coalesce("n_counterparties", F.lit(0))}
    return g2.select("company_id", "t_idx", *[
        (final[c] if c in final else F.col(c)).alias(c) for c in cols])


def month_end_balances(t: Treasury) -> DataFrame:
    """Month-end balance per snapshot product: snapshot minus the movements after that month.

    Movements are summed per product and instant first, so the product lookup and the reverse
    running sum see a few hundred rows per product at most.
    """
    cfg = t.cfg
    prod = (t.table("balances", "product_id", "company_id", "date", "balance")
            .join(dim_product(t).select("product_id", "type", "is_cash", "granted"), "product_id")
            .where(F.col("type").isin(*SNAPSHOT_TYPES)))
    m = F.least(month_idx("date", cfg.base), F.lit(cfg.n_months))
    moves = (t.table("transactions", "product_id", "date", "amount")
             .where(F.col("date") >= _ts(month_name(cfg.base + 1) + "-01"))
             .groupBy("product_id", "date").agg(F.sum("amount").alias("s")))
    moves = (moves.join(prod.select("product_id", F.col("date").alias("snap")), "product_id")
             .where(F.col("date") <= F.col("snap") + F.expr("INTERVAL 1 DAY"))
             .groupBy("product_id", m.alias("t_idx")).agg(F.sum("s").alias("s")))
    months = F.explode(F.sequence(F.lit(0), F.lit(cfg.n_months))).alias("t_idx")
    after = W.partitionBy("product_id").orderBy("t_idx").rowsBetween(1, W.unboundedFollowing)
    return (prod.select("product_id", "company_id", "type", "is_cash", "granted", "balance", months)
            .join(moves, ["product_id", "t_idx"], "left")
            .withColumn("bal_T", F.col("balance") - F.coalesce(F.sum("s").over(after), F.lit(0.0)))
            .where(F.col("t_idx") < cfg.n_months).drop("s"))


CASH_COLS = ["cash_balance", "cash_min_account", "n_cash_accounts_neg", "n_cash_accounts", "credit_drawn",
             "credit_granted", "card_drawn"]


def cm_cash(t: Treasury) -> DataFrame:
    b, cash, typ = F.col("bal_T"), F.col("is_cash"), F.col("type")
    owed = -F.least(b, F.lit(0.0))
    return month_end_balances(t).groupBy("company_id", "t_idx").agg(
        F.sum(F.when(cash, b)).alias("cash_balance"), F.min(F.when(cash, b)).alias("cash_min_account"),
        count_if(cash & (b < 0)).alias("n_cash_accounts_neg"), count_if(cash).alias("n_cash_accounts"),
        F.sum(F.when(typ == "lineofcredit", owed)).alias("credit_drawn"),
        F.sum(F.when(typ == "lineofcredit", F.abs(F.coalesce("granted", F.lit(0.0))))).alias("credit_granted"),
        F.sum(F.when(typ == "card", owed)).alias("card_drawn"))


def invoice_views(t: Treasury) -> DataFrame:
    """Invoices as seen from each of the 12 months whose look-back holds their due date.

    Rows are alike when company, side, due day, payment day and term agree: they are merged with
    a multiplicity before the 12-fold explosion, and dealt by company before it, so that the exploded rows
    and everything grouped by company and more stay where they are.
    """
    cfg = t.cfg
    alike = (fact_invoice(t, "company_id", "issuance_date", "due_date", "amount")
             .groupBy("company_id", "is_payable", F.to_date("due_date").alias("due"),
                      F.to_date("paid_date").alias("paid"),
                      F.datediff("due_date", "issuance_date").alias("term"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("amount")).alias("amt")))
    due_m = month_idx("due", cfg.base)
    first, last = F.greatest(due_m, F.lit(0)), F.least(due_m + 11, F.lit(cfg.n_months - 1))
    start = F.lit(cfg.first_month + "-01").cast("date")
    seen = (alike.where(first <= last).repartition("company_id")     # a company has as many rows as days, paid days and terms at most
            .select("*", due_m.alias("due_m"), F.explode(F.sequence(first, last)).alias("t_idx"))
            .withColumn("next", F.add_months(start, F.col("t_idx") + 1)))
    resolved = F.coalesce(F.col("paid") < F.col("next"), F.lit(False))
    return seen.select(
        "company_id", "t_idx", "is_payable", (F.col("t_idx") - F.col("due_m")).alias("lag"), "n", "amt", "term",
        resolved.alias("resolved"),
        F.when(resolved, F.datediff("paid", "due")).otherwise(F.datediff(F.date_sub("next", 1), "due")).alias("dpd"))


def cm_invoice_lag(t: Treasury) -> DataFrame:
    """Invoice state per (company, month, side, months since due).

    Rows are first counted by whole days of lateness (at most a few hundred values a group); the quantiles are order
    statistics of those counts, read off their running sum.
    """
    keys = ["company_id", "t_idx", "is_payable", "lag"]
    n, amt, dpd, open_ = F.col("n"), F.col("amt"), F.col("dpd"), ~F.col("resolved")
    late = open_ & (dpd > 0)
    days = invoice_views(t).groupBy(*keys, F.greatest(dpd, F.lit(-60)).alias("day")).agg(
        F.sum(n).alias("n"), F.sum(amt).alias("amt"), sum_if(dpd > t.cfg.dpd_bad_days, n).alias("bad"),
        sum_if(late, n).alias("late"), sum_if(late, amt).alias("amt_open_overdue"), sum_if(open_, amt).alias("amt_open"),
        F.max(F.when(open_, dpd)).alias("max_open_dpd"), F.sum(F.col("term") * n).alias("term"))
    group = W.partitionBy(*keys)
    day, total, upto = F.col("day"), F.col("__total"), F.col("__upto")
    days = days.withColumns({"__upto": F.sum("n").over(group.orderBy("day").rowsBetween(W.unboundedPreceding, 0)),
                             "__total": F.sum("n").over(group)})

    def place(q):
        return (total - 1) * F.lit(q)

    def at(rank):                                        # the day whose invoices hold this 0-based rank
        return F.max(F.when((upto - n <= rank) & (rank < upto), day))

    def quantile(q):
        lo, hi, part = F.floor(place(q)), F.ceil(place(q)), F.max(place(q) - F.floor(place(q)))
        return at(lo) * (1 - part) + at(hi) * part
    whole = F.sum(n)
    return days.groupBy(*keys).agg(
        whole.alias("n"), F.sum("amt").alias("amt"), (F.sum(day * n) / whole).alias("dpd_mean"),
        quantile(0.5).alias("dpd_p50"), quantile(0.9).alias("dpd_p90"), (F.sum("bad") / whole).alias("bad_share"),
        (F.sum("late") / whole).alias("open_overdue_share"), F.sum("amt_open_overdue").alias("amt_open_overdue"),
        F.sum("amt_open").alias("amt_open"), F.max("max_open_dpd").alias("max_open_dpd"),
        (F.sum("term") / whole).alias("term_days_mean"))


ISSUED_COLS = ["n_inv_issued", "n_inv_payable", "n_inv_receivable", "amt_inv_payable", "amt_inv_receivable",
               "n_inv_no_counterparty", "n_inv_stress_terms", "n_inv_counterparties"]


def cm_invoice_issued(t: Treasury) -> DataFrame:
    """Monthly invoicing activity; two levels, so counterparties are counted without a raw distinct."""
    a, pay = F.col("amount"), F.col("is_payable")
    per_cp = (fact_invoice(t, "company_id", "issuance_date", "amount", "concept", "counterparty_id")
              .groupBy("company_id", month_idx("issuance_date", t.cfg.base).alias("t_idx"), "counterparty_id").agg(
        F.count(F.lit(1)).alias("n_inv_issued"), count_if(pay).alias("n_inv_payable"),
        count_if(~pay).alias("n_inv_receivable"), sum_if(pay, -a).alias("amt_inv_payable"),
        sum_if(~pay, a).alias("amt_inv_receivable"),
        count_if(F.col("counterparty_id").isNull()).alias("n_inv_no_counterparty"),
        count_if(F.lower(F.coalesce("concept", F.lit(""))).rlike(t.cfg.invoice_stress_terms)).alias("n_inv_stress_terms")))
    return per_cp.groupBy("company_id", "t_idx").agg(
        *[F.sum(c).alias(c) for c in ISSUED_COLS[:-1]], F.count("counterparty_id").alias("n_inv_counterparties"))


def cm_invoice_outcome(t: Treasury) -> DataFrame:
    """Final outcome per due month: classifiable (paid, or over the limit at the snapshot) and bad."""
    paid, due, bad_days = F.col("paid_date"), F.col("due_date"), t.cfg.dpd_bad_days
    open_days = F.datediff(_ts(t.cfg.snapshot), due)
    dpd = F.when(paid.isNotNull(), F.datediff(paid, due)).otherwise(open_days)
    ok = paid.isNotNull() | (open_days > bad_days)
    bad = ok & (dpd > bad_days)
    amt = F.abs("amount")
    return (fact_invoice(t, "company_id", "due_date", "amount")
            .groupBy("company_id", month_idx("due_date", t.cfg.base).alias("t_idx"), "is_payable").agg(
        count_if(ok).alias("n_classifiable"), count_if(bad).alias("n_bad"),
        F.sum(F.when(ok, amt)).alias("amt_classifiable"), F.sum(F.when(bad, amt)).alias("amt_bad")))


CONC_COLS = ["inflow_res", "outflow_res", "hhi_in", "hhi_out", "top1_in_share", "top1_out_share", "n_cp_in",
             "n_cp_out", "n_cp_in_prev", "n_cp_in_lost", "cp_in_churn"]


def counterparty_windows(t: Treasury) -> DataFrame:
    """Per (company, month, counterparty): flows of the last six months and of the six before.

    Monthly rows are dealt by company before the 12-fold explosion, whose rows then need no shuffle."""
    first, last = F.greatest(F.col("m"), F.lit(0)), F.least(F.col("m") + 11, F.lit(t.cfg.n_months - 1))
    cur = F.col("t_idx") - F.col("m") <= 5
    return (monthly(t, "counterparty_month").where((F.col("m") >= -11) & (first <= last)).repartition("company_id")
            .select("*", F.explode(F.sequence(first, last)).alias("t_idx"))
            .groupBy("company_id", "t_idx", "counterparty_id").agg(
        count_if(cur).alias("n_cur"), F.sum(F.when(cur, F.col("inflow"))).alias("inflow"),
        F.sum(F.when(cur, F.col("outflow"))).alias("outflow"),
        sum_if(~cur, F.col("inflow")).alias("inflow_prev")))


def cm_concentration(t: Treasury) -> DataFrame:
    """Concentration of the last six months and customers lost against the six before."""
    i, o, prev = F.col("inflow"), F.col("outflow"), F.col("inflow_prev")
    lost = (prev > 0) & ~F.coalesce(i > 0, F.lit(False))
    g = counterparty_windows(t).groupBy("company_id", "t_idx").agg(
        F.sum("n_cur").alias("__cur"), F.sum(i).alias("inflow_res"), F.sum(o).alias("outflow_res"),
        F.sum(i * i).alias("__ii"), F.sum(o * o).alias("__oo"), F.max(i).alias("__mi"), F.max(o).alias("__mo"),
        count_if(i > 0).alias("n_cp_in"), count_if(o > 0).alias("n_cp_out"),
        count_if(prev > 0).alias("__prev"), count_if(lost).alias("__lost")).where("__cur > 0")

    def over(x, total):
        return F.col(x) / F.nullif(total, F.lit(0.0))

    si, so = F.col("inflow_res"), F.col("outflow_res")
    has = F.col("__prev") > 0
    return g.select("company_id", "t_idx", "inflow_res", "outflow_res",
                    over("__ii", si * si).alias("hhi_in"), over("__oo", so * so).alias("hhi_out"),
                    over("__mi", si).alias("top1_in_share"), over("__mo", so).alias("top1_out_share"),
                    "n_cp_in", "n_cp_out", F.when(has, F.col("__prev")).alias("n_cp_in_prev"),
                    F.when(has, F.col("__lost")).alias("n_cp_in_lost"),
                    F.when(has, F.col("__lost") / F.col("__prev")).alias("cp_in_churn"))


def monthly(t: Treasury, name: str) -> DataFrame:
    """A company-month table (``cm_tx``, ``cm_cash``, …), computed from the facts once and then read by every consumer."""
    make = {"cm_tx": cm_tx, "cm_cash": cm_cash, "cm_concentration": cm_concentration, "cm_invoice_issued": cm_invoice_issued,
            "cm_invoice_outcome": cm_invoice_outcome, "counterparty_month": counterparty_month}[name]
    return staged(t, name, lambda: make(t))


def write_monthly(t: Treasury, names: list[str]) -> None:
    """Write the tables of ``names`` that aren't written yet side by side: each is a chain of steps that leaves cores free."""
    missing = [n for n in names if n not in t.__dict__.get("_staged", {})]
    together(t.spark, [lambda n=n: monthly(t, n) for n in missing])


def named_months(df: DataFrame, t: Treasury) -> DataFrame:
    """Add the month name ``T`` to a table keyed by ordinal."""
    start = F.lit(t.cfg.first_month + "-01").cast("date")
    return df.withColumn("T", F.date_format(F.add_months(start, F.col("t_idx")), "yyyy-MM"))
