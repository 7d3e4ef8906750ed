"""Dimensions, facts and the month grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cashlens.config import CASH_TYPES
from cashlens.functions.exprs import sum_if
from cashlens.sources.treasury import Treasury

PRODUCT_COLS = ["product_id", "company_id", "label", "type", "bank_name", "service", "currency", "created_at"]


def month_grid(t: Treasury) -> DataFrame:
    """One row per panel month: ordinal, name, first instant, next month, last second."""
    start = F.add_months(F.lit(t.cfg.first_month + "-01").cast("date"), F.col("t_idx"))
    return (t.spark.range(t.cfg.n_months, numPartitions=1).select(F.col("id").cast("int").alias("t_idx"))
            .select("t_idx", F.date_format(start, "yyyy-MM").alias("T"), start.cast("timestamp").alias("T_start"),
                    F.add_months(start, 1).cast("timestamp").alias("T_next"))
            .withColumn("T_end", F.col("T_next") - F.expr("INTERVAL 1 SECOND")))


def dim_company(t: Treasury) -> DataFrame:
    g = t.table("groups").select("group_id", F.col("erp").alias("group_erp"),
                                 F.col("n_companies_in_sample").alias("group_size"))
    return (t.table("companies").join(g, "group_id", "left")
            .select("company_id", "group_id", "country", "currency", "erp", "created_at", "group_size",
                    F.coalesce("erp", "group_erp").alias("erp_any")))


def dim_product(t: Treasury) -> DataFrame:
    bank = t.table("banking_products").select(*PRODUCT_COLS).withColumns(
        {"is_debt": F.lit(False), "is_cash": F.col("type").isin(*CASH_TYPES)})
    debt = t.table("debt_products").select(*PRODUCT_COLS, "granted", "outstanding", "liquidity").withColumns(
        {"is_debt": F.lit(True), "is_cash": F.lit(False)})
    return bank.unionByName(debt, allowMissingColumns=True)


def dim_bank(t: Treasury) -> DataFrame:
    return dim_product(t).groupBy("bank_name").agg(
        F.count(F.lit(1)).alias("n_products"), F.countDistinct("company_id").alias("n_companies"))


def dim_counterparty(t: Treasury) -> DataFrame:
    a = F.col("amount")
    return (t.table("transactions", "company_id", "counterparty_id", "amount")
            .where(F.col("counterparty_id").isNotNull()).groupBy("counterparty_id", "company_id")
            .agg(F.count(F.lit(1)).alias("n_tx"), sum_if(a > 0, a).alias("inflow"), sum_if(a < 0, -a).alias("outflow")))


def amount(t: Treasury):
    """Raw signed amount, or converted when the configuration asks for it (default off)."""
    return F.col("amount") * F.col("exchange_rate") if t.cfg.normalise_currency else F.col("amount")


def fact_transaction(t: Treasury, *cols: str) -> DataFrame:
    """Movements with their product's attributes; unknown products stay with NULLs."""
    dim = dim_product(t).select("product_id", F.col("type").alias("product_type"), "bank_name", "is_cash", "is_debt")
    return t.table("transactions", *cols).join(dim, "product_id", "left")


def fact_invoice(t: Treasury, *cols: str) -> DataFrame:
    """Invoices in scope with their side. ``paid_date`` exists only for paid ones: an overdue
    invoice carries its due date as a placeholder payment date."""
    cols = cols or ("company_id", "issuance_date", "due_date", "amount", "concept", "counterparty_id")
    need = tuple(dict.fromkeys([*cols, "status", "amount", "due_date", "payment_date"]))
    lo, hi = F.lit(t.cfg.invoice_min).cast("timestamp"), F.lit(t.cfg.invoice_max).cast("timestamp")
    pay = F.col("payment_date")
    return (t.table("invoices", *need)
            .where((F.col("status") != "cancel") & (F.col("amount") != 0) & F.col("due_date").between(lo, hi)
                   & (pay.isNull() | pay.between(lo, hi)))
            .withColumns({"is_payable": F.col("amount") < 0,
                          "paid_date": F.when(F.col("status") == "paid", pay)})
            .select(*cols, "is_payable", "paid_date", *(["status"] if "status" not in cols else [])))
