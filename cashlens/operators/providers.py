"""Financial providers: products by bank, their kind, and the health of the companies behind them.

Everything is flat: a bank that serves a third of all companies stays spread over many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cashlens.functions.exprs import count_if
from cashlens.operators.serve import portfolio, search
from cashlens.sources.treasury import Treasury

# --- Fixed values: connector root → kind, and product types only a bank grants ---------------
CONNECTOR_KIND = {
    "paypal": "pagos", "stripe": "pagos", "redsys": "pagos", "adyen": "pagos", "sumup": "pagos",
    "gocardless": "pagos", "mollie": "pagos", "embat": "pagos", "embatpayments": "pagos",
    "payhawk": "gastos", "pleo": "gastos", "spendesk": "gastos", "soldo": "gastos",
    "amex": "tarjetas", "iberiacards": "tarjetas",
    "revolut": "fintech", "transferwise": "fintech", "qonto": "fintech", "mercury": "fintech",
    "n26": "fintech", "ebury": "fintech",
    "inhousebanking": "interno",
}
BANK_TYPES = ("checking", "loan", "lineofcredit", "confirming", "leasing", "guarantee", "mortgage", "renting",
              "factoring", "lineofcomex", "risk")


def connector_kind(service: Column) -> Column:
    root = F.split(F.regexp_replace(service, "^_+", ""), "_")[0]
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONNECTOR_KIND.items() for x in kv]), root)


def products(t: Treasury) -> DataFrame:
    """Banking and debt products with labels filled in and liabilities made positive."""
    cols = ["company_id", "bank_name", "service", "type"]
    both = t.table("banking_products", *cols).unionByName(
        t.table("debt_products", *cols, "granted", "outstanding"), allowMissingColumns=True)
    return both.select("company_id", F.coalesce("bank_name", F.lit("Sin identificar")).alias("bank_name"),
                       F.coalesce("service", F.lit("—")).alias("service"), "type",
                       *[F.coalesce(F.abs(F.col(c).try_cast("double")), F.lit(0.0)).alias(c)
                         for c in ("granted", "outstanding")])


def provider_kinds(p: DataFrame) -> DataFrame:
    """Kind per bank: first known connector in name order, else by the products placed."""
    def has(*types):
        return F.bool_or(F.coalesce(F.col("type").isin(*types), F.lit(False)))
    known = connector_kind(F.col("service"))
    g = p.groupBy("bank_name").agg(
        F.min(F.when(known.isNotNull(), F.struct("service", known.alias("kind")))).alias("k"),
        has(*BANK_TYPES).alias("bank"), has("tpv", "wallet").alias("pay"), has("expensesPlatform").alias("exp"),
        has("card").alias("card"), has("investment", "saving").alias("inv"))
    kind = (F.when(F.col("k").isNotNull(), F.col("k.kind")).when(F.col("bank"), "banco").when(F.col("pay"), "pagos")
            .when(F.col("exp"), "gastos").when(F.col("card"), "tarjetas").when(F.col("inv"), "inversión").otherwise("banco"))
    return g.select("bank_name", kind.alias("kind"))


def company_rows(p: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per (bank, company) of the portfolio, with its health."""
    g = p.groupBy("bank_name", "company_id").agg(
        F.count(F.lit(1)).alias("products"), F.sum("granted").alias("granted"), F.sum("outstanding").alias("outstanding"))
    return g.join(rows.select("company_id", "score", "band", "health_band", "trend", "delta3m"), "company_id")


def provider_rollup(p: DataFrame, rows: DataFrame) -> DataFrame:
    """Totals per bank over the companies of the portfolio."""
    p = p.join(rows.select("company_id"), "company_id", "left_semi")
    c, band = company_rows(p, rows), F.col("health_band")
    names = {"riesgo": "n_risk", "vigilar": "n_watch", "sana": "n_healthy", "sólida": "n_solid"}
    g = c.groupBy("bank_name").agg(
        F.count(F.lit(1)).alias("companies"), F.sum("products").alias("products"),
        *[count_if(band == b).alias(n) for b, n in names.items()], F.avg("score").alias("mean_health"),
        count_if(F.col("trend") == "down").alias("slipping"), count_if(F.col("trend") == "up").alias("improving"),
        F.sum("granted").alias("granted"), F.sum("outstanding").alias("outstanding"))
    services = p.groupBy("bank_name").agg(F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"))
    return (g.join(provider_kinds(p), "bank_name").join(services, "bank_name")
            .withColumn("risk_share", F.col("n_risk") / F.col("companies")))


def provider_types(p: DataFrame, rows: DataFrame) -> DataFrame:
    return (p.join(rows.select("company_id"), "company_id", "left_semi").groupBy("bank_name", "type")
            .agg(F.count(F.lit(1)).alias("n")))


def provider_totals(p: DataFrame, rows: DataFrame) -> DataFrame:
    q = p.join(rows.select("company_id"), "company_id", "left_semi").agg(
        F.countDistinct("bank_name").alias("providers"), F.countDistinct("service").alias("connectors"),
        F.count(F.lit(1)).alias("products"))
    return q.crossJoin(rows.agg(F.count(F.lit(1)).alias("companies")))       # two single rows


def provider_filter(df: DataFrame, kind=None, relevant=False, financing=False, text=None) -> DataFrame:
    if kind:
        df = df.where(F.col("kind") == kind)
    if relevant:
        df = df.where(F.col("companies") >= 10)
    if financing:
        df = df.where(F.col("outstanding") > 0)
    return search(df, text, "bank_name", "services")


PROVIDER_ORDERS = {"companies": ["-companies"], "risk": ["-n_risk", "-risk_share"], "slipping": ["-slipping"],
                   "health": ["mean_health"], "debt": ["-outstanding"]}


def provider_order(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(*[F.expr(e) for e in PROVIDER_ORDERS[order]], "bank_name")


def lowest_companies(c: DataFrame, n: int | None = None) -> DataFrame:
    """Every provider's companies by rank of health; only the n least healthy where n is given (cut before the shuffle)."""
    w = W.partitionBy("bank_name").orderBy("score", "company_id")
    return c.withColumn("rank", F.row_number().over(w)).where(F.lit(True) if n is None else F.col("rank") <= n)


def connector_counts(roll: DataFrame, rows: DataFrame) -> DataFrame:
    """Top real banks by companies and top ERPs by companies."""
    banks = (roll.where((F.col("kind") == "banco") & ~F.lower("bank_name").startswith("other"))
             .select(F.lit("bank").alias("what"), F.col("bank_name").alias("name"), F.col("companies").alias("n"))
             .orderBy(F.desc("n"), "name").limit(10))
    erps = (rows.where(F.col("erp") != "NONE").groupBy(F.col("erp").alias("name")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit("erp").alias("what"), "name", "n").orderBy(F.desc("n"), "name").limit(8))
    return banks.unionByName(erps)


def company_providers(p: DataFrame, rows: DataFrame) -> DataFrame:
    """Per company: providers, products, live balance."""
    return company_rows(p, rows).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("providers"), F.sum("products").alias("products"),
        F.sum("outstanding").alias("outstanding"))


def rollup(t: Treasury) -> DataFrame:
    return provider_rollup(products(t), portfolio(t))
