"""Data quality: column profile and referential integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cashlens.functions.exprs import clean_text, count_if
from cashlens.sources import schemas
from cashlens.sources.staging import write_once


def profile(raw: DataFrame, name: str) -> DataFrame:
    """Nulls, failed casts and date range per column of a text table, in one pass over the data."""
    aggs, cols = [F.count(F.lit(1)).alias("n")], raw.columns
    lo, hi = F.lit("2023-01-01").cast("timestamp"), F.lit("2028-12-31").cast("timestamp")
    for c in cols:
        txt, typ = clean_text(F.col(c)), schemas.type_of(name, c)
        val = txt.try_cast(typ) if typ != "string" else txt
        aggs += [count_if(val.isNull()).alias(f"{c}__nulls"), count_if(txt.isNotNull() & val.isNull()).alias(f"{c}__failed")]
        if typ == "timestamp":
            aggs += [F.min(val).cast("string").alias(f"{c}__min"), F.max(val).cast("string").alias(f"{c}__max"),
                     count_if((val < lo) | (val > hi)).alias(f"{c}__out")]
    one = raw.agg(*aggs)

    def get(c, what, t):
        n = f"{c}__{what}"
        return (F.col(n) if n in one.columns else F.lit(None)).cast(t).alias(what)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), get(c, "nulls", "long"), get(c, "failed", "long"),
                              get(c, "min", "string"), get(c, "max", "string"), get(c, "out", "long")) for c in cols])
    return one.select(F.inline(rows))


def integrity(t) -> DataFrame:
    """Ten orphan and coverage counts. A NULL key is an orphan of a left join but not of NOT IN.

    Each fact is read once and collapsed to its (company, product) pairs. Every table then contributes rows of
    (space, key, how many rows, whether it defines the key); one aggregate by key has all ten checks."""
    tx = write_once(t.table("transactions", "company_id", "product_id").groupBy("company_id", "product_id").agg(F.count(F.lit(1)).alias("k")), "dq-pairs")
    inv = t.table("invoices", "company_id").groupBy("company_id").agg(F.count(F.lit(1)).alias("k"))
    balances = t.table("balances", "company_id", "product_id").groupBy("company_id", "product_id").agg(F.count(F.lit(1)).alias("k"))

    def rows(df, space, key, what, k=F.lit(1)):
        return df.select(F.lit(space).alias("space"), F.col(key).cast("string").alias("key"), F.lit(what).alias("what"), k.cast("long").alias("k"))
    k, company, product = F.col("k"), "company_id", "product_id"
    bank, debt, companies = t.table("banking_products", company, product), t.table("debt_products", company, product), t.table("companies", company, "group_id")
    parts = [
        rows(t.table("groups", "group_id"), "group", "group_id", "known"), rows(companies, "group", "group_id", "companies"),
        rows(companies, "company", company, "known"), rows(bank, "company", company, "banking_products"), rows(debt, "company", company, "debt_products"),
        rows(balances, "company", company, "balances", k), rows(tx, "company", company, "transactions", k), rows(inv, "company", company, "invoices", k),
        rows(bank, "product", product, "known"), rows(debt, "product", product, "known"),
        rows(balances, "product", product, "balances", k), rows(tx, "product", product, "transactions", k)]
    kinds = ("companies", "banking_products", "debt_products", "balances", "transactions", "invoices")
    n = {w: F.sum(F.when(F.col("what") == w, F.col("k")).otherwise(0)).alias(w) for w in ("known", *kinds)}
    by_key = reduce(DataFrame.unionByName, parts).groupBy("space", "key").agg(*n.values())

    def orphans(space, what, null_counts=True):
        lost = (F.col("space") == space) & ((F.col("known") == 0) | F.col("key").isNull())
        return F.when(lost if null_counts else lost & F.col("key").isNotNull(), F.col(what)).otherwise(0)

    def without(what):
        return F.when((F.col("space") == "company") & F.col("key").isNotNull() & (F.col(what) == 0), F.col("known")).otherwise(0)
    checks = {"companies.group_id_orphans": orphans("group", "companies"),
              **{f"{w}.company_orphans": orphans("company", w) for w in ("banking_products", "debt_products", "balances", "transactions", "invoices")},
              **{f"{w}.product_orphans": orphans("product", w, False) for w in ("balances", "transactions")},
              **{f"companies.without_{w}": without(w) for w in ("transactions", "invoices")}}
    one = by_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"c{i}") for i, c in enumerate(checks.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("n")) for i, name in enumerate(checks)])))
