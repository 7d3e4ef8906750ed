"""Registered queries against their SQL on the smallest tables, plus invariants."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cashlens.sources.treasury import StarTreasury
from check import compare, duck

SF = "/root/testdata/sf0.001"
SMALL = ["cm_tx", "cm_cash", "cm_invoice_lag", "cm_concentration", "add_health", "j_knn", "dq_integrity", "src_csv",
         "number_grounding", "monitor_stream"]


@pytest.mark.parametrize("name", SMALL)
def test_matches_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]).startswith("ok")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


CUT = "2001-03-01"


class KnownAt(StarTreasury):
    """What was known at the cut: earlier movements, invoices issued earlier, payments made earlier. The balances of the
    snapshot lose what moved since, as month-end balances are rebuilt backwards from them."""

    def _transactions(self, want):
        return super()._transactions([*dict.fromkeys([*want, "date"])]).where(F.col("date") < CUT).select(*want)

    def _invoices(self, want):
        df = super()._invoices([*dict.fromkeys([*want, "issuance_date", "payment_date", "due_date", "status"])]).where(F.col("issuance_date") < CUT)
        late = (F.col("status") == "paid") & (F.col("payment_date") >= CUT)
        return df.withColumns({"payment_date": F.when(late, F.col("due_date")).otherwise(F.col("payment_date")),
                               "status": F.when(late, "overdue").otherwise(F.col("status"))}).select(*want)

    def _balances(self):
        b = super()._balances()
        since = (super()._transactions(["product_id", "amount", "date"]).where(F.col("date") >= CUT).join(b.select("product_id", F.col("date").alias("taken")), "product_id")
                 .where(F.col("date") <= F.date_add("taken", 1)).groupBy("product_id").agg(F.sum("amount").alias("since")))
        return b.join(since, "product_id", "left").withColumn("balance", F.col("balance") - F.coalesce("since", F.lit(0.0))).select(*b.columns)


def test_no_feature_sees_the_future(spark):
    """What becomes known after a month never changes that month's features (size_cohort is pooled over months by definition)."""
    from cashlens.operators.panel import FEATURES, panel

    def rows(cls):
        p = panel(cls(spark, SF), FEATURES).where(F.col("T") < CUT[:7])
        number = {f.name for f in p.schema if f.dataType.typeName() == "double"}
        return {(r["company_id"], r["T"]): r for r in p.select(
            "company_id", "T", *[F.round(c, 4).alias(c) if c in number else c for c in FEATURES]).collect()}
    known, later = rows(KnownAt), rows(StarTreasury)
    assert known.keys() == later.keys() and len(known) > 50

    def same(a, b):
        return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-4 * max(1, abs(a))
    assert not {f for k in known for f in FEATURES if not same(known[k][f], later[k][f])}
