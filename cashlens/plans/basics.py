"""Queries: sources, dimensions, joins, window helpers, sinks and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from cashlens.functions.exprs import country_norm, last_n
from cashlens.operators import company_month as cm, panel as pn, providers as pv, quality, serve as sv, star
from cashlens.operators.labels import group_holdout, labels
from cashlens.operators.scorecard import contributions, scored
from cashlens.plans.registry import QUERIES, query, shape
from cashlens.sources import schemas, sinks, treasury as tr
from cashlens.sources.staging import fresh_path, write_once

PANEL = "company_id T"
SPECS = {
    "src_grid": "t_idx:i T T_start T_next T_end", "src_optional": "group_id n_companies_in_sample:i",
    "src_detect_range": "first_month last_month data_start data_end snapshot_date",
    "src_products": "bank_name service type n:i granted:2 outstanding:2", "src_typed": "table column n:i total:2",
    "src_csv": "product_id company_id type bank_name created_at", "src_parquet": "year_month n:i amount:2",
    "country_norm": "code n:i", "dq_profile": "table column n_rows:i nulls:i failed:i min max out:i", "dq_integrity": "check n:i",
    "dim_company": "company_id group_id country currency erp_any group_size:i", "dim_product": "product_id company_id type bank_name granted:2 is_debt is_cash",
    "fact_tx": "transaction_id company_id product_id amount:2 category product_type bank_name is_cash is_debt",
    "fact_invoice": "company_id issuance_date due_date amount:2 is_payable paid_date", "dim_bank": "bank_name n_products:i n_companies:i",
    "dim_counterparty": "counterparty_id company_id n_tx:i inflow:2 outflow:2", "month_end_balances": "product_id company_id t_idx:i bal_T:2",
    "j_left_dim": "type n:i amount:2", "j_inner": "product_id company_id balance:2 type", "j_cross_grid": "product_id t_idx:i",
    "j_range_later": "product_id t_idx:i bal_T:2", "j_range_invoice": "company_id t_idx:i is_payable lag:i n:i",
    "j_range_conc": "company_id t_idx:i counterparty_id n_cur:i inflow:2 outflow:2", "j_churn": "company_id t_idx:i n_cp_in_prev:i n_cp_in_lost:i",
    "cp_churn": "company_id t_idx:i cp_in_churn:6", "j_anti_orphans": "check n:i", "j_semi_subset": "table n:i", "sink_subset": "table n:i",
    "j_peer": f"{PANEL} sib_io_ratio_w3:6 bank_peer_interest_n_w6:6", "union_products": "product_id type", "union_refs": "n:i",
    "static_counts": "company_id " + " ".join(f"{c}:6" for c in pn.STATIC if "main" not in c), "main_bank": "company_id main_bank main_bank_share:6",
    "loan_terms": "company_id wavg_interest_rate:6 total_periods_mean:6 share_variable_rate:6",
    "inv_window": "company_id t_idx:i n:i dpd_mean:6 bad_share:6 open_overdue_share:6 amt_open_overdue_ratio:6 amt_open_ratio:6 max_open_dpd:i",
    "densify": f"{PANEL} n_tx:i inflow_oper:2 cash_balance:2", "first_active": f"{PANEL} months_in_panel:i",
    "roll": f"{PANEL} s3:2 m6:4 sd6:2 lo3:2 hi12:2", "lag_k": f"{PANEL} lag3:2 d3:2", "roll_slope": f"{PANEL} inflow_trend6:6 io_ratio_trend6:6",
    "cum_flag": f"{PANEL} has_invoices:i", "ffill_gap": f"{PANEL} months_since_last_invoice:i", "qcut4": f"{PANEL} size_cohort",
    "outcome_window": f"{PANEL} neg_cash_share:6 inactivity:6 credit_util:8", "sink_fact": "year_month n:i amount:2",
    "sink_cm": "table n:i total:2", "sink_served": "table n:i total:4", "sink_csv": "company_id T health_smooth:4 health_band", "sink_json": "company_id n_series:i score:1",
    "fingerprint": "table n_rows:i hash_sum hash_xor", "company_profile": "company_id document", "company_score": "company_id document",
    "digest_company": "company_id document", "digest_portfolio": "document", "model_report": "document", "union_holdout_last": "feature mean_abs:6",
}


def q(name):
    def wrap(fn):
        query(name)(lambda t: shape(fn(t), SPECS[name]))
        return fn
    return wrap


q("src_grid")(star.month_grid)
q("src_optional")(lambda t: tr.derive_groups(t.table("companies")))
q("src_detect_range")(lambda t: tr.date_bounds(t.table("transactions", "date"), t.table("balances", "date")))
q("src_products")(lambda t: pv.products(t).groupBy("bank_name", "service", "type").agg(
    F.count(F.lit(1)).alias("n"), F.sum("granted").alias("granted"), F.sum("outstanding").alias("outstanding")))


#: Columns of the eight tables that the test data fill.
RAW = {name: cols.split() for name, cols in {
    "groups": "group_id erp n_companies_in_sample", "companies": "company_id group_id country currency erp created_at",
    "banking_products": "product_id company_id type bank_name service", "debt_products": "product_id company_id type bank_name service granted outstanding",
    "debt_schedule_config": "product_id company_id granted_balance total_periods interest_type", "balances": "product_id company_id date balance",
    "transactions": "transaction_id company_id product_id date amount status accounting_status category description counterparty_id",
    "invoices": "company_id issuance_date due_date payment_date amount status concept counterparty_id"}.items()}


def raw_text(t, name):
    """A table as untrimmed text, as a file would have it; typed values of some companies unreadable or blank."""
    k = F.col("company_id") % 10 if name != "groups" else F.lit(0)
    return t.table(name, *RAW[name]).select(*[
        F.concat(F.col(c).cast("string"), F.lit(" ")).alias(c) if schemas.type_of(name, c) == "string"
        else F.when(k == 3, "bad").when(k == 4, "  ").otherwise(F.concat(F.lit(" "), F.col(c).cast("string"))).alias(c) for c in RAW[name]])


@q("src_typed")
def _typed(t):
    """All eight tables read from text: values of each column that were readable, and the sum of numbers."""
    out = []
    for name in schemas.TABLES:
        df = tr.typed(raw_text(t, name), name)
        number = {c for c in df.columns if schemas.type_of(name, c) in ("double", "int")}
        one = df.agg(*[F.count(c).alias(f"n_{c}") for c in df.columns], *[F.sum(c).alias(f"s_{c}") for c in number])
        out.append(one.select(F.lit(name).alias("table"), F.inline(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), (F.col(f"s_{c}") if c in number else F.lit(None)).cast("double").alias("total")) for c in df.columns]))))
    return reduce(DataFrame.unionByName, out)


q("dq_profile")(lambda t: reduce(DataFrame.unionByName, [
    quality.profile(raw_text(t, n), n).select(F.lit(n).alias("table"), "*") for n in schemas.TABLES]))
q("dq_integrity")(quality.integrity)
q("j_anti_orphans")(quality.integrity)


@q("src_csv")
def _csv(t):
    """Products written as CSV with awkward text and read back through the typed reader."""
    path = fresh_path(t.spark, "csv")
    out = t.table("banking_products").withColumn("label", F.concat_ws("\n", F.lit('say "hi", then'), "label"))
    out.write.option("header", True).option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return tr.typed(tr.read_csv(t.spark, path), "banking_products").withColumns(
        {"product_id": F.col("product_id").cast("long"), "company_id": F.col("company_id").cast("long")})


def _written_facts(t):
    path = fresh_path(t.spark, "transactions")
    sinks.write_fact(t.table("transactions", "transaction_id", "company_id", "date", "amount"), "transactions", path)
    return tr.read_parquet(t.spark, path).groupBy("year_month").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


q("src_parquet")(_written_facts)
q("sink_fact")(_written_facts)
q("country_norm")(lambda t: t.source("nation").select(country_norm(
    F.when(F.col("n_nationkey") % 3 == 0, "España").when(F.col("n_nationkey") % 3 == 1, "spain").otherwise(F.lower("n_name"))).alias("code"))
                  .groupBy("code").agg(F.count(F.lit(1)).alias("n")))
q("dim_company")(star.dim_company)
q("dim_product")(star.dim_product)
q("fact_tx")(lambda t: star.fact_transaction(t, "transaction_id", "company_id", "product_id", "amount", "category"))
q("fact_invoice")(star.fact_invoice)
q("dim_bank")(star.dim_bank)
q("dim_counterparty")(star.dim_counterparty)
for _n in ("month_end_balances", "j_range_later"):
    q(_n)(cm.month_end_balances)
q("j_cross_grid")(cm.month_end_balances)
q("j_left_dim")(lambda t: star.fact_transaction(t, "product_id", "amount").groupBy(F.col("product_type").alias("type")).agg(
    F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")))
q("j_inner")(lambda t: t.table("balances").drop("company_id").join(star.dim_product(t).select("product_id", "company_id", "type"), "product_id"))
q("j_range_invoice")(lambda t: cm.invoice_views(t).groupBy("company_id", "t_idx", "is_payable", "lag").agg(F.sum("n").alias("n")))
q("j_range_conc")(lambda t: cm.counterparty_windows(t).where("n_cur > 0"))
for _n in ("j_churn", "cp_churn"):
    q(_n)(cm.cm_concentration)


def _subset_counts(t):
    tables = {n: t.table(n) for n in schemas.TABLES if n not in ("transactions", "invoices")}
    tables |= {n: t.table(n, "company_id", "amount") for n in ("transactions", "invoices")}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "n")
             for n, df in sinks.subset(tables, group_holdout(t).select("company_id")).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


q("j_semi_subset")(_subset_counts)
q("sink_subset")(_subset_counts)
q("j_peer")(lambda t: pn.panel(t, ["sib_io_ratio_w3", "bank_peer_interest_n_w6"]))
q("union_products")(star.dim_product)
q("union_refs")(lambda t: t.table("transactions", "product_id").groupBy("product_id").agg(F.count(F.lit(1)).alias("k")).join(
    t.table("banking_products", "product_id").unionByName(t.table("debt_products", "product_id")), "product_id", "left_anti")
    .agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")))
for _n in ("static_counts", "main_bank"):
    q(_n)(pn.static_profile)
q("loan_terms")(lambda t: pn.static_profile(t).where("wavg_interest_rate IS NOT NULL"))
q("inv_window")(lambda t: pn.invoice_window(cm.cm_invoice_lag(t), True, 6))
q("densify")(lambda t: pn.dense(t, ["n_tx", "inflow_oper", "cash_balance"]))
q("first_active")(lambda t: pn.panel(t, ["months_in_panel"]))
q("roll")(lambda t: pn.dense(t, ["inflow_oper"]).select("company_id", "T", *[
    pn.roll("inflow_oper", k, how).alias(n) for n, k, how in (("s3", 3, "sum"), ("m6", 6, "mean"), ("sd6", 6, "std"), ("lo3", 3, "min"), ("hi12", 12, "max"))]))
q("lag_k")(lambda t: pn.dense(t, ["cash_balance"]).select("company_id", "T", F.lag("cash_balance", 3).over(pn.order()).alias("lag3"), pn.delta("cash_balance", 3).alias("d3")))
q("roll_slope")(lambda t: pn.panel(t, ["inflow_trend6", "io_ratio_trend6"]))
q("cum_flag")(lambda t: pn.panel(t, ["has_invoices"]))
q("ffill_gap")(lambda t: pn.panel(t, ["months_since_last_invoice"]))
q("qcut4")(lambda t: pn.panel(t, ["size_cohort"]))
q("outcome_window")(labels)


def written(t, tables: dict, write, columns) -> DataFrame:
    """Every table written and read back: rows and filled values of a column of each."""
    out = []
    for name, df in tables.items():
        path, c = fresh_path(t.spark, name), columns[name]
        write(df, path)
        out.append(t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(c).cast("double")).alias("total")).select(
            F.lit(name).alias("table"), "n", "total"))
    return reduce(DataFrame.unionByName, out)


MONTHLY = {"cm_tx": "n_tx", "cm_cash": "cash_balance", "cm_invoice_lag": "n", "cm_invoice_issued": "n_inv_issued", "cm_invoice_outcome": "n_classifiable",
           "cm_concentration": "inflow_res"}
DIMENSIONS = {"dim_company": "company_id", "dim_product": "product_id", "dim_bank": "n_products", "dim_counterparty": "n_tx"}
SERVED = {"risk_score": "score", "company_master": "company_id", "company_kpi": "company_id", "alerts": "company_id", "benchmark": "p50",
          "portfolio_history": "risk", "contrib_local": "rank", "provider_rollup": "products", "change_rank": "company_id"}


@q("sink_cm")
def _sink_cm(t):
    """Six monthly tables by month and four dimensions."""
    monthly = written(t, {n: cm.named_months(QUERIES[n](t.spark, t.dir), t) for n in MONTHLY}, sinks.write_monthly, MONTHLY)
    return monthly.unionByName(written(t, {n: getattr(star, n)(t) for n in DIMENSIONS}, sinks.write_served, DIMENSIONS))


@q("sink_served")
def _sink_served(t):
    """The nine served tables, spread and sorted by company."""
    return written(t, {n: QUERIES[n](t.spark, t.dir) for n in SERVED}, sinks.write_served, SERVED)


@q("sink_csv")
def _sink_csv(t):
    path = fresh_path(t.spark, "predictions")
    sinks.write_csv(sv.at_latest(scored(t)).select("company_id", "T", "health_smooth", "health_band").orderBy("health_smooth"), path)
    return t.spark.read.option("header", True).schema("company_id long, T string, health_smooth double, health_band string").csv(path)


def score_documents(t):
    """Health, trend, last 24 months and drivers of every company as one nested row."""
    series = scored(t).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("T").alias("month"), F.round("health_smooth", 1).alias("score")))).alias("series"))      # one entry per month
    return sv.portfolio(t).join(series, "company_id").select(
        "company_id", "score", "band", "trend", "delta1m", "delta3m", "held_out", last_n("series", 24).alias("series"))


@q("sink_json")
def _sink_json(t):
    path = fresh_path(t.spark, "documents")
    sinks.write_json(score_documents(t), path)
    return t.spark.read.json(path).withColumn("n_series", F.size("series"))


@q("fingerprint")
def _fingerprint(t):
    """All eight tables, and one hash over theirs in fixed order."""
    each = reduce(DataFrame.unionByName, [sinks.fingerprint(t.table(n)).select(F.lit(n).alias("table"), "*") for n in schemas.TABLES])
    each = write_once(each, "fingerprint")                                                     # eight rows
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "table", "n_rows", "hash_sum", "hash_xor")))
    whole = each.agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(lines, "\n"), 256).alias("hash_sum")).select(
        F.lit("all").alias("table"), "n_rows", "hash_sum", F.lit(None).cast("string").alias("hash_xor"))
    return each.unionByName(whole)


def _docs(df, *cols):
    return df.select("company_id", F.to_json(F.struct(*cols)).alias("document"))


q("company_score")(lambda t: _docs(score_documents(t), "score", "band", "trend", "delta1m", "delta3m", "held_out", "series"))


def profile_rows(t):
    """Facts, current state, history, treasury series, changes and benchmark of every company."""
    m = sv.company_master(t)
    hist = sv.risk(t).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(
        "T", F.round("health", 1).alias("health"), F.round("health_smooth", 1).alias("smooth"),
        F.round(100 * (1 - F.col("score_A")), 1).alias("modelA"), F.coalesce(F.col("realized_label") == 1, F.lit(False)).alias("deteriorated")))).alias("history"))
    cash = sv.company_kpi(t).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(
        "T", F.round("cash_balance", 0).alias("cash"), F.round("inflow_oper", 0).alias("inflow"), F.round("outflow_oper", 0).alias("outflow"),
        F.round("pay_dpd_mean_w3", 1).alias("payDelay"), F.round("rec_dpd_mean_w3", 1).alias("collectDelay")))).alias("treasury"))
    chg = sv.at_latest(sv.change_explanations(t)).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "before", "after", "direction"))).alias("changes"))
    bench = sv.company_benchmark(t).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(
        "kpi", "value", "p25", "p50", "p75"))).alias("benchmark"))
    out = m
    for d in (hist, cash, chg, bench):
        out = out.join(d, "company_id", "left")
    return out


q("company_profile")(lambda t: _docs(profile_rows(t), F.struct("group_id", "group_size", "country", "erp", "main_bank", "size_cohort").alias("facts"),
                                     F.struct("latest_health", "latest_health_band", "latest_trajectory").alias("now"), "history", "treasury", "changes", "benchmark"))
q("digest_company")(lambda t: _docs(profile_rows(t).join(sv.portfolio(t).select("company_id", "score", "delta1m", "delta3m", "signal", "top_driver"), "company_id"),
                                    "latest_health_band", "latest_trajectory", "score", "delta1m", "delta3m", "signal", "top_driver",
                                    last_n("treasury", 3).alias("treasury"), "changes", "benchmark"))


@q("digest_portfolio")
def _digest(t):
    """Counts, last twelve months, biggest movers and gravest alerts as one document."""
    p = sv.portfolio(t)
    pick = F.struct("company_id", "score", "delta3m", "signal", "top_driver")

    def top(df, name, *order):
        return df.orderBy(*order, "company_id").limit(5).agg(F.collect_list(pick).alias(name))
    hist = sv.portfolio_history(t).agg(last_n(F.array_sort(F.collect_list(F.struct("T", "solid", "healthy", "watch", "risk", "mean_health"))), 12).alias("months"))
    grave = sv.alerts(t).orderBy(F.desc("severity"), "health_delta_3m", "company_id").limit(5).agg(
        F.collect_list(F.struct("company_id", "alert", "why")).alias("gravest"))
    one = sv.portfolio_counts(p).crossJoin(hist).crossJoin(top(p, "rising", F.desc("delta3m"))).crossJoin(
        top(p, "falling", "delta3m")).crossJoin(grave)                   # single rows
    return one.select(F.to_json(F.struct(*one.columns)).alias("document"))


@q("model_report")
def _report(t):
    """Evaluation figures of the scorecard in one document."""
    from cashlens.operators import evaluation as ev
    from cashlens.plans.projecting import holdout
    m = ev.metrics(holdout(t), "score")
    return m.select(F.to_json(F.struct(*m.columns, F.lit(len(pn.FEATURES)).alias("n_features"))).alias("document"))


@q("union_holdout_last")
def _union_last(t):
    from cashlens.plans.projecting import holdout
    c = contributions(t)
    both = c.join(holdout(t).select("company_id", "T"), ["company_id", "T"], "left_semi").unionByName(sv.at_latest(c))
    return both.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
