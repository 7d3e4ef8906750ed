"""SQL of source, dimension, join, window and sink queries."""

from cashlens.plans.basics import SPECS
from oracle import shape
from oracle.base import cte
from oracle import core, serving
import oracle.projecting  # noqa: F401

SQL = {}


def S(name, source):
    SQL[name] = shape(source, SPECS[name])


S("src_grid", "grid")
S("src_optional", "(SELECT group_id, count(*) AS n_companies_in_sample FROM companies GROUP BY 1)")
S("src_detect_range", """(SELECT strftime(lo, '%Y-%m') AS first_month, strftime(last_, '%Y-%m') AS last_month, strftime(lo, '%Y-%m-01') AS data_start,
    strftime(last_ + INTERVAL 1 MONTH, '%Y-%m-%d') AS data_end, strftime(snap, '%Y-%m-%d') AS snapshot_date FROM (
  SELECT *, CASE WHEN day(d) < 28 THEN date_trunc('month', d) - INTERVAL 1 MONTH ELSE date_trunc('month', d) END AS last_ FROM (
  SELECT *, least(snap, date_trunc('day', hi)) AS d FROM (SELECT min(date) AS lo, max(date) AS hi FROM transactions), (SELECT max(date) AS snap FROM balances))))""")
S("src_products", "(SELECT bank_name, service, type, count(*) AS n, sum(granted) AS granted, sum(outstanding) AS outstanding FROM prods GROUP BY 1, 2, 3)")
TEXT, NUM, WHEN = None, "DOUBLE", "TIMESTAMP"
RAW = {                                            # columns of each table and what they are read as
    "groups": dict(group_id=TEXT, erp=TEXT, n_companies_in_sample="INTEGER"),
    "companies": dict(company_id=TEXT, group_id=TEXT, country=TEXT, currency=TEXT, erp=TEXT, created_at=WHEN),
    "banking_products": dict(product_id=TEXT, company_id=TEXT, type=TEXT, bank_name=TEXT, service=TEXT),
    "debt_products": dict(product_id=TEXT, company_id=TEXT, type=TEXT, bank_name=TEXT, service=TEXT, granted=NUM, outstanding=NUM),
    "debt_schedule_config": dict(product_id=TEXT, company_id=TEXT, granted_balance=NUM, total_periods="INTEGER", interest_type=TEXT),
    "balances": dict(product_id=TEXT, company_id=TEXT, date=WHEN, balance=NUM),
    "transactions": dict(transaction_id=TEXT, company_id=TEXT, product_id=TEXT, date=WHEN, amount=NUM, status=TEXT, accounting_status=TEXT, category=TEXT,
                         description=TEXT, counterparty_id=TEXT),
    "invoices": dict(company_id=TEXT, issuance_date=WHEN, due_date=WHEN, payment_date=WHEN, amount=NUM, status=TEXT, concept=TEXT, counterparty_id=TEXT)}


def raw(table, c, t):
    if t is None:
        return f"nullif(trim({c}::VARCHAR || ' '), '')"
    if table == "groups":
        return f"nullif(trim({c}::VARCHAR), '')"
    return f"nullif(trim(CASE company_id % 10 WHEN 3 THEN 'bad' WHEN 4 THEN '  ' ELSE {c}::VARCHAR END), '')"


def prof(table, c, t):
    txt = raw(table, c, t)
    val = f"TRY_CAST({txt} AS {t})" if t else txt
    rng = (f"strftime(min({val}), '%Y-%m-%d %H:%M:%S'), strftime(max({val}), '%Y-%m-%d %H:%M:%S'), count(*) FILTER ({val} < TIMESTAMP '2023-01-01' OR {val} > TIMESTAMP '2028-12-31')"
           if t == WHEN else "CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), NULL")
    return (f"SELECT '{table}', '{c}', count(*), count(*) FILTER ({val} IS NULL), count(*) FILTER ({txt} IS NOT NULL AND {val} IS NULL), {rng} "
            f"FROM {table.replace('_config', '')}")


def read(table, c, t):
    val = f"TRY_CAST({raw(table, c, t)} AS {t})" if t else raw(table, c, t)
    return f"SELECT '{table}', '{c}', count({val}), " + (f"sum({val})" if t in (NUM, "INTEGER") else "NULL") + f" FROM {table.replace('_config', '')}"


S("dq_profile", "(SELECT * FROM (" + " UNION ALL ".join(prof(n, c, t) for n, cs in RAW.items() for c, t in cs.items())
  + ') v("table", "column", n_rows, nulls, failed, min, max, "out"))')
S("src_typed", "(SELECT * FROM (" + " UNION ALL ".join(read(n, c, t) for n, cs in RAW.items() for c, t in cs.items()) + ') v("table", "column", n, total))')
_p = "(SELECT product_id FROM banking_products UNION ALL SELECT product_id FROM debt_products)"
_checks = [("companies.group_id_orphans", "companies c WHERE NOT EXISTS (SELECT 1 FROM groups g WHERE g.group_id = c.group_id)")]
_checks += [(f"{t}.company_orphans", f"{t} x WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.company_id = x.company_id)")
            for t in ("banking_products", "debt_products", "balances", "transactions", "invoices")]
_checks += [(f"{t}.product_orphans", f"{t} WHERE product_id NOT IN {_p}") for t in ("balances", "transactions")]
_checks += [(f"companies.without_{t}", f"companies WHERE company_id NOT IN (SELECT company_id FROM {t})") for t in ("transactions", "invoices")]
for _n in ("dq_integrity", "j_anti_orphans"):
    S(_n, "(SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}', count(*) FROM {v}" for k, v in _checks) + ') v("check", n))')
S("src_csv", "(SELECT *, TIMESTAMP '1998-06-01' AS created_at FROM banking_products)")
for _n in ("src_parquet", "sink_fact"):
    S(_n, "(SELECT strftime(date, '%Y-%m') AS year_month, count(*) AS n, sum(amount) AS amount FROM transactions GROUP BY 1)")
S("country_norm", """(SELECT CASE WHEN c IN ('ESPAÑA','ESPANA','SPAIN') THEN 'ES' ELSE c END AS code, count(*) AS n FROM (
  SELECT upper(CASE n_nationkey % 3 WHEN 0 THEN 'España' WHEN 1 THEN 'spain' ELSE lower(n_name) END) AS c FROM nation) GROUP BY 1)""")
S("dim_company", "dim_company")
S("dim_product", "dim_product")
S("fact_tx", "fact_transaction")
S("fact_invoice", "fact_invoice")
S("dim_bank", "(SELECT bank_name, count(*) AS n_products, count(DISTINCT company_id) AS n_companies FROM dim_product GROUP BY 1)")
S("dim_counterparty", """(SELECT counterparty_id, company_id, count(*) AS n_tx, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS inflow,
  sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS outflow FROM transactions WHERE counterparty_id IS NOT NULL GROUP BY 1, 2)""")
for _n in ("month_end_balances", "j_range_later", "j_cross_grid"):
    S(_n, "(SELECT *, at_end AS bal_T FROM month_end WHERE t_idx < 24)")
S("j_left_dim", "(SELECT product_type AS type, count(*) AS n, sum(amount) AS amount FROM fact_transaction GROUP BY 1)")
S("j_inner", "(SELECT b.product_id, p.company_id, b.balance, p.type FROM balances b JOIN dim_product p USING (product_id))")
S("j_range_invoice", "(SELECT company_id, t_idx, is_payable, lag, count(*) AS n FROM bill_seen GROUP BY ALL)")
S("j_range_conc", "(SELECT company_id, t_idx, counterparty_id, recent AS n_cur, got AS inflow, gave AS outflow FROM party_window WHERE recent > 0)")
for _n in ("j_churn", "cp_churn"):
    S(_n, "cm_concentration")
_ids = "company_id IN (SELECT company_id FROM reserved)"
for _n in ("j_semi_subset", "sink_subset"):
    S(_n, "(" + " UNION ALL ".join(
        [f"SELECT 'groups' AS \"table\", count(*) AS n FROM groups WHERE group_id IN (SELECT group_id FROM companies WHERE {_ids})"]
        + [f"SELECT '{a}', count(*) FROM {b} WHERE {_ids}" for a, b in (("companies", "companies"), ("banking_products", "banking_products"), ("debt_products", "debt_products"),
            ("debt_schedule_config", "debt_schedule"), ("balances", "balances"), ("transactions", "transactions"), ("invoices", "invoices"))]) + ")")
for _n in ("j_peer", "roll_slope", "cum_flag", "ffill_gap", "qcut4", "first_active"):
    S(_n, "features")
S("union_products", "dim_product")
S("union_refs", f"(SELECT count(*) AS n FROM transactions WHERE product_id NOT IN {_p})")
for _n in ("static_counts", "main_bank"):
    S(_n, "static_profile")
S("loan_terms", "loan_terms")
S("inv_window", "pay6")
S("densify", "(SELECT x.company_id, x.T, x.n_tx, x.inflow_oper, h.cash_balance FROM dense_tx x JOIN dense_cash h USING (company_id, t_idx))")
S("roll", """(SELECT company_id, T, sum(inflow_oper) OVER w3 AS s3, avg(inflow_oper) OVER w6 AS m6, stddev_samp(inflow_oper) OVER w6 AS sd6, min(inflow_oper) OVER w3 AS lo3,
  max(inflow_oper) OVER w12 AS hi12 FROM dense_tx WINDOW """ + ", ".join(f"w{k} AS (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (3, 6, 12)) + ")")
S("lag_k", "(SELECT company_id, T, lag(cash_balance, 3) OVER w AS lag3, cash_balance - lag(cash_balance, 3) OVER w AS d3 FROM dense_cash WINDOW w AS (PARTITION BY company_id ORDER BY t_idx))")
S("outcome_window", "label_rows")


def counted(name, sources):
    S(name, "(" + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n, sum(CAST({c} AS DOUBLE)) AS total FROM ({q})" for n, q, c in sources) + ")")


counted("sink_cm", [(n, core.SQL[n], c) for n, c in (("cm_tx", "n_tx"), ("cm_cash", "cash_balance"), ("cm_invoice_lag", "n"), ("cm_invoice_issued", "n_inv_issued"),
                    ("cm_invoice_outcome", "n_classifiable"), ("cm_concentration", "inflow_res"))]
        + [(n, SQL[n] if n in SQL else f"SELECT * FROM {n}", c) for n, c in (("dim_company", "company_id"), ("dim_product", "product_id"), ("dim_bank", "n_products"), ("dim_counterparty", "n_tx"))])
counted("sink_served", [(n, serving.SQL[n], c) for n, c in (
    ("risk_score", "score"), ("company_master", "company_id"), ("company_kpi", "company_id"), ("alerts", "company_id"), ("benchmark", "p50"), ("portfolio_history", "risk"),
    ("contrib_local", "rank"), ("provider_rollup", "products"), ("change_rank", "company_id"))])
S("sink_csv", "risk_now")
S("sink_json", "(SELECT company_id, score, (SELECT count(*) FROM risk r WHERE r.company_id = p.company_id) AS n_series FROM port p)")
S("union_holdout_last", """(SELECT feature, avg(abs(phi)) AS mean_abs FROM (SELECT c.feature, c.phi FROM contribs c JOIN hold h ON h.company_id = c.company_id AND h.T = c.T
  UNION ALL SELECT feature, phi FROM contribs WHERE T = (SELECT max(T) FROM contribs)) GROUP BY 1)""")
