"""Labels, scorecard, health series and contributions in SQL."""

from __future__ import annotations

from oracle.base import cte
import oracle.panel  # noqa: F401  (defines the features CTE first)

W5 = {"late_pay_rate": 0.30, "neg_cash_share": 0.25, "collection_drop": 0.20, "credit_util": 0.10, "inactivity": 0.15}
D = "::DOUBLE"
# scorecard: block, weight and mean of each feature
CARD = {f: (block, float(w), float(mean)) for f, block, w, mean in (line.split() for line in """
cash_neg_months_w3 C 0.45 1.2
cash_months_of_outflow A -0.05 1.0
days_of_cash C -0.001 20.0
io_ratio_w3 C -0.5 1.1
inflow_w3_vs_w12 C -0.6 1.0
pay_open_overdue_share_w3 B 1.4 0.35
pay_bad_share_w6 B 1.1 0.4
rec_dpd_mean_w6 B 0.015 20.0
interest_n_w3 C 0.08 1.0
credit_util_T A 0.9 0.05
top1_in_share D 0.8 0.15
stress_terms_rate_w3 F 0.7 0.25
months_in_panel A -0.01 12.0
group_size A 0.005 5.0
sib_cash_neg_months_w6 E 0.05 2.4
cash_conversion_days_w6 C 0.004 45.0
pay_dpd_mean_w6 B 0.012 12.0
debt_service_ratio_w6 A 0.6 0.2
""".strip().splitlines())}
WEIGHTS = {f: (w, mean) for f, (_, w, mean) in CARD.items()}
WEIGHTS_A = {f: WEIGHTS[f] for f in ("cash_months_of_outflow", "credit_util_T", "months_in_panel", "group_size")}
INTERCEPT, CALIBRATION = -1.9, (0.9, -0.1)

# ------------------------------------------------------------------------------------- labels
cte("reserved", """
SELECT company_id, group_id FROM companies WHERE group_id IN (
  SELECT group_id FROM (
    SELECT group_id, n, coalesce(sum(n) OVER (ORDER BY md5('42:' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT group_id, count(*) AS n FROM companies GROUP BY 1) WHERE n <= 60) WHERE before < 20)""")
cte("lab_in", """
SELECT x.company_id, x.t_idx, x.T, x.n_tx, x.inflow_oper, x.outflow_oper, h.cash_balance, h.credit_drawn, h.credit_granted,
       coalesce(o.n_classifiable, 0) AS n_classifiable, coalesce(o.n_bad, 0) AS n_bad
FROM dense_tx x JOIN dense_cash h USING (company_id, t_idx)
LEFT JOIN (SELECT * FROM cm_invoice_outcome WHERE is_payable) o USING (company_id, t_idx)""")
cte("lab_win", """
SELECT company_id, T, t_idx, sum(n_classifiable) OVER f AS n_cls, sum(n_bad) OVER f AS n_bd, count(cash_balance) OVER f AS n_cash,
    avg(CASE WHEN cash_balance < 0 THEN 1.0::DOUBLE ELSE 0 END) OVER f AS neg, avg(inflow_oper) OVER f AS in_after, avg(inflow_oper) OVER b AS in_before,
    avg(CASE WHEN credit_granted > 0 THEN credit_drawn / credit_granted END) OVER f AS credit_util,
    avg(CASE WHEN n_tx = 0 THEN 1.0::DOUBLE ELSE 0 END) OVER f AS inactivity, avg(outflow_oper) OVER b AS size_outflow_6m,
    sum(n_tx) OVER (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent
FROM lab_in WINDOW f AS (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN 2 FOLLOWING AND 7 FOLLOWING),
                   b AS (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
cte("lab_comp", """
SELECT company_id, T, t_idx, CASE WHEN n_cls >= 3 THEN n_bd / n_cls END AS late_pay_rate, CASE WHEN n_cash > 0 THEN neg END AS neg_cash_share,
    CASE WHEN in_before > 0 THEN least(greatest(1 - in_after / in_before, -1), 1) END AS collection_drop, credit_util, inactivity,
    size_outflow_6m, company_id IN (SELECT company_id FROM reserved) AS is_reserved
FROM lab_win WHERE t_idx <= 16 AND recent > 0""")
cte("lab_edges", "SELECT " + ", ".join(f"quantile_cont(size_outflow_6m, {q}{D}) AS e{i}" for i, q in ((1, .25), (2, .5), (3, .75)))
    + ", " + ", ".join(f"quantile_cont({c}, 0.01{D}) AS lo_{c}, quantile_cont({c}, 0.99{D}) AS hi_{c}" for c in W5)
    + " FROM lab_comp WHERE NOT is_reserved")
cte("lab_v", "SELECT c.*, CASE WHEN size_outflow_6m <= e1 THEN 'q1' WHEN size_outflow_6m <= e2 THEN 'q2' WHEN size_outflow_6m <= e3 THEN 'q3' ELSE 'q4' END AS size_cohort, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END AS v_{c}" for c in W5)
    + " FROM lab_comp c, lab_edges")
cte("lab_stats", "SELECT size_cohort, " + ", ".join(f"avg(v_{c}) AS mu_{c}, stddev_samp(v_{c}) AS sd_{c}" for c in W5)
    + " FROM lab_v WHERE NOT is_reserved GROUP BY 1")
cte("lab_z", "SELECT v.*, " + ", ".join(f"(v_{c} - mu_{c}) / nullif(sd_{c}, 0) AS z_{c}" for c in W5)
    + " FROM lab_v v LEFT JOIN lab_stats USING (size_cohort)")
cte("lab_d", "SELECT *, " + " + ".join(f"(z_{c} IS NOT NULL)::INTEGER" for c in W5) + " AS n_components, ("
    + " + ".join(f"coalesce(z_{c} * {w}{D}, 0)" for c, w in W5.items()) + ") / nullif("
    + " + ".join(f"CASE WHEN z_{c} IS NOT NULL THEN {w}{D} ELSE 0 END" for c, w in W5.items()) + ", 0) AS D FROM lab_z")
cte("label_rows", f"""
SELECT *, CASE WHEN D > threshold THEN 1 ELSE 0 END AS y
FROM (SELECT * FROM lab_d WHERE n_components >= 2),
     (SELECT quantile_cont(D, 0.85{D}) AS threshold FROM lab_d WHERE n_components >= 2 AND NOT is_reserved)""")

# ---------------------------------------------------------------------------------- scorecard


def phi(f, w=WEIGHTS):
    return f"coalesce({w[f][0]}{D} * ({f} - {w[f][1]}{D}), 0)"


def logodds(w=WEIGHTS):
    return f"({INTERCEPT}{D} + " + " + ".join(phi(f, w) for f in w) + ")"


def sig(z): return f"(1.0{D} / (1.0{D} + exp(-({z}))))"


def cal(p):
    q = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return sig(f"{CALIBRATION[0]}{D} * ln({q} / (1 - {q})) + ({CALIBRATION[1]}{D})")


cte("scored0", f"SELECT *, round({sig(logodds())}, 8) AS score_raw, round({sig(logodds(WEIGHTS_A))}, 6) AS score_A FROM features")
cte("scored1", f"SELECT *, round({cal('score_raw')}, 6) AS score FROM scored0")


def health_ctes(prefix: str, source: str) -> str:
    """Health rules over ``source`` (company_id, t_idx, score, …)."""
    o = "(PARTITION BY company_id ORDER BY t_idx)"
    cte(f"{prefix}h1", f"SELECT *, 100 * (1 - score) AS health FROM {source}")
    cte(f"{prefix}h2", f"""SELECT *, list_reduce(list(health) OVER (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        lambda a, v : 0.5{D} * v + 0.5{D} * a) AS health_smooth FROM {prefix}h1""")
    cte(f"{prefix}h3", f"""SELECT *, health_smooth - lag(health_smooth, 1) OVER {o} AS health_delta_1m, health_smooth - lag(health_smooth, 3) OVER {o} AS health_delta_3m,
        health - lag(health, 1) OVER {o} AS raw1, row_number() OVER {o} AS rn FROM {prefix}h2""")
    cte(f"{prefix}h4", f"""SELECT *, CASE
        WHEN health_delta_3m <= -8 AND count(*) FILTER (health_delta_1m < 0) OVER l3 >= least(2, count(health_delta_1m) OVER l3) THEN 'deteriorándose'
        WHEN health_delta_3m >= 8 AND count(*) FILTER (health_delta_1m > 0) OVER l3 >= least(2, count(health_delta_1m) OVER l3) THEN 'mejorando'
        ELSE 'estable' END AS trajectory
        FROM {prefix}h3 WINDOW l3 AS (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
    cte(f"{prefix}h5", f"""SELECT *,
        coalesce(lag(raw1) OVER {o} <= -8 AND raw1 >= 0.6{D} * abs(lag(raw1) OVER {o}), FALSE) AS is_blip,
        count(*) FILTER (trajectory = 'deteriorándose') OVER (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS is_structural,
        count(*) FILTER (health_smooth >= 90) OVER (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 AS is_exceptional,
        CASE WHEN health_smooth >= 90 THEN 'sólida' WHEN health_smooth >= 75 THEN 'sana' WHEN health_smooth >= 50 THEN 'vigilar' ELSE 'riesgo' END AS health_band
        FROM {prefix}h4""")
    cte(f"{prefix}scored", f"""SELECT *, CASE WHEN is_structural THEN 'caída estructural' WHEN health_delta_1m <= -10 THEN 'caída brusca este mes'
        WHEN trajectory = 'deteriorándose' THEN 'deterioro incipiente' WHEN trajectory = 'mejorando' THEN 'mejora progresiva'
        WHEN is_exceptional THEN 'excepcionalmente sólida' ELSE '' END AS alert FROM {prefix}h5""")
    return f"{prefix}scored"


health_ctes("sc_", "scored1")
cte("contribs", " UNION ALL ".join(
    f"SELECT company_id, T, t_idx, score, '{f}' AS feature, '{b}' AS block, CAST({f} AS DOUBLE) AS value, round({phi(f)}, 8) AS phi FROM scored1"
    for f, (b, _, _) in CARD.items()))
