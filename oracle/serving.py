"""SQL of served tables, portfolio, providers, explanations and anticipation."""

from cashlens.functions.wording import FEATURE_METRIC, FEATURE_TEXT, PROFILE
from cashlens.operators.providers import BANK_TYPES, CONNECTOR_KIND
from cashlens.operators.serve import BENCH_KPIS, KPI_COLS
from cashlens.plans.serving import DESCRIBED, SPECS
from oracle import shape
from oracle.base import cte
import oracle.scored  # noqa: F401


def lit(s): return "'" + s.replace("'", "''") + "'"
def values(rows): return ", ".join("(" + ", ".join(lit(x) if x is not None else "CAST(NULL AS VARCHAR)" for x in r) + ")" for r in rows)
def ilist(xs): return "(" + ", ".join(lit(x) for x in xs) + ")"


def pct(part, value):
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0::DOUBLE)"
            f" / count(*) OVER (PARTITION BY {part})")


BAND = "CASE WHEN score < 0.10 THEN 'bajo' WHEN score < 0.25 THEN 'medio' WHEN score < 0.50 THEN 'alto' ELSE 'crítico' END"
cte("risk", f"""
SELECT s.*, {pct('s.T', 's.score')} AS percentile, {pct('s.T, s.size_cohort', 's.score')} AS percentile_cohort, {BAND} AS band,
       s.score - lag(s.score) OVER (PARTITION BY s.company_id ORDER BY s.t_idx) AS delta_1m, s.T > (SELECT max(T) FROM label_rows) AS is_out_of_sample,
       l.y AS realized_label, l.D AS realized_D
FROM sc_scored s LEFT JOIN label_rows l ON l.company_id = s.company_id AND l.T = s.T""")
cte("risk_now", "SELECT * FROM risk WHERE T = (SELECT max(T) FROM risk)")
cte("last_panel", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY t_idx DESC) AS r_, min(T) OVER (PARTITION BY company_id) AS first_month FROM risk) WHERE r_ = 1")
cte("master", """
SELECT p.company_id, c.group_id, p.country, p.currency, p.erp_any AS erp, p.main_bank, p.group_size, n_bank_accounts, n_banks, n_debt_products,
    debt_granted_total AS debt_granted_total_log, size_cohort, has_invoices > 0 AS has_invoices, first_month, T AS last_month, months_in_panel,
    strftime(c.created_at, '%Y-%m-%d') AS created_at, score AS latest_score, band AS latest_band, delta_1m AS latest_delta_1m, percentile AS latest_percentile,
    health_smooth AS latest_health, health_band AS latest_health_band, trajectory AS latest_trajectory,
    p.company_id IN (SELECT company_id FROM reserved) AS is_test_company
FROM last_panel p JOIN companies c USING (company_id)""")
cte("kpi", "SELECT s.company_id, s.T, " + ", ".join(f"s.{c}" for c in KPI_COLS if not c.endswith("_log")) + """,
    sign(cash_balance_T_log) * (exp(abs(cash_balance_T_log)) - 1) AS cash_balance, exp(inflow_w1_log) - 1 AS inflow_oper, exp(outflow_w1_log) - 1 AS outflow_oper,
    l.late_pay_rate AS outcome_late_pay_rate, l.neg_cash_share AS outcome_neg_cash_share, l.collection_drop AS outcome_collection_drop,
    l.credit_util AS outcome_credit_util, l.inactivity AS outcome_inactivity
FROM scored1 s LEFT JOIN label_rows l ON l.company_id = s.company_id AND l.T = s.T""")

# -------------------------------------------------------------------------------- explanations
cte("feature_dict", "SELECT * FROM (VALUES " + values([(f, a, b) for f, (a, b) in FEATURE_TEXT.items()]) + ") v(feature, label, unit)")


def half_even(x, digits):
    """Text with fixed digits, halves to even."""
    return f"format('{{:.{digits}f}}', round_even({x}, {digits}))"


def thousands(x):
    return f"regexp_replace(format('{{:.0f}}', round_even({x}, 0)), '(\\d)(?=(\\d{{3}})+$)', '\\1,', 'g')"


def phrase(value):
    v = f"(CASE WHEN abs({value}) < 5e-3 THEN 0 ELSE {value} END)"
    return f"""coalesce(label, feature) || ': ' || CASE WHEN {value} IS NULL THEN 'sin dato'
    WHEN unit = 'pp' THEN (CASE WHEN round_even(100 * {v}, 0) >= 0 THEN '+' ELSE '' END) || {half_even('100 * ' + v, 0)} || ' pp'
    WHEN unit = 'bool' THEN CASE WHEN {v} >= 0.5 THEN 'sí' ELSE 'no' END
    WHEN unit = 'log' THEN commas(exp({v}) - 1) WHEN unit = '%' THEN {half_even('100 * ' + v, 0)} || '%'
    WHEN unit = 'log€' THEN commas(sign({v}) * (exp(abs({v})) - 1)) || ' €'
    WHEN unit IN ('días','meses','n','empresas','día') THEN {half_even(v, 0)} || ' ' || unit
    ELSE rtrim({half_even(v, 2)} || ' ' || coalesce(unit, '')) END"""


def commas(sql):
    """Expand commas(x): whole number with thousands separators."""
    while "commas(" in sql:
        i = sql.index("commas(")
        depth, j = 1, i + len("commas(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        x = sql[i + len("commas("):j - 1]
        sql = sql[:i] + f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))" + sql[j:]
    return sql


def texts(sql): return commas(sql)


cte("local_ex", texts(f"""
SELECT *, {phrase('value')} AS text, CASE WHEN phi > 0 THEN 'sube' ELSE 'baja' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY company_id, T ORDER BY abs(phi) DESC, feature) AS rank FROM contribs)
LEFT JOIN feature_dict USING (feature) WHERE rank <= 8"""))
cte("chg_ex", texts(f"""
SELECT *, {phrase('value_prev')} AS before, {phrase('value')} AS after, CASE WHEN delta_phi > 0 THEN 'empeora' ELSE 'mejora' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY company_id, T ORDER BY abs(delta_phi) DESC, feature) AS rank
      FROM (SELECT *, phi - lag(phi) OVER w AS delta_phi, lag(T) OVER w AS T_prev, lag(value) OVER w AS value_prev
            FROM contribs WHERE block <> 'E' WINDOW w AS (PARTITION BY company_id, feature ORDER BY T)) WHERE T_prev IS NOT NULL)
LEFT JOIN feature_dict USING (feature) WHERE rank <= 5"""))
cte("act_ex", f"SELECT * FROM local_ex WHERE feature NOT IN {ilist(PROFILE)} AND text NOT LIKE '%nan%'")
cte("tops", "SELECT company_id, T, arg_min(text, rank) AS top_driver FROM act_ex GROUP BY 1, 2")


def streak(source):
    return f"""
SELECT e.*, min(e.T) OVER (PARTITION BY e.company_id, e.feature, e.direction, isl) AS since
FROM (SELECT x.*, m.pos - row_number() OVER (PARTITION BY x.company_id, x.feature, x.direction ORDER BY m.pos) AS isl FROM {source} x
      JOIN (SELECT company_id, T, row_number() OVER (PARTITION BY company_id ORDER BY T) AS pos FROM (SELECT DISTINCT company_id, T FROM {source})) m
        ON m.company_id = x.company_id AND m.T = x.T) e"""


cte("streaks", streak("local_ex"))
cte("drv", f"""SELECT *, -100 * score * (1 - score) * phi AS impact, CASE WHEN -100 * score * (1 - score) * phi > 0 THEN 'up' ELSE 'down' END AS sense
FROM (SELECT *, row_number() OVER (PARTITION BY company_id, T ORDER BY rank) AS pos FROM ({streak('act_ex')})) WHERE pos <= 5""")
cte("drag_rows", texts(f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, T ORDER BY abs(phi) DESC, feature) AS rank,
    -100 * score * (1 - score) * phi AS impact, CASE feature {' '.join(f"WHEN '{f}' THEN '{m}'" for f, m in FEATURE_METRIC.items())} END AS metric_id
  FROM (SELECT *, {phrase('value')} AS text FROM contribs LEFT JOIN feature_dict USING (feature) WHERE phi > 0 AND block <> 'E')
  WHERE feature NOT IN {ilist(PROFILE)} AND text NOT LIKE '%nan%') WHERE rank <= 6"""))

# ------------------------------------------------------------------------------ alerts, portfolio
cte("why2", "SELECT company_id, T, string_agg(after, ' | ' ORDER BY rank) AS why FROM chg_ex WHERE rank <= 2 GROUP BY 1, 2")
cte("alert_rows", """
SELECT r.company_id, r.T, alert, CASE alert WHEN 'caída estructural' THEN 3 WHEN 'caída brusca este mes' THEN 2 WHEN 'deterioro incipiente' THEN 1 ELSE 0 END AS severity,
    health_smooth, health_delta_1m, health_delta_3m, trajectory, why
FROM risk_now r LEFT JOIN why2 w ON w.company_id = r.company_id AND w.T = r.T WHERE alert <> ''""")
cte("port", """
SELECT r.company_id, r.T, round(health_smooth, 1) AS score, CASE health_band WHEN 'sólida' THEN 'healthy' WHEN 'sana' THEN 'healthy' WHEN 'vigilar' THEN 'stable' ELSE 'risk' END AS band,
    CASE trajectory WHEN 'mejorando' THEN 'up' WHEN 'deteriorándose' THEN 'down' ELSE 'flat' END AS trend,
    round(coalesce(health_delta_3m, 0), 1) AS delta3m, round(coalesce(health_delta_1m, 0), 1) AS delta1m, m.is_test_company AS held_out,
    coalesce(top_driver, '—') AS top_driver, health_band, trajectory, alert AS signal, round(r.score, 4) AS p_deterioration, m.group_id, r.size_cohort, m.country, m.erp, m.main_bank
FROM risk_now r JOIN master m ON m.company_id = r.company_id LEFT JOIN tops t ON t.company_id = r.company_id AND t.T = r.T""")
cte("prods", """
SELECT company_id, coalesce(bank_name, 'Sin identificar') AS bank_name, coalesce(service, '—') AS service, type,
       coalesce(abs(granted), 0) AS granted, coalesce(abs(outstanding), 0) AS outstanding FROM dim_product""")
cte("prods_in", "SELECT * FROM prods WHERE company_id IN (SELECT company_id FROM port)")
cte("kind_map", "SELECT * FROM (VALUES " + values(CONNECTOR_KIND.items()) + ") v(root, kind)")


def kinds(source):
    return f"""SELECT p.bank_name, coalesce(arg_min(m.kind, p.service), CASE WHEN bool_or(type IN {ilist(BANK_TYPES)}) THEN 'banco'
    WHEN bool_or(type IN ('tpv','wallet')) THEN 'pagos' WHEN bool_or(type = 'expensesPlatform') THEN 'gastos' WHEN bool_or(type = 'card') THEN 'tarjetas'
    WHEN bool_or(type IN ('investment','saving')) THEN 'inversión' ELSE 'banco' END) AS kind
    FROM {source} p LEFT JOIN kind_map m ON m.root = split_part(ltrim(p.service, '_'), '_', 1) GROUP BY 1"""


cte("bank_company", """
SELECT bank_name, p.company_id, count(*) AS products, sum(granted) AS granted, sum(outstanding) AS outstanding, any_value(score) AS score,
       any_value(health_band) AS health_band, any_value(trend) AS trend
FROM prods p JOIN port USING (company_id) GROUP BY 1, 2""")
cte("prov", f"""
SELECT b.bank_name, kind, services, count(*) AS companies, sum(products) AS products, count(*) FILTER (health_band = 'riesgo') AS n_risk,
    count(*) FILTER (health_band = 'vigilar') AS n_watch, count(*) FILTER (health_band = 'sana') AS n_healthy, count(*) FILTER (health_band = 'sólida') AS n_solid,
    avg(score) AS mean_health, count(*) FILTER (health_band = 'riesgo') / count(*) AS risk_share, count(*) FILTER (trend = 'down') AS slipping,
    count(*) FILTER (trend = 'up') AS improving, sum(granted) AS granted, sum(outstanding) AS outstanding
FROM bank_company b JOIN ({kinds('prods_in')}) k ON k.bank_name = b.bank_name
JOIN (SELECT bank_name, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM prods_in GROUP BY 1) s ON s.bank_name = b.bank_name
GROUP BY 1, 2, 3""")

# ----------------------------------------------------------------------------------- benchmarks
cte("cells_now", """
SELECT *, CASE WHEN country IN ('EUROPE','UNK') THEN country ELSE 'OTHER' END AS country_group,
    CASE WHEN coalesce(group_size, 1) <= 1 THEN '1' WHEN coalesce(group_size, 1) <= 5 THEN '2-5' ELSE '6+' END AS group_bucket FROM scored1""")
cte("kpi_long", " UNION ALL ".join(
    f"SELECT company_id, T, size_cohort, country_group, group_bucket, '{k}' AS kpi, CAST({k} AS DOUBLE) AS value FROM cells_now" for k in BENCH_KPIS))


def _quart(group, cg, gb):
    qs = ", ".join(f"quantile_cont(value, {q}::DOUBLE) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75))
    return (f"SELECT T, size_cohort, {cg} AS country_group, {gb} AS group_bucket, kpi, count(value) AS n, {qs} FROM kpi_long "
            f"GROUP BY {group} HAVING count(value) >= 10")


cte("bench", _quart("T, size_cohort, country_group, group_bucket, kpi", "country_group", "group_bucket") + " UNION ALL "
    + _quart("T, size_cohort, kpi", "'ALL'", "'ALL'"))
cte("own_bench", """
SELECT o.company_id, o.T, o.size_cohort, o.country_group, o.group_bucket, o.kpi, o.value, fb.fallback, b.n, b.p25, b.p50, b.p75
FROM (SELECT * FROM kpi_long WHERE T = (SELECT max(T) FROM kpi_long)) o
JOIN (SELECT DISTINCT k.company_id, k.T, NOT EXISTS (SELECT 1 FROM bench b WHERE b.T = k.T AND b.size_cohort = k.size_cohort
        AND b.country_group = k.country_group AND b.group_bucket = k.group_bucket) AS fallback FROM kpi_long k) fb ON fb.company_id = o.company_id AND fb.T = o.T
JOIN bench b ON b.T = o.T AND b.size_cohort = o.size_cohort AND b.kpi = o.kpi
 AND b.country_group = CASE WHEN fallback THEN 'ALL' ELSE o.country_group END AND b.group_bucket = CASE WHEN fallback THEN 'ALL' ELSE o.group_bucket END""")

# --------------------------------------------------------------------------------- anticipation
cte("bad0", """
SELECT x.company_id, x.T, x.t_idx, coalesce(h.cash_balance < 0, FALSE) OR coalesce(o.n_classifiable >= 3 AND o.n_bad / nullif(o.n_classifiable, 0) >= 0.5, FALSE)
       OR (x.n_tx = 0 AND x.t_idx > coalesce(a.first_active, 99)) AS bad, s.health_smooth, s.trajectory, s.health_band
FROM dense_tx x JOIN dense_cash h USING (company_id, t_idx) LEFT JOIN active_from a ON a.company_id = x.company_id
LEFT JOIN (SELECT * FROM cm_invoice_outcome WHERE is_payable) o ON o.company_id = x.company_id AND o.t_idx = x.t_idx
LEFT JOIN sc_scored s ON s.company_id = x.company_id AND s.t_idx = x.t_idx
WHERE x.company_id IN (SELECT company_id FROM sc_scored)""")
cte("ev0", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY t_idx) AS r FROM (
  SELECT b0.company_id, b0.T AS event_month, b0.t_idx, b0.health_smooth AS health_at_event,
    (SELECT p.health_smooth FROM bad0 p WHERE p.company_id = b0.company_id AND p.t_idx = b0.t_idx - 6) AS health_6m_before
  FROM bad0 b0 JOIN bad0 b1 ON b1.company_id = b0.company_id AND b1.t_idx = b0.t_idx + 1
  WHERE b0.bad AND b1.bad AND b0.t_idx BETWEEN 9 AND 22
    AND NOT EXISTS (SELECT 1 FROM bad0 p WHERE p.company_id = b0.company_id AND p.bad AND p.t_idx BETWEEN b0.t_idx - 3 AND b0.t_idx - 1))) WHERE r = 1""")
cte("evs", """
SELECT e.company_id, e.event_month, a.T AS alert_month, e.t_idx - a.t_idx AS lead_months, health_at_event, health_6m_before
FROM ev0 e LEFT JOIN (SELECT e.company_id, min(b.t_idx) AS t_idx, min(b.T) AS T FROM ev0 e JOIN bad0 b ON b.company_id = e.company_id
  WHERE b.t_idx BETWEEN greatest(8, e.t_idx - 12) AND e.t_idx AND (b.health_smooth < 75 OR b.trajectory = 'deteriorándose') GROUP BY 1) a ON a.company_id = e.company_id""")
cte("fas", """
SELECT company_id, T AS crossing_month, NOT EXISTS (SELECT 1 FROM bad0 p WHERE p.company_id = q.company_id AND p.bad AND p.t_idx BETWEEN q.t_idx AND q.t_idx + 9) AS is_false
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY t_idx) AS r FROM (
   SELECT *, lag(health_smooth) OVER (PARTITION BY company_id ORDER BY t_idx) AS hp FROM bad0)
   WHERE health_smooth < 75 AND (hp IS NULL OR hp >= 75) AND t_idx BETWEEN 8 AND 14) q WHERE r = 1""")
cte("flips", """
SELECT company_id, T, coalesce(nx = pv, FALSE) AS reverted FROM (SELECT *, lag(health_band) OVER w AS pv, lead(health_band) OVER w AS nx FROM bad0 WINDOW w AS (PARTITION BY company_id ORDER BY t_idx))
WHERE pv <> health_band AND t_idx BETWEEN 9 AND 22""")
cte("feed", """
SELECT a.company_id || '-' || a.T AS id, a.company_id, CASE WHEN severity = 0 THEN 'improving' ELSE 'slipping' END AS kind, round(health_smooth, 1) AS score,
    round(coalesce(health_delta_3m, 0), 1) AS delta, e.lead_months AS months_ahead,
    upper(substr(alert, 1, 1)) || substr(alert, 2) || CASE WHEN coalesce(why, '') <> '' THEN ': ' || why ELSE '' END AS message,
    a.T || '-01T08:00:00Z' AS created_at, alert AS signal, severity, round(coalesce(health_delta_1m, 0), 1) AS delta1m, coalesce(why, '') AS why,
    m.group_id, m.size_cohort, m.country
FROM alert_rows a JOIN master m ON m.company_id = a.company_id LEFT JOIN (SELECT * FROM evs WHERE alert_month IS NOT NULL) e ON e.company_id = a.company_id""")

SQL = {n: shape("risk", SPECS[n]) for n in ("risk_score", "pct_rank_avg", "delta_1m", "risk_band")}


def S(name, source):
    SQL[name] = shape(source, SPECS[name])


S("last_row", "last_panel")
S("company_master", "master")
S("company_kpi", "kpi")
for _n in ("alerts", "alert_order"):
    S(_n, "alert_rows")
S("alert_why", "alert_rows")
S("alert_feed", "feed")
S("alert_filter", "(SELECT * FROM feed WHERE signal <> 'excepcionalmente sólida')")
S("benchmark", "bench")
S("union_benchmarks", "bench")
S("j_fallback", "own_bench")
S("benchmark_position", """(SELECT *, CASE WHEN value IS NULL THEN '' WHEN kpi IN ('io_ratio_w3','cash_months_of_outflow') THEN
    CASE WHEN value < p25 THEN 'bad' WHEN value > p75 THEN 'good' ELSE 'mid' END
    ELSE CASE WHEN value > p75 THEN 'bad' WHEN value < p25 THEN 'good' ELSE 'mid' END END AS position FROM own_bench)""")
S("cohort_cells", "cells_now")
for _n in ("portfolio_rows", "compact_rows"):
    S(_n, "port")
S("portfolio_filter", "(SELECT * FROM port WHERE health_band = 'vigilar' AND (CAST(company_id AS VARCHAR) LIKE '%1%' OR group_id LIKE '%1%'))")
S("portfolio_order", "port")
S("watch_row", "(SELECT * FROM port WHERE band = 'healthy' AND trend = 'down')")
S("portfolio_history", """(SELECT T, count(*) FILTER (health_band = 'sólida') AS solid, count(*) FILTER (health_band = 'sana') AS healthy,
    count(*) FILTER (health_band = 'vigilar') AS watch, count(*) FILTER (health_band = 'riesgo') AS risk, avg(health_smooth) AS mean_health FROM sc_scored GROUP BY T)""")
S("portfolio_counts", """(SELECT count(*) FILTER (band = 'healthy') AS healthy, count(*) FILTER (band = 'stable') AS stable, count(*) FILTER (band = 'risk') AS risk,
    count(*) FILTER (trend = 'up') AS improving, count(*) FILTER (trend = 'down') AS slipping, count(*) FILTER (held_out) AS held_out FROM port)""")
S("score_distribution", "(" + " UNION ALL ".join(
    f"SELECT '{c}' AS kind, {c} AS key, count(*) AS n, avg(score) AS mean_score, NULL AS n_high FROM risk_now GROUP BY {c}" for c in ("band", "health_band", "trajectory"))
  + " UNION ALL SELECT 'month', T, count(*), avg(score), count(*) FILTER (band IN ('alto','crítico')) FROM risk GROUP BY T)")
S("signal_counts", "(SELECT 'signal' AS what, alert AS key, count(*) AS n FROM alert_rows GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM prov GROUP BY 2)")
S("connector_counts", """((SELECT 'bank' AS what, bank_name AS name, companies AS n FROM prov WHERE kind = 'banco' AND lower(bank_name) NOT LIKE 'other%' ORDER BY n DESC, name LIMIT 10)
    UNION ALL (SELECT 'erp', erp, count(*) AS n FROM port WHERE erp <> 'NONE' GROUP BY 2 ORDER BY n DESC, 2 LIMIT 8))""")
S("run_summary", """(SELECT 'companies' AS metric, 'all' AS key, count(DISTINCT company_id) AS n FROM risk UNION ALL SELECT 'rows', 'all', count(*) FROM risk
    UNION ALL SELECT 'band', health_band, count(*) FROM risk_now GROUP BY 2 UNION ALL SELECT 'trajectory', trajectory, count(*) FROM risk_now GROUP BY 2
    UNION ALL SELECT 'flag', 'exceptional', count(*) FILTER (is_exceptional) FROM risk_now UNION ALL SELECT 'flag', 'structural', count(*) FILTER (is_structural) FROM risk_now
    UNION ALL SELECT 'flag', 'blip', count(*) FILTER (is_blip) FROM risk_now)""")
S("latest_month", "(SELECT max(T) AS T FROM risk)")
S("company_filter", "(SELECT r.* EXCLUDE (group_id, country), m.group_id, m.country FROM risk_now r JOIN master m USING (company_id) WHERE band = 'medio' AND (CAST(company_id AS VARCHAR) LIKE '%1%' OR m.group_id LIKE '%1%'))")
S("page_companies", "(SELECT *, (SELECT count(*) FROM risk_now) AS total FROM risk_now ORDER BY health_delta_3m ASC NULLS LAST, company_id LIMIT 20 OFFSET 5)")
S("company_lookup", "(SELECT r.* EXCLUDE (group_id, country), m.group_id, m.country FROM risk r JOIN master m USING (company_id))")
S("movers", "(" + " UNION ALL ".join(f"(SELECT '{k}' AS what, company_id, score, delta3m, signal FROM port ORDER BY {o}, company_id LIMIT 8)"
                                      for k, o in (("fall", "delta3m"), ("rise", "delta3m DESC"), ("low", "score"))) + ")")
S("top_driver", "(SELECT * FROM tops WHERE T = (SELECT max(T) FROM local_ex))")
S("held_out_flag", "(SELECT company_id, company_id IN (SELECT company_id FROM reserved) AS held_out FROM companies)")
S("provider_rollup", "prov")
S("provider_order", "prov")
S("provider_filter", "(SELECT * FROM prov WHERE kind = 'banco' AND companies >= 10 AND outstanding > 0 AND (lower(bank_name) LIKE '%svc_1%' OR lower(services) LIKE '%svc_1%'))")
S("provider_kind", "(" + kinds("prods") + ")")
S("provider_types", "(SELECT bank_name, type, count(*) AS n FROM prods_in GROUP BY 1, 2)")
S("provider_totals", "(SELECT count(DISTINCT bank_name) AS providers, count(DISTINCT service) AS connectors, count(*) AS products, (SELECT count(*) FROM port) AS companies FROM prods_in)")
S("provider_companies", "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank_name ORDER BY score, company_id) AS rank FROM bank_company))")
S("j_company_provider", "(SELECT company_id, count(*) AS providers, sum(products) AS products, sum(outstanding) AS outstanding FROM bank_company GROUP BY 1)")
S("contrib", "contribs")
S("contrib_global", """(SELECT feature, block, mean_abs, sum(mean_abs) OVER (PARTITION BY block) / sum(mean_abs) OVER () AS block_share,
    sum(CASE WHEN block <> 'A' THEN mean_abs ELSE 0 END) OVER () / sum(mean_abs) OVER () AS behavioural_share
    FROM (SELECT feature, block, avg(abs(phi)) AS mean_abs FROM contribs GROUP BY 1, 2))""")
S("contrib_local", "local_ex")
S("top_contrib", "(SELECT * FROM local_ex WHERE rank <= 3)")
S("contrib_change", "chg_ex")
S("change_rank", "chg_ex")
S("driver_points", "drv")
S("streak_since", "streaks")
S("actionable", "act_ex")
S("drags", "drag_rows")
S("reasons_top3", "(SELECT company_id, string_agg((CASE WHEN phi > 0 THEN '↑ ' ELSE '↓ ' END) || text, ' | ' ORDER BY rank) AS why FROM local_ex WHERE rank <= 3 AND T = (SELECT max(T) FROM local_ex) GROUP BY 1)")
S("describe", "(" + texts("SELECT company_id, T, feature, " + phrase("value") + " AS text FROM (" + " UNION ALL ".join(
    f"SELECT company_id, T, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM scored1" for c in DESCRIBED) + ") LEFT JOIN feature_dict USING (feature)") + ")")
S("j_lookup_text", "(SELECT e.feature, d.label, d.unit, n FROM (SELECT feature, count(*) AS n FROM local_ex GROUP BY 1) e LEFT JOIN feature_dict d ON d.feature = e.feature)")
for _n in ("event_detect", "alert_lead", "union_events"):
    S(_n, "evs")
S("last_event", "(SELECT * FROM evs WHERE alert_month IS NOT NULL)")
S("false_alert", "fas")
S("band_flip", "flips")
S("lead_distribution", "(SELECT lead_months, count(*) AS n FROM evs WHERE lead_months IS NOT NULL GROUP BY 1)")
S("anticipation_summary", """(SELECT *, n_anticipated / nullif(n_detected, 0) AS share_of_detected, n_anticipated / nullif(n_events, 0) AS share_of_all, n_detected / nullif(n_events, 0) AS share_detected FROM
    (SELECT count(*) AS n_events, count(*) FILTER (lead_months >= 1) AS n_anticipated, count(lead_months) AS n_detected, quantile_cont(lead_months::DOUBLE, 0.5::DOUBLE) AS lead_median,
     avg(lead_months) AS lead_mean, quantile_cont(lead_months::DOUBLE, 0.25::DOUBLE) AS lead_p25, quantile_cont(lead_months::DOUBLE, 0.75::DOUBLE) AS lead_p75, avg(health_at_event - health_6m_before) AS health_drop_mean FROM evs),
    (SELECT count(*) AS n_alert_windows, avg(is_false::INTEGER) AS false_alert_rate FROM fas), (SELECT count(*) AS n_band_changes, avg(reverted::INTEGER) AS band_flip_rate FROM flips))""")
