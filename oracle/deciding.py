"""SQL of metrics, decisions, what-if and text checks."""

from cashlens.plans.deciding import SPECS
from oracle import shape
from oracle.base import cte
from oracle.scored import D, INTERCEPT, WEIGHTS, cal, sig
import oracle.serving  # noqa: F401

SQL = {}


def S(name, source):
    SQL[name] = shape(source, SPECS[name])


METRICS = ["dso", "dpo", "ccc", "dscr", "cash_days", "credit_usage", "concentration"]
DIRECTION = {"dso": -1, "dpo": 0, "ccc": -1, "dscr": 1, "cash_days": 1, "credit_usage": -1, "concentration": -1}
FIXED = {"dscr": 1.25, "cash_days": 60.0, "credit_usage": 0.8, "concentration": 0.3}
UNIT = {"dso": "days", "dpo": "days", "ccc": "days", "dscr": "ratio", "cash_days": "days", "credit_usage": "pct", "concentration": "pct"}
cte("mv", """
SELECT *, dso - dpo AS ccc FROM (SELECT *, cash_conversion_days_w6 AS dso, pay_term_days_w6 + coalesce(pay_dpd_mean_w6, 0) AS dpo,
    CASE WHEN coalesce(debt_service_ratio_w6, 0) > 0 THEN 1 / debt_service_ratio_w6 END AS dscr, days_of_cash AS cash_days, credit_util_T AS credit_usage,
    top1_in_share AS concentration, row_number() OVER (PARTITION BY company_id ORDER BY t_idx DESC) AS age FROM sc_scored)""")
cte("mnow", "SELECT * FROM mv WHERE age = 1")
cte("mst0", " UNION ALL ".join(
    f"SELECT company_id, '{m}' AS metric_id, '{UNIT[m]}' AS unit, {DIRECTION[m]} AS good, max(CASE WHEN age = 1 THEN {m} END) AS v, "
    + (f"{FIXED[m]}{D}" if m in FIXED else f"quantile_cont({m}, 0.5{D})") + " AS ref FROM mv WHERE age <= 12 GROUP BY company_id" for m in METRICS))
cte("mst", f"""
SELECT company_id, metric_id, unit, round(v, 3) AS value, round(ref, 3) AS reference,
    CASE WHEN gap >= 0 THEN 'ok' WHEN gap > -(CASE WHEN unit = 'days' THEN 10.0{D} ELSE 0.1{D} END) THEN 'watch' ELSE 'breach' END AS status
FROM (SELECT *, CASE WHEN good = 0 THEN -abs(v - ref) ELSE (v - ref) * good END AS gap FROM mst0 WHERE v IS NOT NULL)""")
cte("mtg", "SELECT company_id, metric_id, reference AS target FROM mst WHERE metric_id <> 'ccc' AND status <> 'ok'")


def overrides(m, x):
    now = {"dso": "dso", "dpo": "dpo", "ccc": "ccc"}
    if m in ("dso", "ccc"):
        return {f: f"coalesce({f}, 0) + ({x} - {now[m]})" for f in ("cash_conversion_days_w6", "rec_dpd_mean_w3", "rec_dpd_mean_w6")}
    if m == "dpo":
        return {f: f"coalesce({f}, 0) + ({x} - dpo)" for f in ("pay_dpd_mean_w3", "pay_dpd_mean_w6")}
    return {
        "dscr": {"debt_service_ratio_w6": f"1 / greatest({x}, 0.05{D})"},
        "cash_days": {"days_of_cash": x, "cash_months_of_outflow": f"({x}) / 30",
                      "cash_min_w6_norm": f"least(({x}) / 30, coalesce(cash_min_w6_norm, 0) + (({x}) / 30 - coalesce(cash_months_of_outflow, 0)))"},
        "credit_usage": {"credit_util_T": x, "credit_util_max_w6": f"greatest({x}, coalesce(credit_util_max_w6, 0))"},
        "concentration": {"top1_in_share": x},
    }[m]


def health(values):
    z = f"({INTERCEPT}{D}" + "".join(f" + coalesce({w}{D} * (({values.get(f, f)}) - {mu}{D}), 0)" for f, (w, mu) in WEIGHTS.items()) + ")"
    return f"(100 * (1 - round({cal(f'round({sig(z)}, 8)')}, 6)))"


def variant(metric="metric_id", x="target"):
    out = {}
    for m in METRICS:
        for f, e in overrides(m, x).items():
            if f in WEIGHTS:                       # the card has no other feature
                out.setdefault(f, []).append(f"WHEN {metric} = '{m}' THEN {e}")
    return {f: f"CASE {' '.join(w)} ELSE {f} END" for f, w in out.items()}


S("metric_values", "mv")
S("metric_status", "mst")
S("slider_range", f"(SELECT *, greatest(0, reference * 0.5{D}) AS lo, greatest(value, reference) * 1.5{D} AS hi FROM mst)")
S("lever_overrides", "(" + " UNION ALL ".join(
    f"SELECT company_id, metric_id, '{f}' AS feature, {e} AS new_value FROM mnow JOIN mtg USING (company_id) WHERE metric_id = '{m}'"
    for m in METRICS for f, e in overrides(m, "target").items()) + ")")
cte("mwide", "SELECT company_id, " + ", ".join(f"max(value) FILTER (metric_id = '{m}') AS v_{m}, max(reference) FILTER (metric_id = '{m}') AS r_{m}" for m in METRICS)
    + " FROM mst GROUP BY 1")
IN, OUT = "((exp(coalesce(inflow_w1_log, 0)) - 1) / 30)", "((exp(coalesce(outflow_w1_log, 0)) - 1) / 30)"
RULES = [
    ("collect_faster", "dso", "v_dso > r_dso + 10", "r_dso", f"(v_dso - r_dso) * {IN}"),
    ("pay_slower", "dpo", "v_dpo < r_dpo - 10 AND v_cash_days < 60", "r_dpo", f"(r_dpo - v_dpo) * {OUT}"),
    ("pay_on_time", "dpo", "v_dpo IS NOT NULL AND coalesce(pay_bad_share_w6, 0) > 0.3", "coalesce(nullif(pay_term_days_w6, 0), 30)", "0"),
    ("refinance", "dscr", "v_dscr < 1.25", f"1.25{D}", f"(1 / v_dscr - 1 / 1.25{D}) * {IN} * 30"),
    ("open_credit_line", "cash_days", "v_cash_days < 60", f"90.0{D}", f"(90 - v_cash_days) * {OUT}"),
    ("reduce_usage", "credit_usage", "v_credit_usage > 0.8", f"0.7{D}", "0"),
    ("diversify", "concentration", "v_concentration > 0.3", f"0.3{D}", "0"),
]
cte("dec0", " UNION ALL ".join(
    f"SELECT n.*, '{lv}' AS lever, '{m}' AS metric_id, v_{m} AS current_value, CAST({t} AS DOUBLE) AS target, CAST({c} AS DOUBLE) AS cash FROM mnow n JOIN mwide USING (company_id) WHERE {cond}"
    for lv, m, cond, t, c in RULES))
cte("dec", f"SELECT company_id, lever, metric_id, current_value, round(target, 3) AS target_value, round(greatest(cash, 0), 0) AS cash_impact, round({health(variant())} - {health({})}, 1) AS score_impact FROM dec0")
S("decisions", "dec")
S("decision_order", "(SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY cash_impact DESC, score_impact DESC, lever) AS rank FROM dec)")
cte("wg0", f"""SELECT *, lo + (hi - lo) / 10 * i AS target FROM (SELECT *, greatest(round_even(greatest(value, reference) * 1.5{D}, 0), lo + 1e-6) AS hi
  FROM (SELECT company_id, metric_id, value, reference, greatest(0, round_even(reference * 0.5{D}, 0)) AS lo FROM mst)), range(0, 11) r(i)""")
cte("wg", f"""SELECT company_id, metric_id, i, round(target, 4) AS value, round({health(variant())} - {health({})}, 1) AS score_delta,
  round(CASE metric_id WHEN 'dso' THEN (dso - target) * {IN} WHEN 'dpo' THEN (target - dpo) * {OUT} ELSE 0 END, 0) AS cash_delta
  FROM mnow JOIN (SELECT company_id, metric_id, i, target FROM wg0) USING (company_id)""")
S("whatif_grid", "wg")


def mix(c, d):
    return f"CASE WHEN bv IS NULL THEN a{c} WHEN av IS NULL THEN b{c} ELSE round(a{c} + (target - av) / (CASE WHEN bv - av <> 0 THEN bv - av ELSE 1 END) * (b{c} - a{c}), {d}) END"


cte("interp", f"""SELECT company_id, metric_id, target, {mix('s', 1)} AS score_delta, {mix('c', 0)} AS cash_delta FROM (
  SELECT company_id, metric_id, target, min(value) FILTER (value >= target) AS bv, arg_min(score_delta, i) FILTER (value >= target) AS bs, arg_min(cash_delta, i) FILTER (value >= target) AS bc,
    max(value) FILTER (value < target) AS av, arg_max(score_delta, i) FILTER (value < target) AS "as", arg_max(cash_delta, i) FILTER (value < target) AS ac
  FROM wg JOIN mtg USING (company_id, metric_id) GROUP BY 1, 2, 3)""".replace("THEN as ", 'THEN "as" ').replace("(as +", '("as" +').replace("- as)", '- "as")'))
S("grid_interp", "interp")
cte("twide", "SELECT company_id, " + ", ".join(f"max(target) FILTER (metric_id = '{m}') AS t_{m}" for m in METRICS) + " FROM mtg GROUP BY 1")
_comb = {}
for _m in METRICS:
    for _f, _e in overrides(_m, f"t_{_m}").items():
        if _f in WEIGHTS:
            _comb[_f] = f"CASE WHEN t_{_m} IS NOT NULL THEN {_e} ELSE {_comb.get(_f, _f)} END"
cte("plans", f"""SELECT m.company_id, metric_id, target, CASE metric_id {' '.join(f"WHEN '{x}' THEN {x}" for x in METRICS)} END AS current,
  {health(variant())} - {health({})} AS marginal, {health({})} AS base_health, {health(_comb)} AS plan_health
  FROM mnow m JOIN mtg USING (company_id) JOIN twide USING (company_id)""")
S("plan_rescore", "plans")
S("plan_additive", """(SELECT company_id, score_delta, least(greatest(round(score + score_delta, 1), 0), 100) AS plan_health FROM
  (SELECT company_id, round(sum(score_delta), 1) AS score_delta FROM interp GROUP BY 1) JOIN port USING (company_id))""")
S("plan_ceiling", """(SELECT company_id, plan_health, coalesce(margin, 0) AS margin, least(100, round(plan_health + coalesce(margin, 0), 1)) AS ceiling FROM
  (SELECT DISTINCT company_id, round(plan_health, 1) AS plan_health FROM plans) LEFT JOIN
  (SELECT d.company_id, round(sum(-round(impact, 1)), 1) AS margin FROM drag_rows d WHERE d.T = (SELECT max(T) FROM drag_rows) AND NOT EXISTS
    (SELECT 1 FROM mtg g WHERE g.company_id = d.company_id AND g.metric_id = d.metric_id) GROUP BY 1) USING (company_id))""")
SH = f"coalesce(nullif(top1_in_share, 0), 0.3{D})"
CB = "(sign(coalesce(cash_balance_T_log, 0)) * (exp(abs(coalesce(cash_balance_T_log, 0))) - 1))"


def n0(c, d=0): return f"coalesce({c}, {d})"


SCEN = {
    "client_pays_late_30d": {"rec_dpd_mean_w3": n0("rec_dpd_mean_w3") + " + 30", "rec_dpd_mean_w6": n0("rec_dpd_mean_w6") + " + 15",
        "rec_open_overdue_share_w3": f"least(1, {n0('rec_open_overdue_share_w3')} + 0.25{D})", "rec_open_overdue_share_w6": f"least(1, {n0('rec_open_overdue_share_w6')} + 0.12{D})",
        "cash_conversion_days_w6": n0("cash_conversion_days_w6", 30) + " + 30", "cash_months_of_outflow": f"{n0('cash_months_of_outflow')} - {SH}", "days_of_cash": f"{n0('days_of_cash')} - 30 * {SH}"},
    "lose_main_client": {"inflow_w1_log": f"ln(1 + (exp({n0('inflow_w1_log')}) - 1) * (1 - {SH}))", "inflow_w3_log": f"ln(1 + (exp({n0('inflow_w3_log')}) - 1) * (1 - {SH} / 3))",
        "io_ratio_w1": f"{n0('io_ratio_w1', 1)} * (1 - {SH})", "io_ratio_w3": f"{n0('io_ratio_w3', 1)} * (1 - {SH} / 3)", "inflow_w3_vs_w12": f"{n0('inflow_w3_vs_w12', 1)} * (1 - {SH} / 3)",
        "net_flow_norm_w3": f"{n0('net_flow_norm_w3')} - {SH} / 3", "inflow_trend6": f"{n0('inflow_trend6')} - 0.1{D}", "cp_in_churn": f"least(1, {n0('cp_in_churn')} + 0.2{D})"},
    "pay_suppliers_late_15d": {"pay_dpd_mean_w3": n0("pay_dpd_mean_w3") + " + 15", "pay_dpd_mean_w6": n0("pay_dpd_mean_w6") + " + 8",
        "pay_open_overdue_share_w3": f"least(1, {n0('pay_open_overdue_share_w3')} + 0.15{D})", "pay_bad_share_w3": f"least(1, {n0('pay_bad_share_w3')} + 0.10{D})", "pay_dpd_trend6": n0("pay_dpd_trend6") + " + 3"},
    "overdraft_2_months": {"cash_neg_months_w3": "2", "cash_neg_months_w6": n0("cash_neg_months_w6") + " + 2", "cash_balance_T_log": f"-abs({n0('outflow_w1_log', 8)}) * 0.8{D}",
        "cash_months_of_outflow": f"-0.8{D}", "days_of_cash": "-24", "interest_n_w3": n0("interest_n_w3") + " + 2", "interest_n_w6": n0("interest_n_w6") + " + 2"},
    "new_credit_line": {"cash_months_of_outflow": n0("cash_months_of_outflow") + " + 2", "days_of_cash": n0("days_of_cash") + " + 60",
        "cash_balance_T_log": f"ln(1 + greatest(0, {CB} + 2 * (exp({n0('outflow_w1_log', 8)}) - 1)))", "n_credit_lines": n0("n_credit_lines") + " + 1",
        "n_debt_products": n0("n_debt_products") + " + 1", "cash_neg_months_w3": "0"},
}
S("scenario_rescore", "(" + " UNION ALL ".join(f"SELECT company_id, '{k}' AS scenario, {health({})} AS before, {health({f: e for f, e in v.items() if f in WEIGHTS})} AS after FROM mnow"
                                              for k, v in SCEN.items()) + ")")
S("j_scenario", "(" + " UNION ALL ".join(f"SELECT company_id, '{k}' AS scenario, '{f}' AS feature, CAST({e} AS DOUBLE) AS new_value FROM mnow" for k, v in SCEN.items() for f, e in v.items()) + ")")
S("feature_frame", "(SELECT * REPLACE (CASE WHEN company_id % 4 <> 0 THEN hhi_in END AS hhi_in) FROM mnow)")
S("except_features", "(SELECT company_id, CASE WHEN company_id % 3 = 0 THEN 'zz_extra' ELSE '' END AS unknown FROM mnow)")
TOK = r"\d+(?:[.,]\d+)*"


def reads(tok):
    """List of (value, tolerance) structs of a token in both notations."""
    e, s = f"replace({tok}, ',', '')", f"replace(replace({tok}, '.', ''), ',', '.')"

    def one(x):
        dec = f"CASE WHEN contains({x}, '.') THEN length(split_part({x}, '.', -1)) ELSE 0 END"
        return f"{{'v': CASE WHEN regexp_full_match({x}, '\\d+(\\.\\d+)?') THEN TRY_CAST({x} AS DOUBLE) END, 'tol': 0.5{D} * pow(10.0{D}, -({dec})) + 1e-9}}"
    return f"list_filter([{one(e)}, {one(s)}], lambda r_ : r_.v IS NOT NULL)"


def is_grounded(text, known):
    return (f"len(list_filter(regexp_extract_all({text}, '{TOK}'), lambda t_ : NOT (len(list_filter({reads('t_')}, lambda q_ : "
            f"len(list_filter({known}, lambda k_ : abs(k_ - q_.v) <= q_.tol OR abs(100 * k_ - q_.v) <= q_.tol)) > 0)) > 0))) = 0")


def known(text):
    return f"list_transform(flatten(list_transform(regexp_extract_all({text}, '{TOK}'), lambda z_ : {reads('z_')})), lambda y_ : y_.v)"


S("number_grounding", f"""(SELECT doc_id, len(regexp_extract_all(text, '{TOK}')) AS n_numbers, {is_grounded('text', 'kn')} AS is_grounded FROM (
  SELECT doc_id, text, {known("concat_ws(' ', doc_id, n_chars, len(string_split(text, ' ')), '3 7,5 0.12 1.250 2024')")} AS kn FROM documents))""")
S("insight_validate", f"""(SELECT company_id, least(count(*), 6) AS n_insights, arg_min(text, rank) AS first_title FROM (
  SELECT e.company_id, rank, text, CASE WHEN phi > 0 THEN 'risk' WHEN rank % 5 = 0 THEN 'praise' ELSE 'opportunity' END AS kind,
    {is_grounded("text || ' ' || direction || ' ' || text", 'kn')} AS ok
  FROM local_ex e JOIN (SELECT company_id, {known("string_agg(text, ' ')")} AS kn FROM local_ex WHERE T = (SELECT max(T) FROM local_ex) GROUP BY 1) d ON d.company_id = e.company_id
  WHERE e.T = (SELECT max(T) FROM local_ex)) WHERE ok AND kind <> 'praise' GROUP BY 1 HAVING count(*) >= 3)""")
