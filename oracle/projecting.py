"""SQL of evaluation and projection queries."""

from cashlens.operators.projection import DIMS, DIM_WEIGHT, NOTES
from cashlens.plans.projecting import SPECS, ZCOLS
from oracle import shape
from oracle.base import cte
from oracle.scored import cal
import oracle.serving  # noqa: F401

SQL = {}


def S(name, source):
    SQL[name] = shape(source, SPECS[name])


cte("lab_rows", "SELECT s.*, l.y, l.D, " + ", ".join(f"l.{z}" for z in ZCOLS)
    + " FROM sc_scored s JOIN label_rows l ON l.company_id = s.company_id AND l.T = s.T WHERE NOT l.is_reserved")
cte("res_rows", "SELECT s.*, l.y, l.D FROM sc_scored s JOIN label_rows l ON l.company_id = s.company_id AND l.T = s.T WHERE l.is_reserved")
cte("hold", "SELECT * FROM lab_rows WHERE t_idx >= 15")
cte("two", "SELECT 'A' AS model, score_A AS p, y FROM hold UNION ALL SELECT 'B', score, y FROM hold")


def pr(source, p, key):
    part = f"PARTITION BY {key}" if key else ""
    k = f"{key}, " if key else ""
    return (f"SELECT {k}p, pos, sum(pos) OVER ({part} ORDER BY p DESC) AS tp, sum(n) OVER ({part} ORDER BY p DESC) AS flagged, sum(pos) OVER ({part}) AS allpos "
            f"FROM (SELECT {k}{p} AS p, count(*) AS n, sum(y) AS pos FROM {source} GROUP BY ALL)")


def ap(source, p, key=""):
    k = f"{key}, " if key else ""
    return f"SELECT {k}sum(pos / allpos * tp / flagged) AS auc_pr FROM ({pr(source, p, key)})" + (f" GROUP BY {key}" if key else "")


def roc(source, p, key=""):
    part = f"PARTITION BY {key}" if key else ""
    k = f"{key}, " if key else ""
    pb = f"PARTITION BY {key}, {p}" if key else f"PARTITION BY {p}"
    r = f"(rank() OVER ({part} ORDER BY {p}) + (count(*) OVER ({pb}) - 1) / 2.0::DOUBLE)"
    return (f"SELECT {k}(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc_roc "
            f"FROM (SELECT {k}y, {r} AS r FROM {source})" + (f" GROUP BY {key}" if key else ""))


S("auc_pr", f"({ap('two', 'p', 'model')})")
S("auc_roc", f"({roc('two', 'p', 'model')})")
S("brier", "(SELECT model, count(*) AS n, sum(y) AS positives, avg((p - y) * (p - y)) AS brier, avg(y) AS base_rate FROM two GROUP BY 1)")
S("pr_points", f"(SELECT p AS threshold, tp / flagged AS precision, tp / allpos AS recall FROM ({pr('hold', 'score', '')}))")


def hits(k):
    return f"sum(pos * greatest(least({k} - above, n), 0) / n)"


S("topk_month", f"""(SELECT T, {hits(50)} / least(50, max(nt)) AS precision_k, {hits(50)} / greatest(max(pt), 1) AS recall_k,
    {hits('greatest(floor(nt * 0.1::DOUBLE), 1)')} / greatest(max(pt), 1) AS recall_top10
  FROM (SELECT *, sum(n) OVER (PARTITION BY T ORDER BY score DESC) - n AS above, sum(n) OVER (PARTITION BY T) AS nt, sum(pos) OVER (PARTITION BY T) AS pt
        FROM (SELECT T, score, count(*) AS n, sum(y) AS pos FROM hold GROUP BY 1, 2)) GROUP BY T)""")
S("calib_curve", """(SELECT b / 10.0::DOUBLE AS bin_lo, (b + 1) / 10.0::DOUBLE AS bin_hi, count(*) AS n, avg(score) AS pred_mean, avg(y) AS obs_rate
  FROM (SELECT *, least(floor(score * 10), 9) AS b FROM lab_rows) GROUP BY b HAVING count(*) >= 10)""")
S("rate_by_band", """(SELECT 'band' AS kind, health_band AS key, avg(y) AS share, count(*) AS n FROM lab_rows GROUP BY 2 UNION ALL
  SELECT 'trajectory', trajectory, avg(y), count(*) FROM lab_rows GROUP BY 2 UNION ALL SELECT 'exceptional', 'all', avg(y), count(*) FROM lab_rows WHERE is_exceptional GROUP BY 2)""")
cte("conf", """SELECT *, CASE WHEN y = 1 THEN CASE WHEN rp <= 0.15::DOUBLE THEN 'TP' ELSE 'FN' END ELSE CASE WHEN rp <= 0.15::DOUBLE THEN 'FP' ELSE 'TN' END END AS cls FROM (
  SELECT *, (rank() OVER (PARTITION BY T ORDER BY score DESC) + (count(*) OVER (PARTITION BY T, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY T) AS rp FROM hold)""")
S("confusion_profile", "(SELECT cls, count(*) AS n, " + ", ".join(f"avg({z}) AS {z}" for z in ZCOLS)
  + ", avg(has_invoices) AS has_invoices, avg(months_in_panel) AS months_in_panel, avg(n_debt_products) AS n_debt_products, "
  + ", ".join(f"count(*) FILTER (size_cohort = '{c}') / count(*) AS share_{c}" for c in ("q1", "q2", "q3", "q4")) + " FROM conf GROUP BY 1)")
S("fn_dominant", "(SELECT CASE " + " ".join(f"WHEN {z} = greatest({', '.join(ZCOLS)}) THEN '{z}'" for z in ZCOLS)
  + " END AS component, count(*) AS n FROM conf WHERE cls = 'FN' GROUP BY 1)")
S("train_set", "lab_rows")
S("platt", f"(SELECT company_id, T, {cal('score_raw')} AS score FROM scored1)")
S("evidence", """(SELECT * FROM (SELECT -corr(a, b) AS spearman FROM (SELECT rank() OVER (ORDER BY health) + (count(*) OVER (PARTITION BY health) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (ORDER BY D) + (count(*) OVER (PARTITION BY D) - 1) / 2.0::DOUBLE AS b FROM res_rows)),
  (SELECT avg(1 - l.y) AS improving_ok FROM sc_scored s JOIN label_rows l ON l.company_id = s.company_id AND l.T = s.T WHERE trajectory = 'mejorando'),
  (SELECT count(*) FILTER (is_blip) AS blips, count(*) FILTER (is_structural) AS structural FROM risk_now),
  (SELECT count(lead_months) AS n_detected, quantile_cont(lead_months::DOUBLE, 0.25::DOUBLE) AS lead_p25, quantile_cont(lead_months::DOUBLE, 0.5::DOUBLE) AS lead_median,
   quantile_cont(lead_months::DOUBLE, 0.75::DOUBLE) AS lead_p75 FROM evs))""")
S("eval_held_out", "(SELECT 'auc_roc_B' AS metric, auc_roc AS value FROM (" + roc("res_rows", "score") + ") UNION ALL SELECT 'auc_roc_A', auc_roc FROM (" + roc("res_rows", "score_A")
  + ") UNION ALL SELECT 'auc_pr_B', auc_pr FROM (" + ap("res_rows", "score") + ") UNION ALL SELECT 'auc_pr_A', auc_pr FROM (" + ap("res_rows", "score_A")
  + ") UNION ALL SELECT 'auc_roc_health', auc_roc FROM (" + roc("(SELECT *, -health_smooth AS hneg FROM res_rows)", "hneg")
  + ") UNION ALL SELECT 'base_rate', avg(y) FROM res_rows UNION ALL SELECT 'auc_roc_' || T, auc_roc FROM (" + roc("res_rows", "score", "T") + "))")
_folds = [("fold1", 4, 11, 12), ("fold2", 6, 13, 14), ("holdout", 8, 15, 16)]
S("folds", "(" + " UNION ALL ".join(
    f"SELECT '{n}' AS fold, {m} AS train_max, {a} AS eval_from, {b} AS eval_to, count(*) FILTER (t_idx <= {m}) AS n_train, count(*) FILTER (t_idx BETWEEN {a} AND {b}) AS n_eval FROM lab_rows"
    for n, m, a, b in _folds) + ")")

# ----------------------------------------------------------------------------------- projection
cte("st", "SELECT company_id, T, t_idx, row_number() OVER w AS pos, health_smooth AS level, health - health_smooth AS surprise, "
    "coalesce(health_smooth - lag(health_smooth, 1) OVER w, 0) AS d1, coalesce(health_smooth - lag(health_smooth, 3) OVER w, 0) AS d3, "
    + ", ".join(f"lead(health_smooth, {i}) OVER w - health_smooth AS delta{i}" for i in range(1, 7))
    + " FROM sc_scored WINDOW w AS (PARTITION BY company_id ORDER BY t_idx)")
cte("pl", "SELECT * FROM st WHERE pos >= 4 AND delta6 IS NOT NULL")
cte("tg", "SELECT * FROM st WHERE t_idx = (SELECT max(t_idx) FROM st)")


def fan_ctes(p, targets, pool):
    cte(f"{p}sc", "SELECT " + ", ".join(f"greatest(round(stddev_pop({d}), 6), 1e-6) AS s_{d}" for d in DIMS) + f" FROM {pool}")
    dist = "sqrt(" + " + ".join(f"((p.{d} - t.{d}) / s_{d} * {w}::DOUBLE) * ((p.{d} - t.{d}) / s_{d} * {w}::DOUBLE)" for d, w in zip(DIMS, DIM_WEIGHT)) + ")"
    cte(f"{p}nb", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, t_idx ORDER BY dist, pc, pt) AS rank FROM (
      SELECT t.company_id, t.t_idx, t.level AS h0, p.company_id AS pc, p.t_idx AS pt, {dist} AS dist, {', '.join(f'p.delta{i}' for i in range(1, 7))}
      FROM {targets} t JOIN {pool} p ON p.company_id <> t.company_id, {p}sc)) WHERE rank <= 400""")
    cte(f"{p}k1", f"""SELECT *, greatest(0.25::DOUBLE, max(CASE WHEN rank <= 40 THEN dist END) OVER (PARTITION BY company_id, t_idx), 1e-6) AS bw FROM {p}nb""")
    cte(f"{p}k2", f"SELECT *, exp(-0.5::DOUBLE * (dist / bw) * (dist / bw)) AS g FROM {p}k1")
    cte(f"{p}kn", f"SELECT *, g / sum(g) OVER (PARTITION BY company_id, t_idx) AS weight FROM {p}k2")
    cte(f"{p}paths", " UNION ALL ".join(
        f"SELECT company_id, t_idx, {i} AS h, rank, weight, least(greatest(h0 + delta{i}, 0), 100) AS value FROM {p}kn" for i in range(1, 7)))
    cte(f"{p}cum", f"SELECT *, sum(weight) OVER (PARTITION BY company_id, t_idx, h ORDER BY value, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM {p}paths")
    cte(f"{p}fan", f"""SELECT q.*, n_companies, prob_drop5, prob_risk FROM (SELECT company_id, t_idx, h, min(value) FILTER (cum >= 0.1::DOUBLE - 1e-9) AS low, min(value) FILTER (cum >= 0.5::DOUBLE - 1e-9) AS median,
        min(value) FILTER (cum >= 0.9::DOUBLE - 1e-9) AS high FROM {p}cum GROUP BY 1, 2, 3) q JOIN (
      SELECT company_id, t_idx, count(DISTINCT pc) FILTER (weight > mx / 100) AS n_companies,
        coalesce(sum(weight) FILTER (least(greatest(h0 + delta6, 0), 100) <= h0 - 5), 0) AS prob_drop5, coalesce(sum(weight) FILTER (least(greatest(h0 + delta6, 0), 100) < 50), 0) AS prob_risk
      FROM (SELECT *, max(weight) OVER (PARTITION BY company_id, t_idx) AS mx FROM {p}kn) GROUP BY 1, 2) b USING (company_id, t_idx)""")


fan_ctes("fa_", "tg", "pl")
cte("pl_train", "SELECT * FROM pl WHERE company_id NOT IN (SELECT company_id FROM label_rows WHERE is_reserved)")
cte("pl_test", "SELECT * FROM pl WHERE company_id IN (SELECT company_id FROM label_rows WHERE is_reserved)")
fan_ctes("fb_", "pl_test", "pl_train")
cte("line0", """SELECT company_id, T, t_idx, y, CASE WHEN regr_count(y, pos) OVER f >= 2 THEN regr_slope(y, pos) OVER f ELSE 0 END AS slope,
    greatest(sqrt(greatest(regr_syy(y, pos) OVER f - coalesce(pow(regr_sxy(y, pos) OVER f, 2) / nullif(regr_sxx(y, pos) OVER f, 0), 0), 0) / regr_count(y, pos) OVER f), 2) AS sigma
  FROM (SELECT *, round(health_smooth, 6) AS y, row_number() OVER (PARTITION BY company_id ORDER BY t_idx) AS pos FROM sc_scored)
  WINDOW f AS (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
cte("line", """SELECT *, greatest(0, median - 1.96::DOUBLE * sigma * sqrt(h)) AS low, least(100, median + 1.96::DOUBLE * sigma * sqrt(h)) AS high
  FROM (SELECT *, least(greatest(y + slope * h, 0), 100) AS median FROM line0, range(1, 7) r(h))""")
S("future_path", "pl")
S("traj_pool", "(SELECT *, (SELECT count(*) FROM pl) AS n FROM fa_sc)")
S("j_knn", "(SELECT company_id, t_idx, count(*) AS n, sum(dist) AS sum_dist, max(dist) AS max_dist, sum(rank * (pc * 24 + pt)) AS sum_rank_id FROM fa_nb GROUP BY 1, 2)")
S("knn_kernel", "(SELECT company_id, t_idx, max(bw) AS bw, max(weight) AS max_weight, 1 / sum(weight * weight) AS n_eff FROM fa_kn GROUP BY 1, 2)")
S("fan_quantiles", "fa_fan")
S("ols_fan", "line")
cte("actual", " UNION ALL ".join(
    f"SELECT company_id, t_idx, {i} AS h, level + delta{i} AS actual, CASE WHEN level >= 90 THEN 'sólida' WHEN level >= 75 THEN 'sana' WHEN level >= 50 THEN 'vigilar' ELSE 'riesgo' END AS band FROM pl_test"
    for i in range(1, 7)))
cte("bt", """SELECT m.*, actual, band FROM (SELECT 'neighbours' AS method, company_id, t_idx, h, low, median, high FROM fb_fan
  UNION ALL SELECT 'line', company_id, t_idx, h, low, median, high FROM line) m JOIN actual USING (company_id, t_idx, h)""")
S("fan_backtest", "(" + " UNION ALL ".join(
    f"SELECT method, '{v}' AS by, {k} AS key, count(*) AS n, avg(CASE WHEN actual >= low AND actual <= high THEN 1.0::DOUBLE ELSE 0 END) AS coverage, avg(abs(median - actual)) AS mae, avg(high - low) AS width FROM bt GROUP BY ALL"
    for v, k in (("all", "'all'"), ("month", "CAST(h AS VARCHAR)"), ("band", "band"))) + ")")
S("forecast_row", f"""(SELECT f.*, strftime(TIMESTAMP '2001-08-01' + to_months(CAST(h AS INTEGER)), '%Y-%m') AS month, CASE WHEN is_structural THEN 'structural' ELSE 'dip' END AS stability,
    CASE WHEN is_structural THEN '{NOTES['structural']}' WHEN blip3 THEN '{NOTES['blip']}' WHEN trajectory = 'deteriorándose' THEN '{NOTES['incipient']}' ELSE '{NOTES['normal']}' END AS note,
    alert_month AS detected_at, event_month AS evident_at, lead_months AS months_ahead
  FROM fa_fan f JOIN (SELECT *, bool_or(is_blip) OVER (PARTITION BY company_id ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS blip3 FROM sc_scored) s ON s.company_id = f.company_id AND s.t_idx = f.t_idx
  LEFT JOIN (SELECT * FROM evs WHERE alert_month IS NOT NULL) e ON e.company_id = f.company_id)""")
S("fan_shift", "(SELECT company_id, h, " + ", ".join(f"least(greatest(round(round({c}, 1) - 2.5, 1), 0), 100) AS {c}" for c in ("low", "median", "high")) + " FROM fa_fan)")
