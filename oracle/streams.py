"""SQL of the finite stream replay."""

from cashlens.plans.streams import SPECS
from oracle import shape
from oracle.base import cte
from oracle.scored import D, health_ctes

SQL = {"monitor_stream": shape("""(SELECT user_id, strftime(ts, '%Y-%m') AS T, count(*) AS n, sum(value) AS total,
    count(DISTINCT date_trunc('day', ts)) AS active_days FROM events GROUP BY 1, 2)""", SPECS["monitor_stream"])}
cte("ev_months", "SELECT user_id AS company_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m') AS T, count(*) AS n FROM events GROUP BY 1, 2")
cte("ev_base", f"""SELECT *, round(least(greatest(0.2{D} + 0.6{D} * (1 - coalesce(n / usual, 1)), 0), 1), 6) AS score,
  row_number() OVER (PARTITION BY company_id ORDER BY T) AS t_idx FROM (SELECT *, avg(n) OVER (PARTITION BY company_id ORDER BY T ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS usual FROM ev_months)""")
SQL["monitor_alerts"] = shape(f"(SELECT *, company_id AS user_id FROM {health_ctes('ev_', 'ev_base')})", SPECS["monitor_alerts"])
