"""SQL for the model-side query that does not depend on a fit."""

import oracle.scored  # noqa: F401
from oracle.base import cte

CATEGORIES = ("country", "currency", "erp_any", "main_bank", "size_cohort")
cte("enc_train", "SELECT s.* FROM scored1 s JOIN (SELECT company_id, T FROM label_rows WHERE NOT is_reserved AND t_idx <= 8) USING (company_id, T)")
SQL = {"encode": "SELECT company_id, T, " + ", ".join(
    f"CASE WHEN {c} IN (SELECT {c} FROM enc_train GROUP BY 1 HAVING count(*) >= 25) THEN {c} ELSE '__other__' END AS {c}" for c in CATEGORIES) + " FROM scored1"}
