"""SQL of the core queries."""

from cashlens.plans.core import SPECS
from oracle import shape

SQL = {n: shape(n, SPECS[n]) for n in ("cm_tx", "cm_cash", "cm_invoice_lag", "cm_invoice_issued", "cm_invoice_outcome",
                                        "cm_concentration")}
SQL |= {n: shape("features", SPECS[n]) for n in [f"feat_{b}" for b in "ABCDEF"] + ["panel_assemble"]}
