"""Parameters as values: every operator receives a ``PanelConfig`` and reads no environment."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# --- Fixed values: must equal the published method for results to agree -------------------
LABEL_WEIGHTS = {
    "late_pay_rate": 0.30,
    "neg_cash_share": 0.25,
    "collection_drop": 0.20,
    "credit_util": 0.10,
    "inactivity": 0.15,
}
RISK_BANDS = [(0.10, "bajo"), (0.25, "medio"), (0.50, "alto"), (None, "crítico")]
HEALTH_BANDS = [(90.0, "sólida"), (75.0, "sana"), (50.0, "vigilar"), (None, "riesgo")]
STRESS_TERMS = r"devol|impag|embarg|reclam|recobro|demora|requerim|aplaz|descubierto|excedido|mora\b"
INVOICE_STRESS_TERMS = r"devol|impag|reclam|demora|mora\b|abono|rectific"
NON_OPERATING_IN = ("investment_return", "payment_refund", "transfer", "collection_refund")
NON_OPERATING_OUT = ("investment_deployment", "transfer", "debt_repayment")
CASH_TYPES = ("checking", "saving")
SNAPSHOT_TYPES = ("checking", "saving", "lineofcredit", "card")


def month_index(month: str) -> int:
    """Months since year 0 of a 'YYYY-MM' string."""
    year, mon = month.split("-")
    return int(year) * 12 + int(mon) - 1


def month_name(index: int) -> str:
    return f"{index // 12:04d}-{index % 12 + 1:02d}"


@dataclass(frozen=True)
class PanelConfig:
    """Panel bounds and thresholds. Defaults are those of the published data set."""

    first_month: str = "2024-09"
    last_month: str = "2026-08"
    snapshot: str = "2026-09-01"
    invoice_min: str = "2024-01-01"
    invoice_max: str = "2027-12-31"
    gap_months: int = 1
    outcome_months: int = 6
    label_percentile: float = 0.85
    label_weights: dict = field(default_factory=lambda: dict(LABEL_WEIGHTS), hash=False)
    dpd_bad_days: int = 30
    stress_terms: str = STRESS_TERMS
    invoice_stress_terms: str = INVOICE_STRESS_TERMS
    home_countries: tuple = ("ES", "UNK")
    normalise_currency: bool = False
    # reserved companies
    holdout_companies: int = 80
    holdout_max_group: int = 12
    seed: int = 42
    # temporal validation
    holdout_months: int = 2
    cv_folds: int = 3
    # health rules
    smoothing: float = 0.5
    trend_delta: float = 8.0
    trend_consistent: int = 2
    blip_drop: float = 8.0
    exceptional_health: float = 90.0
    exceptional_months: int = 6
    abrupt_drop: float = 10.0
    alert_health: float = 75.0
    min_cohort: int = 10
    top_contributions: int = 8

    @property
    def base(self) -> int:
        return month_index(self.first_month)

    @property
    def n_months(self) -> int:
        return month_index(self.last_month) - self.base + 1

    @property
    def data_end(self) -> str:
        """First day after the panel (exclusive)."""
        return month_name(self.base + self.n_months) + "-01"

    @property
    def months(self) -> list[str]:
        return [month_name(self.base + i) for i in range(self.n_months)]

    @property
    def last_label_idx(self) -> int:
        return self.n_months - 1 - self.gap_months - self.outcome_months

    @property
    def embargo(self) -> int:
        return self.gap_months + self.outcome_months

    @classmethod
    def from_dates(cls, lo: dt.datetime, hi: dt.datetime, snap: dt.datetime | None, **kw) -> "PanelConfig":
        """Bounds of an unseen data set: last month dropped when it ends before day 28."""
        snap = snap or hi
        last_day = snap.date() if snap.date() <= hi.date() else hi.date()
        last = last_day.year * 12 + last_day.month - 1
        if last_day.day < 28:
            last -= 1
        return cls(first_month=lo.strftime("%Y-%m"), last_month=month_name(last),
                   snapshot=snap.strftime("%Y-%m-%d"), **kw)


# Bounds used on the star-schema test tables.
TEST_TABLES = PanelConfig(
    first_month="1999-09", last_month="2001-08", snapshot="2001-09-01",
    invoice_min="1999-01-01", invoice_max="2002-12-31",
    stress_terms="promo|old", invoice_stress_terms="promo|old",
    home_countries=("EUROPE", "UNK"), holdout_companies=20, holdout_max_group=60,
)
