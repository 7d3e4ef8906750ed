"""Small Column builders shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from cashlens.config import HEALTH_BANDS, RISK_BANDS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Boolean → 1.0 / 0.0, NULL counts as false."""
    return F.when(cond, 1.0).otherwise(0.0)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def sum_if(cond: Column, value: Column) -> Column:
    """Sum with 0 (not NULL) for rows that do not match."""
    return F.sum(F.when(cond, value).otherwise(0.0))


def safe_div(a, b) -> Column:
    """a / b, NULL when |b| is not above 1e-9."""
    a, b = col(a), col(b)
    return F.when(F.abs(b) > 1e-9, a / b)


def clip(x, lo=None, hi=None) -> Column:
    """Bound a value and keep NULL (least/greatest alone would skip it)."""
    x = col(x)
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def slog(x) -> Column:
    x = col(x)
    return F.signum(x) * F.log1p(F.abs(x))


def inv_slog(x) -> Column:
    x = col(x)
    return F.signum(x) * F.expm1(F.abs(x))


def logit(p) -> Column:
    p = clip(p, 1e-6, 1 - 1e-6)
    return F.log(p / (1 - p))


def sigmoid(z) -> Column:
    return 1.0 / (1.0 + F.exp(-col(z)))


def platt(p, a: float, b: float) -> Column:
    """Sigmoid calibration on the log-odds scale."""
    return sigmoid(F.lit(a) * logit(p) + F.lit(b))


def month_idx(ts, base: int) -> Column:
    """Ordinal of a timestamp's month relative to the panel start."""
    ts = col(ts)
    return (F.year(ts) * 12 + F.month(ts) - 1 - F.lit(base)).cast("int")


def month_str(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def shift_month(month, n) -> Column:
    """'YYYY-MM' moved by n months."""
    return F.date_format(F.add_months(F.to_date(F.concat(col(month), F.lit("-01"))), n), "yyyy-MM")


def banded(x, bands, null_name: str) -> Column:
    """Value → band; bands are (upper bound exclusive, name), open-ended last."""
    x = col(x)
    out = reduce(lambda acc, b: acc.when(x < b[0], b[1]), bands[:-1], F.when(x.isNull(), null_name))
    return out.otherwise(bands[-1][1])


def risk_band(p) -> Column:
    return banded(p, RISK_BANDS, RISK_BANDS[-1][1])


def health_band(h) -> Column:
    """A missing value falls through to the lowest band."""
    h = col(h)
    out = F.when(h.isNull(), HEALTH_BANDS[-1][1])
    for lo, name in HEALTH_BANDS[:-1]:
        out = out.when(h >= lo, name)
    return out.otherwise(HEALTH_BANDS[-1][1])


def coarse_band(band) -> Column:
    b = col(band)
    return F.when(b.isin("sólida", "sana"), "healthy").when(b == "vigilar", "stable").when(b == "riesgo", "risk")


def trend(trajectory) -> Column:
    t = col(trajectory)
    return F.when(t == "mejorando", "up").when(t == "deteriorándose", "down").otherwise("flat")


def country_group(country, home=("ES", "UNK")) -> Column:
    c = col(country)
    return F.when(c.isin(*home), c).otherwise("OTHER")


def group_bucket(size) -> Column:
    n = F.coalesce(col(size), F.lit(1))
    return F.when(n <= 1, "1").when(n <= 5, "2-5").otherwise("6+")


def country_norm(country) -> Column:
    up = F.upper(col(country))
    return F.when(up.isin("ESPAÑA", "ESPANA", "SPAIN"), "ES").otherwise(up)


def clean_text(c) -> Column:
    """Trimmed text, empty → NULL."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def finite(x) -> Column:
    """NaN and infinities → NULL."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def rnd(x, digits: int) -> Column:
    return F.round(col(x), digits)


def last_n(arr, n: int) -> Column:
    """The last n elements, or all when there are fewer."""
    arr = col(arr)
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), F.lit(n))
