"""Checks on written insights: every number must come from the data behind the text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- Fixed values: number pattern and accepted insight kinds and severities --------------------
NUMBER = r"(\d+(?:[.,]\d+)*)"
KINDS = ("trend", "anomaly", "risk", "opportunity", "action")
SEVERITIES = ("info", "watch", "alert")


def readings(token: Column) -> Column:
    """(value, tolerance) of a token in English and Spanish notation; unreadable ones drop out."""
    english = F.replace(token, F.lit(","), F.lit(""))
    spanish = F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit("."))

    def one(s):
        decimals = F.when(F.instr(s, ".") > 0, F.length(F.substring_index(s, ".", -1))).otherwise(0)
        v = F.when(s.rlike(r"^\d+(\.\d+)?$"), s.try_cast("double"))
        return F.struct(v.alias("v"), (0.5 * F.pow(F.lit(10.0), -decimals) + 1e-9).alias("tol"))
    return F.filter(F.array(one(english), one(spanish)), lambda r: r["v"].isNotNull())


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))


def known_values(text: Column) -> Column:
    """All values the numbers of a digest can stand for."""
    return F.array_distinct(F.transform(F.flatten(F.transform(tokens(text), readings)), lambda r: r["v"]))


def grounded(text: Column, known: Column) -> Column:
    """True when every number of the text is a known value, or a known ratio as a percentage."""
    def ok(token):
        return F.exists(readings(token), lambda r: F.exists(
            known, lambda k: (F.abs(k - r["v"]) <= r["tol"]) | (F.abs(100 * k - r["v"]) <= r["tol"])))
    return F.forall(tokens(text), ok)


def valid_insights(insights: Column, known: Column, least: int = 3, most: int = 6) -> Column:
    """Well-formed, grounded insights in order, at most six; NULL when fewer than three remain."""
    def ok(i):
        filled = (F.length(F.trim(i["title"])) > 0) & (F.length(F.trim(i["explanation"])) > 0) & (F.size(i["evidence"]) > 0)
        text = F.concat_ws(" ", i["title"], i["explanation"], F.array_join(i["evidence"], " "))
        return i["kind"].isin(*KINDS) & i["severity"].isin(*SEVERITIES) & filled & grounded(text, known)
    kept = F.filter(insights, ok)
    return F.when(F.size(kept) >= least, F.slice(kept, 1, most))
