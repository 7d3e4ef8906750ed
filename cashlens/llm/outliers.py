"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Every text gives counts by built-in functions; their logarithms and shares make a statistic vector. For each language
and source, and for each language, minimum-covariance-determinant estimates of centre and scatter are found by
concentration steps: from the current estimate every row's Mahalanobis distance, then mean and covariance of the
``keep`` share of rows with the smallest ones, until the round limit. Two deterministic starts (medians with
absolute deviations; the covariance of ranks squashed by tanh) run side by side and the smaller determinant wins. A row is
rejected beyond the chi-square cut.

The share of nearest rows is cut at a histogram bin of the logarithm of the distance, so no group is ever sorted or
gathered: a step is one partial aggregation into (group, bin) sums of x and xx', and windows over a fixed number of
bins. A source with a third of all rows is as spread as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cashlens.llm.byte_bpe import let
from cashlens.llm.common import stage

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STATS = ("length", "word_length", "symbols", "dup_lines", "repeats")
DIMS = len(STATS)
#: Chi-square of 5 degrees: the 75 % point over the mean of the rows below it corrects the scatter of the kept share.
CONSISTENCY = {0.75: 1.5226}
BINS_PER_UNIT = 64
#: Added to each variance: a statistic that is nearly constant in a group doesn't make every small departure an outlier.
LEAST_VARIANCE = 0.02


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that the text holds twice or more.

    Windows are hashed twice over (64 bits each way), sorted with their places, and neighbours of equal hash marked;
    marked places in order then cover up to ``size`` words each, less what overlaps the next.
    """
    def marked(s: Column) -> Column:
        last = F.size(s) - 1

        def again(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False)
            after = F.when(i < last, F.get(s, i + 1)["h"] == x["h"]).otherwise(False)
            return before | after
        return F.array_sort(F.transform(F.filter(s, again), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")), lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")))["n"]

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.struct(
            F.xxhash64(*[F.get(w, i + k) for k in range(size)]).alias("h"), i.alias("i")))
    return let(words, lambda w: F.when(F.size(w) <= size, F.lit(0)).otherwise(
        let(F.array_sort(windows(w)), lambda s: let(marked(s), covered)))).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, BLANK, "") != "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"), words_of(F.col("text")).alias("w"), text.alias("text"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        "n_dup_lines", repeated_words(F.col("w")).alias("n_repeat_words"))


def statistics(c: DataFrame) -> DataFrame:
    """Transformed vector x of each row that has words: logs of amounts, and of shares over a small base share."""
    n = F.greatest(F.col("n_words").cast("double"), F.lit(1.0))
    chars = F.greatest(F.col("word_chars").cast("double"), F.lit(1.0))
    return c.withColumn("x", F.array(
        F.log1p(n), F.log(chars / n), F.log(F.col("n_symbols") / chars + 0.02),
        F.log(10 * F.col("n_dup_lines") / (n + 20) + 0.2), F.log(F.col("n_repeat_words") / (n + 20) + 0.05)))


def _cell(i: int, j: int) -> int:
    i, j = max(i, j), min(i, j)
    return i * (i + 1) // 2 + j


CELLS = DIMS * (DIMS + 1) // 2


def factor(est: DataFrame) -> DataFrame:
    """Adds the Cholesky factor ``f`` (lower cells) and ``logdet`` of covariance ``s``, column by column."""
    df, ridge = est, LEAST_VARIANCE
    for i in range(DIMS):
        for j in range(i + 1):
            v = F.get("s", F.lit(_cell(i, j))) + (F.lit(ridge) if i == j else F.lit(0.0))
            for k in range(j):
                v = v - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            df = df.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(v, F.lit(ridge))) if i == j else v / F.col(f"_l{j}{j}"))
    names = [f"_l{i}{j}" for i in range(DIMS) for j in range(i + 1)]
    logdet = sum((F.log(F.col(f"_l{i}{i}")) for i in range(DIMS)), F.lit(0.0)) * 2
    return df.withColumn("f", F.array(*names)).withColumn("logdet", logdet).drop(*names)


def distance(df: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance of x from centre m with factor f, by forward substitution."""
    for i in range(DIMS):
        v = F.get("x", F.lit(i)) - F.get("m", F.lit(i))
        for k in range(i):
            v = v - F.get("f", F.lit(_cell(i, k))) * F.col(f"_y{k}")
        df = df.withColumn(f"_y{i}", v / F.get("f", F.lit(_cell(i, i))))
    d2 = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(DIMS)), F.lit(0.0))
    return df.withColumn("d2", d2).drop(*[f"_y{i}" for i in range(DIMS)])


def moments(df: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Count, sums and cross sums by keys: one partial aggregation."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(F.get(value, F.lit(i))).alias(f"_a{i}") for i in range(DIMS)]
    aggs += [F.sum(F.get(value, F.lit(i)) * F.get(value, F.lit(j))).alias(f"_b{_cell(i, j)}") for i in range(DIMS) for j in range(i + 1)]
    return df.groupBy(*keys).agg(*aggs)


def gather(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean m and covariance s from summed moments."""
    sums = ["n"] + [f"_a{i}" for i in range(DIMS)] + [f"_b{c}" for c in range(CELLS)]
    df = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    m = [F.col(f"_a{i}") / F.col("n") for i in range(DIMS)]
    s = [F.greatest(F.col(f"_b{_cell(i, j)}") / F.col("n") - m[i] * m[j], F.lit(0.0)) if i == j else F.col(f"_b{_cell(i, j)}") / F.col("n") - m[i] * m[j]
         for i in range(DIMS) for j in range(i + 1)]
    return df.select(*keys, "n", F.array(*m).alias("m"), F.array(*s).alias("s"))


def starts(x: DataFrame, keys: list[str]) -> DataFrame:
    """Two first estimates of every group: medians with squared absolute deviations, and the tanh covariance."""
    med = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.array(
        *[F.percentile_approx(F.get("x", F.lit(i)), 0.5, F.lit(10000)) for i in range(DIMS)]).alias("m"))
    dev = x.join(F.broadcast(med), keys).groupBy(*keys).agg(F.array(*[F.greatest(1.4826 * F.percentile_approx(
        F.abs(F.get("x", F.lit(i)) - F.get("m", F.lit(i))), 0.5, F.lit(10000)), F.lit(0.05)) for i in range(DIMS)]).alias("sd"))
    base = stage(med.join(dev, keys), "mcd-median")
    diag = F.array(*[F.pow(F.get("sd", F.lit(i)), 2) if i == j else F.lit(0.0) for i in range(DIMS) for j in range(i + 1)])
    first = base.select(*keys, "rows", F.lit(0).alias("start"), "m", diag.alias("s"))
    squashed = x.join(F.broadcast(base), keys).select(*keys, F.array(*[
        F.tanh((F.get("x", F.lit(i)) - F.get("m", F.lit(i))) / F.get("sd", F.lit(i))) for i in range(DIMS)]).alias("x"))
    tanh = gather(moments(squashed, keys), keys).select(*keys, F.col("s").alias("t"))
    scaled = F.array(*[F.get("t", F.lit(_cell(i, j))) * F.get("sd", F.lit(i)) * F.get("sd", F.lit(j)) * 2.5
                       for i in range(DIMS) for j in range(i + 1)])
    second = base.join(tanh, keys).select(*keys, "rows", F.lit(1).alias("start"), "m", scaled.alias("s"))
    return first.union(second)


def mcd(x: DataFrame, keys: list[str], keep: float = 0.75, rounds: int = 5) -> DataFrame:
    """Robust centre and scatter by group: keys, rows, m, f, logdet."""
    est = stage(factor(starts(x, keys)).select(*keys, "rows", "start", "m", "f", "logdet"), "mcd-start")
    by = [*keys, "start"]
    for _ in range(rounds):
        near = distance(x.join(F.broadcast(est), keys))                # est: two rows for each language and source
        bin_ = F.floor(F.log(F.col("d2") + 1e-6) * BINS_PER_UNIT).cast("int")
        binned = moments(near.withColumn("bin", bin_).withColumn("rows_", F.col("rows")), [*by, "rows", "bin"])
        w = Window.partitionBy(*by).orderBy("bin")
        kept = (binned.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .where(F.col("before") < keep * F.col("rows")))
        new = gather(kept.drop("before"), [*by, "rows"])
        scaled = new.withColumn("s", F.transform("s", lambda v: v * CONSISTENCY[keep]))
        est = stage(factor(scaled).select(*keys, "rows", "start", "m", "f", "logdet"), "mcd-step")
    return est.groupBy(*keys).agg(F.first("rows").alias("rows"), F.min_by(F.struct("m", "f"), F.struct("logdet", "start")).alias("e")).select(
        *keys, "rows", "e.m", "e.f")


def outliers(docs: DataFrame, least_rows: int = 200, cut: float = 100.0) -> DataFrame:
    """Base counts, ``base_failed``, squared distance ``d2`` and ``kept`` of every document.

    A language and source with fewer than ``least_rows`` usable rows is judged by its language, and a language with
    fewer by all rows; with fewer than that altogether only the base rule speaks. ``cut`` is the squared distance
    beyond which a row is rejected (chi-square of 5 degrees exceeds 100 for no normal row of any corpus; text statistics
    have longer tails than normal ones). A null text has no word and fails the base rule, null lang and source are
    groups of their own, null keys stay, repeated rows are judged alike.
    """
    c = stage(counts(docs), "rule-counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    x = stage(statistics(c.withColumn("base_failed", failed)), "rule-statistics")
    use = x.where(~F.col("base_failed"))
    levels = []
    for level, (lang, source) in enumerate(((F.lit("*"), F.lit("*")), (F.col("lang"), F.lit("*")), (F.col("lang"), F.col("source")))):
        levels.append(use.select(F.lit(level).alias("level"), lang.alias("g_lang"), source.alias("g_source"), "x"))
    est = mcd(levels[0].union(levels[1]).union(levels[2]), ["level", "g_lang", "g_source"])
    est = stage(est.where(F.col("rows") >= least_rows), "mcd")
    of = [F.broadcast(est.where(F.col("level") == k).select(
        F.col("g_lang").alias(f"l{k}"), F.col("g_source").alias(f"s{k}"), F.struct("m", "f").alias(f"e{k}"))) for k in range(3)]
    judged = (x.join(of[2], (F.col("lang") == F.col("l2")) & (F.col("source") == F.col("s2")), "left")
              .join(of[1], F.col("lang") == F.col("l1"), "left").join(of[0], F.col("s0") == F.lit("*"), "left")
              .withColumn("e", F.coalesce("e2", "e1", "e0")).withColumn("m", F.col("e.m")).withColumn("f", F.col("e.f")))
    return distance(judged).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("d2") > cut, F.lit(False))).alias("kept"), "d2", "lang", "source")
