"""Queries that fit and apply models. Results depend on the optimiser, so most have no SQL."""

from __future__ import annotations

import threading
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from cashlens.functions.exprs import platt
from cashlens.operators import company_month as cm, decisions as dc, evaluation as ev, labels as lb, model as md, model_store as ms, predicting as pr, resampling as rs, serve as sv
from cashlens.operators.panel import FEATURE_BLOCK, feature_sets, panel
from cashlens.operators.scorecard import feature_panel, scored
from cashlens.plans.projecting import holdout, reserved_rows
from cashlens.plans.registry import query
from cashlens.sources.staging import fresh_path, staged, together, write_once
from cashlens.sources.treasury import CompanySubset, detect_config

MC = md.ModelConfig()
SETS = feature_sets()


def train_rows(t):
    """Labelled panel rows of companies that are not reserved, written once for all fits."""
    def build():
        lab, x = together(t.spark, [lambda: lb.labels(t), lambda: feature_panel(t)])
        return x.join(lab.where(~F.col("is_reserved")).select("company_id", "T", "y", "D"), ["company_id", "T"])
    return staged(t, "train", build)


def folds(t):
    return md.temporal_folds(t.cfg, t.cfg.last_label_idx)


def fitted(t, kind: str, features: str, fold: dict | None, mc=MC):
    """The model of one kind on one feature set and fold (None: all labelled rows), fitted at most once a session."""
    memo, key = t.__dict__.setdefault("_fits", {}), (kind, features, fold["name"] if fold else None)
    if key not in memo:
        rows = md.split(train_rows(t), fold)[0] if fold else train_rows(t)
        more = {"prepared": prepared(t, fold)} if kind == "logistic" else {}
        memo[key] = getattr(md, f"fit_{kind}")(rows, SETS[features], mc, **more)
    return memo[key]


def prepared(t, fold: dict | None) -> md.Prepared:
    """What the logistic fits of a fold share, over all features; made and written once."""
    memo, key = t.__dict__.setdefault("_fits", {}), ("prepared", fold["name"] if fold else None)
    if key not in memo:
        p = md.prepare_logistic(md.split(train_rows(t), fold)[0] if fold else train_rows(t), SETS["B"], MC)
        memo[key] = replace(p, frame=write_once(p.frame.select("label", "w", *md.logistic_columns(p)), "prepared"))
    return memo[key]


def fit_all(t, wanted: list[tuple[str, str, dict | None]]) -> None:
    """Fit the (kind, feature set, fold) that this session hasn't fitted yet, side by side where there is room."""
    if any(kind == "logistic" for kind, _, _ in wanted):
        for fold in {f["name"] if f else None: f for kind, _, f in wanted if kind == "logistic"}.values():
            prepared(t, fold)
    rows = train_rows(t).count()
    md.side_by_side(t.spark, [partial(fitted, t, *w) for w in wanted], rows)


def holdout_scores(t, kind: str, sets: list[str]) -> DataFrame:
    """Holdout metrics of one model kind on several feature sets."""
    hold = folds(t)[-1]
    e, out = md.split(train_rows(t), hold)[1], []
    fit_all(t, [(kind, name, hold) for name in sets])
    for name in sets:
        feats = SETS[name]
        p = md.predict(fitted(t, kind, name, hold), e.select("company_id", "T", "t_idx", "y", *(SETS["B"] if kind == "logistic" else feats)), feats)
        out.append(ev.metrics(write_once(p.select("company_id", "T", "y", "p"), "pred"), "p").select(F.lit(name).alias("features"), "*"))
    return reduce(DataFrame.unionByName, out)


AB = {k: SETS[k] for k in ("A", "B")}
query("fit_lr")(lambda t: holdout_scores(t, "logistic", ["A", "B"]))
query("fit_gbt")(lambda t: holdout_scores(t, "boosted", ["A", "B"]))
query("fit_gbt2")(lambda t: holdout_scores(t, "forest", ["B"]))


@query("encode")
def _encode(t):
    """Every category of every row, by the levels frozen on the holdout's training rows."""
    train = md.split(train_rows(t), folds(t)[-1])[0]
    levels = md.category_levels(train, list(md.CATEGORIES), MC.min_frequency)
    return scored(t).select("company_id", "T", *[
        F.when(F.col(c).isin(*known), F.col(c)).otherwise(md.OTHER).alias(c) for c, known in levels.items()])


@query("feature_sets")
def _sets(t):
    rows = [(n, FEATURE_BLOCK[f], f) for n, fs in SETS.items() for f in fs]
    d = t.spark.createDataFrame(rows, "set string, block string, feature string")
    filled = feature_panel(t).agg(*[F.avg(F.col(f).isNotNull().cast("int")).alias(f) for f in SETS["B"]])
    cover = filled.unpivot([], SETS["B"], "feature", "coverage")
    return d.join(F.broadcast(cover), "feature").groupBy("set").agg(                       # one row per feature
        F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("mean_coverage"))


def oof(t):
    """Out-of-fold scores of both tree models over the cross-validation folds."""
    def build():
        parts = []
        fit_all(t, [(kind, "B", f) for f in folds(t)[:-1] for kind in ("boosted", "forest")])
        for f in folds(t)[:-1]:
            e = md.split(train_rows(t), f)[1].select("company_id", "T", "t_idx", "y", *SETS["B"])
            one = md.predict(fitted(t, "boosted", "B", f), e, SETS["B"], "p1")
            both = md.predict(fitted(t, "forest", "B", f), one, SETS["B"], "p2")
            parts.append(both.select("company_id", "T", "t_idx", "y", "p1", "p2").withColumn("fold", F.lit(f["name"])))
        return reduce(DataFrame.unionByName, parts).withColumn("p_avg", md.average("p1", "p2"))
    return staged(t, "oof", build)


def choice(t) -> tuple[str, str]:
    """(main model, its out-of-fold column): the average only if it gains enough in cross-validation (one row)."""
    memo = t.__dict__.setdefault("_fits", {})
    if "choice" not in memo:
        memo["choice"] = ("ensemble_B", "p_avg") if _ensemble(t).first().selected else ("boosted_B", "p1")
    return memo["choice"]


@query("ensemble")
def _ensemble(t):
    """Mean cross-validated average precision of the single model and of the average, and the choice."""
    o = oof(t)
    one = ev.auc_pr(o, "p1", ["fold"]).agg(F.avg("auc_pr").alias("single"))
    two = ev.auc_pr(o, "p_avg", ["fold"]).agg(F.avg("auc_pr").alias("average"))
    return one.crossJoin(two).withColumn("selected", F.col("average") - F.col("single") >= MC.ensemble_gain)   # single rows


@query("platt_fit")
def _platt(t):
    """Calibration of the chosen main model."""
    p = choice(t)[1]
    a, b = md.fit_platt(oof(t), p)
    cal = oof(t).withColumn("p_cal", platt(p, a, b))
    return cal.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.avg(F.pow(F.col(p) - F.col("y"), 2.0)).alias("brier_raw"),
                   F.avg(F.pow(F.col("p_cal") - F.col("y"), 2.0)).alias("brier_calibrated"))


@query("ablation")
def _ablation(t):
    """Holdout change when a block is removed from all, or added to the structural block."""
    m = holdout_scores(t, "logistic", list(SETS)).select("features", "auc_pr", "auc_roc")
    ref = m.where(F.col("features").isin("A", "B")).select(F.col("features").alias("reference"), F.col("auc_pr").alias("ref_pr"))
    m = m.withColumn("reference", F.when(F.col("features").startswith("A"), "A").otherwise("B"))
    return m.join(ref, "reference").withColumn("delta", F.col("auc_pr") - F.col("ref_pr"))


@query("unseen_groups")
def _unseen(t):
    """A quarter of the groups held out whole: the same model on unseen and on seen companies."""
    g = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("unseen:"), F.coalesce("group_id", F.col("company_id").cast("string")))), 1, 8), 16, 10)
               .cast("long"), F.lit(4))
    ids = t.table("companies", "company_id", "group_id").select("company_id", (g == 0).alias("unseen"))
    df = train_rows(t).join(ids, "company_id")
    hold = folds(t)[-1]
    tr, e = md.split(df, hold)
    out = []
    for name, feats in AB.items():
        m = md.fit_logistic(tr.where(~F.col("unseen")), feats, MC)
        p = write_once(md.predict(m, e.select("company_id", "T", "t_idx", "y", "unseen", *feats), feats).select("T", "y", "p", "unseen", "company_id"), "unseen")
        out.append(ev.auc_pr(p, "p", ["unseen"]).join(ev.auc_roc(p, "p", ["unseen"]), "unseen").join(ev.brier(p, "p", ["unseen"]), "unseen")
                   .withColumn("features", F.lit(name)))
    return out[0].unionByName(out[1])


@query("sensitivity")
def _sensitivity(t):
    """Lift of B over A under other outcome lengths and label percentiles.

    An outcome length has one index, one join with the panel and one preparation: its percentiles differ in the label only."""
    cuts = {"y_85": 0.85, "y_90": 0.90}
    x, *indexes = together(t.spark, [lambda: feature_panel(t), *[
        lambda m=m: write_once(lb.index_table(t, t.cfg.gap_months, m), "variant-index") for m in (6, 3)]])

    def variant(months: int, index: DataFrame):
        lab = index.where(~F.col("is_reserved")).crossJoin(F.broadcast(lb.thresholds(index, cuts))).select(       # a single row
            "company_id", "T", *[(F.col("D") > F.col(c)).cast("int").alias(c) for c in cuts])
        df = write_once(x.join(lab, ["company_id", "T"]), "variant")
        cfg = replace(t.cfg, outcome_months=months)
        tr, e = md.split(df, md.temporal_folds(cfg, cfg.last_label_idx)[-1])
        p = md.prepare_logistic(tr.withColumn("y", F.col("y_85")), SETS["B"], MC)
        return replace(p, frame=write_once(p.frame.select(*cuts, *md.logistic_columns(p)), "variant-prepared")), e

    variants = dict(zip((6, 3), together(t.spark, [partial(variant, *v) for v in zip((6, 3), indexes)])))
    weighed = {(m, c): md.relabelled(p, c) for m, (p, _) in variants.items() for c in cuts}

    def lift(months: int, cut: str, name: str) -> DataFrame:
        m = md.fit_logistic(weighed[months, cut].frame, SETS[name], MC, weighed[months, cut])
        e = variants[months][1].select("company_id", "T", "t_idx", F.col(cut).alias("y"), *SETS["B"])
        p = md.predict(m, e, SETS[name]).select("T", "y", "p")
        return ev.auc_pr(write_once(p, "pred"), "p").select(
            F.lit(months).alias("outcome_months"), F.lit(cuts[cut]).alias("percentile"), F.lit(name).alias("features"), "auc_pr")
    jobs = [partial(lift, m, c, name) for c in cuts for m in (6, 3) for name in AB]
    return reduce(DataFrame.unionByName, md.side_by_side(t.spark, jobs, max(p.n for p in weighed.values())))


def size_edges(t) -> list[float]:
    """Sizes that bound the training run's size quartiles (one aggregated row); a second thread that asks for them meanwhile waits."""
    memo = t.__dict__.setdefault("_fits", {})
    with t.__dict__.setdefault("_locks", {}).setdefault("size_edges", threading.RLock()):
        if "edges" not in memo:
            r = panel(t, ["size_cohort"], ["size_outflow_12m"]).groupBy("size_cohort").agg(F.max("size_outflow_12m").alias("hi")).collect()   # four rows
            hi = {x.size_cohort: x.hi for x in r}
            memo["edges"] = [hi.get(q, float("-inf")) for q in ("q1", "q2", "q3")]
        return memo["edges"]


def stored(t) -> str:
    """Root of the model store: the main model on all labelled rows, the structural model beside it, and the holdout's
    model that has seen only months with known outcomes then. Two versions: the holdout's, then the final one.

    Where the cores have room for all fits, cross-validation and what follows from it run beside the final fits, the
    forest among them before it is known whether the average is chosen; it is stored only then."""
    memo = t.__dict__.setdefault("_fits", {})
    if "root" not in memo:
        root, hold, rows = fresh_path(t.spark, "models"), folds(t)[-1], train_rows(t).count()
        last = [("boosted", s, f) for f in (hold, None) for s in ("B", "A")] + [("forest", "B", None)]
        wide = md.room(t.spark, rows) >= 2 * len(folds(t)[:-1]) + len(last)

        def calibrated():
            main, p = choice(t)
            return main, md.fit_platt(oof(t), p)
        (main, platt_), _, edges, seen = together(t.spark, [
            calibrated, lambda: fit_all(t, last if wide else last[:-1]), lambda: size_edges(t),
            lambda: train_rows(t).agg(F.count(F.lit(1)), F.min("T"), F.max("T")).first()], None if wide else 1)
        meta = {"features_B": SETS["B"], "features_A": SETS["A"], "platt": platt_, "size_edges": edges,
                "train_max": hold["train_max"], "embargo": t.cfg.embargo, "n_train_rows": seen[0], "train_months": seen[1:],
                "label": {"gap": t.cfg.gap_months, "outcome": t.cfg.outcome_months, "percentile": t.cfg.label_percentile}}
        first = {"boosted_B": fitted(t, "boosted", "B", hold), "boosted_A": fitted(t, "boosted", "A", hold)}
        final = {"boosted_B": fitted(t, "boosted", "B", None), "boosted_A": fitted(t, "boosted", "A", None)}
        if main == "ensemble_B":
            final["forest_B"] = fitted(t, "forest", "B", None)
        versions = together(t.spark, [
            lambda: ms.store(t.spark, root, first, {**meta, "main_model": "boosted_B", "rows": "holdout training"}),
            lambda: ms.store(t.spark, root, final, {**meta, "main_model": main, "rows": "all labelled"})])
        ms.promote(t.spark, root, versions[0], first=True)
        ms.promote(t.spark, root, versions[1])
        memo["root"] = root
    return memo["root"]


def served(t) -> ms.Artefact:
    """The current stored version, loaded once a session."""
    memo = t.__dict__.setdefault("_fits", {})
    if "served" not in memo:
        memo["served"] = ms.Artefact.load(t.spark, stored(t))
    return memo["served"]


@query("model_store")
def _store(t):
    """Every stored version as a reader finds it: pointer, models, features; the newest pointer is current."""
    log, now = ms.pointers(t.spark, stored(t)), ms.current(t.spark, stored(t))
    versions = [r.version for r in log.collect()]                                                                        # a row a version
    loaded = together(t.spark, [lambda v=v: ms.Artefact.load(t.spark, stored(t), v) for v in versions])
    rows = [(v, len(a.models), a.meta["main_model"], len(a.meta["features_B"]), len(a.meta["features_A"]), a.meta["rows"], v == now)
            for v, a in zip(versions, loaded)]
    found = t.spark.createDataFrame(rows, "version string, n_models int, main_model string, n_features int, n_features_a int, rows string, is_current boolean")
    return log.join(found, "version").drop("version")


@query("score_batch")
def _score_batch(t):
    """The panel scored by the current version: raw, calibrated, and by the structural model."""
    m, x = served(t), feature_panel(t)
    both = m.model_a(m.raw(x.select("company_id", "T", "t_idx", *m.meta["features_B"]), "score_raw"), "score_a")
    return both.select("company_id", "T", "t_idx", "score_raw", F.round(platt("score_raw", *m.meta["platt"]), 6).alias("score"), "score_a")


def unseen(t) -> dict[str, DataFrame]:
    """The reserved companies as an unseen data set, predicted by the stored model; results written once."""
    memo = t.__dict__.setdefault("_fits", {})
    if "unseen" not in memo:
        def tables():
            ids = write_once(lb.group_holdout(t).select("company_id"), "unseen-ids")
            probe = CompanySubset(t, ids, t.cfg)
            cfg = detect_config(probe.table("transactions", "date"), probe.table("balances", "date"))
            found = CompanySubset(t, ids, cfg)
            cm.write_monthly(found, ["cm_tx", "cm_cash", "cm_concentration", "cm_invoice_issued"])
            edges = size_edges(t)                                              # those that the version will hold
            return found, edges, pr.features(found, edges)
        (found, edges, x), model = together(t.spark, [tables, lambda: served(t)])          # the fits leave cores free
        memo["unseen"] = pr.predict(found, model, found.cfg, x=x if model.meta["size_edges"] == edges else None)
    return memo["unseen"]


@query("predict_new")
def _predict(t):
    """The files of a prediction run, read back: one row per company with score, health, reasons and largest change."""
    out = fresh_path(t.spark, "prediction")
    pr.write(unseen(t), out)
    read = lambda n: t.spark.read.option("header", True).option("escape", '"').schema(unseen(t)[n].schema).csv(f"{out}/{n}")
    change = read("changes").where("rank = 1").select("company_id", F.col("feature").alias("changed"), F.col("direction").alias("change"))
    listed = read("explanations").groupBy("company_id").agg(F.count(F.lit(1)).alias("n_explanations"))
    months = read("predictions").groupBy("company_id").agg(F.count(F.lit(1)).alias("n_months"))
    summary = t.spark.read.json(f"{out}/summary").select("n_companies", "latest_month", "first_month")                         # a single row
    return (read("predictions_latest").drop("model_version").join(change, "company_id", "left").join(listed, "company_id").join(months, "company_id")
            .crossJoin(F.broadcast(summary)))


def lever_rows(t):
    from cashlens.plans.deciding import now, status
    return now(t), status(t)


def levers_and_score(t):
    """Newest rows, metric states and the stored score, made side by side."""
    (base, status), score = together(t.spark, [lambda: lever_rows(t), lambda: served(t)])
    return base, status, score


@query("decisions_fitted")
def _decisions(t):
    return dc.decision_order(dc.decisions(*levers_and_score(t)))


@query("whatif_fitted")
def _whatif(t):
    return dc.whatif_grid(*levers_and_score(t))


@query("plan_fitted")
def _plan(t):
    base, status, score = levers_and_score(t)
    return dc.plan_rescore(base, dc.default_targets(status), score)


@query("scenario_fitted")
def _scenario(t):
    base, _, score = levers_and_score(t)
    return dc.scenario_rescore(base, score)


@query("contrib_tree")
def _tree(t):
    """Path contributions of the stored trees on the newest month; base plus sum equals the margin."""
    m = served(t)
    c = md.contributions(m.models["boosted_B"], sv.at_latest(feature_panel(t)), m.meta["features_B"])
    return c.groupBy("company_id", "t_idx").agg(F.sum("phi").alias("total"), F.first("base").alias("base"), F.first("margin").alias("margin"))


query("bootstrap")(lambda t: rs.bootstrap(holdout(t), "score_A", "score"))
