"""Fits, the model store, and everything that a stored score feeds."""

import random

import pytest
from pyspark.sql import functions as F

from cashlens.config import PanelConfig
from cashlens.operators import decisions as dc, labels as lb, model as md, model_store as ms, predicting as pr
from cashlens.operators.panel import CATEGORICAL, FEATURES
from cashlens.sources.treasury import CompanySubset, StarTreasury, detect_config

SF = "/root/testdata/sf0.001"
QUICK = md.ModelConfig(iterations=25, depth=4, subsample=1.0)
MOVED = sorted({f for m in dc.METRICS for f in (r[1] for r in dc.LEVERS if r[0] == m)} | {r[1] for r in dc.SCENARIOS})


@pytest.fixture(scope="module")
def rows(spark):
    """Training rows whose outcome hangs on every feature that a lever or scenario moves."""
    rng = random.Random(4)
    scale = {f: 30.0 if "dpd_mean" in f or "days" in f else 8.0 if f.endswith("_log") else 1.0 for f in MOVED}
    out = []
    for i in range(1500):
        x = {f: rng.random() * s for f, s in scale.items()}
        x["top1_in_share"], x["cash_months_of_outflow"], x["credit_util_T"] = rng.random(), rng.random() * 4 - 1, rng.random()
        z = sum((x[f] / s - 0.5) * (1 if i_ % 2 else -1) for i_, (f, s) in enumerate(scale.items()))
        out.append((i, "2001-01", i % 12, int(rng.random() < 1 / (1 + 2.7 ** (-3 * z))), 0.5, *x.values()))
    df = spark.createDataFrame(out, "company_id long, T string, t_idx int, y int, score double, " + ", ".join(f"{f} double" for f in scale))
    rest = {f: F.lit("x") if f in CATEGORICAL else F.rand(hash(f) % 1000) for f in ["pay_term_days_w6", "pay_bad_share_w6", *FEATURES, "size_cohort"] if f not in scale}
    return df.withColumns({**rest, "pay_term_days_w6": F.lit(30.0)}).cache()


@pytest.fixture(scope="module")
def art(spark, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    meta = {"features_B": MOVED, "features_A": ["top1_in_share"], "platt": (1.0, 0.0), "main_model": "boosted_B", "size_edges": [1.0, 2.0, 3.0]}
    models = {"boosted_B": md.fit_boosted(rows, MOVED, QUICK), "boosted_A": md.fit_boosted(rows, ["top1_in_share"], md.ModelConfig(iterations=3))}
    ms.promote(spark, root, ms.store(spark, root, models, meta), first=True)
    return root, models, meta


@pytest.mark.parametrize("fitted", [False, True])
def test_every_lever_and_scenario_moves_the_score(spark, rows, art, fitted):
    score = ms.Artefact.load(spark, art[0]) if fitted else dc.card
    base = rows.limit(60)
    status = base.select("company_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric_id"), F.lit(a).alias("value"), F.lit(b).alias("reference"),
                                                                    F.lit("breach").alias("status")) for m, a, b in [
        ("dso", 60.0, 30.0), ("dpo", 20.0, 60.0), ("ccc", 40.0, 10.0), ("dscr", 0.4, 1.25), ("cash_days", 10.0, 60.0), ("credit_usage", 0.9, 0.8),
        ("concentration", 0.6, 0.3)]])).alias("s")).select("company_id", "s.*")
    grid = dc.whatif_grid(base, status, score).groupBy("metric_id").agg(F.max(F.abs("score_delta")).alias("e")).collect()
    assert {r.metric_id: r.e > 0 for r in grid} == dict.fromkeys(dc.METRICS, True)
    done = dc.decisions(base, status, score).groupBy("lever").agg(F.max(F.abs("score_impact")).alias("e")).collect()
    assert {"collect_faster", "pay_slower", "refinance", "open_credit_line", "diversify"} <= {r.lever for r in done if r.e > 0}
    plan = dc.plan_rescore(base, dc.default_targets(status), score).groupBy("metric_id").agg(F.max(F.abs("marginal")).alias("e")).collect()
    assert {r.metric_id: r.e > 0 for r in plan} == {m: True for m in dc.METRICS if m != "ccc"}
    after = dc.scenario_rescore(base, score).groupBy("scenario").agg(F.max(F.abs(F.col("after") - F.col("before"))).alias("e")).collect()
    assert {r.scenario: r.e > 0 for r in after} == dict.fromkeys(dc.scenarios(), True)


def test_one_pass_equals_rows_scored_alone(spark, rows, art):
    """A variant's health is that of a row that simply holds the new values."""
    score, base = ms.Artefact.load(spark, art[0]), rows.limit(20)
    got = {r.company_id: r.after for r in dc.scenario_rescore(base, score).where("scenario = 'lose_main_client'").collect()}
    alone = score(base.withColumns({f: c.cast("double") for f, c in dc.scenarios()["lose_main_client"].items()}), "p")
    assert got == {r.company_id: pytest.approx(100 * (1 - r.p)) for r in alone.collect()}


def test_rare_categories_share_a_bucket_in_fit_and_transform(spark):
    rng = random.Random(1)
    rows = [(i, "2001-01", 0, rng.random(), f"rare{i % 40}" if i % 5 == 0 else "xy"[i % 2]) for i in range(800)]
    df = spark.createDataFrame([(*r, int(r[4].startswith("rare") or rng.random() < .2)) for r in rows], "company_id long, T string, t_idx int, v double, country string, y int")
    probe = spark.createDataFrame([(i, "m", 0, 0.5, c) for i, c in enumerate(["rare0", "rare1", "never seen", None, "x", "y"])],
                                  "company_id long, T string, t_idx int, v double, country string")
    assert md.category_levels(df, ["country"], 25) == {"country": ["x", "y"]} or md.category_levels(df, ["country"], 25) == {"country": ["y", "x"]}
    for fit in (md.fit_logistic, md.fit_boosted):
        p = [r.p for r in md.predict(fit(df, ["v", "country"], QUICK), probe, ["v", "country"]).orderBy("company_id").collect()]
        assert p[0] == pytest.approx(p[1]) == pytest.approx(p[2]) == pytest.approx(p[3])
        assert p[0] > 0.75 > 0.5 > max(p[4:])


def test_store_versions_and_pointer(spark, rows, art, tmp_path):
    root, (_, models, meta) = str(tmp_path), art
    one = ms.store(spark, root, models, meta)
    ms.promote(spark, root, one, first=True)
    reader = ms.Artefact.load(spark, root)
    two = ms.store(spark, root, models, {**meta, "platt": (2.0, 0.5)})
    assert ms.current(spark, root) == one and one != two               # stored, not yet current
    ms.promote(spark, root, two)
    assert ms.current(spark, root) == two and ms.Artefact.load(spark, root).version == two
    assert reader.version == one and reader(rows.limit(3), "p").count() == 3
    assert ms.Artefact.load(spark, root, one).meta["platt"] == [1.0, 0.0]
    ms.promote(spark, root, one)                                       # and back
    assert ms.current(spark, root) == one


def test_ensemble_choice_is_applied(spark, rows, art):
    models = {**art[1], "forest_B": md.fit_forest(rows, MOVED, md.ModelConfig(iterations=4, depth=3))}
    make = lambda main: ms.Artefact("v", models, {**art[2], "main_model": main})                   # noqa: E731
    df = rows.limit(30)
    one = {r.company_id: r.p for r in make("boosted_B").raw(df, "p").collect()}
    two = {r.company_id: r.p for r in md.predict(models["forest_B"], df, MOVED).collect()}
    got = {r.company_id: r.p for r in make("ensemble_B").raw(df, "p").collect()}
    assert got == {k: pytest.approx((one[k] + two[k]) / 2) for k in one} and got != one


def test_contributions_sum_to_the_margin(rows, art):
    c = md.contributions(art[1]["boosted_B"], rows.limit(40), MOVED).groupBy("company_id").agg(
        F.sum("phi").alias("total"), F.first("base").alias("base"), F.first("margin").alias("margin"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.n == len(MOVED) and r.base + r.total == pytest.approx(r.margin) for r in c)


def test_predictions_of_unseen_companies(spark, tmp_path):
    """Four files; the same result whichever other companies are around."""
    star = StarTreasury(spark, SF)
    ids = star.table("companies", "company_id", "group_id").orderBy("group_id", "company_id").limit(3).select("company_id").cache()
    more = star.table("companies", "company_id").join(ids, "company_id", "left_anti").orderBy("company_id").limit(2).union(ids)
    alone = CompanySubset(star, ids, star.cfg)
    cfg = detect_config(alone.table("transactions", "date"), alone.table("balances", "date"))
    x = spark.createDataFrame([(i, "m", 0, i % 2, float(i % 9), float(i % 5), "ab"[i % 2]) for i in range(200)],
                              "company_id long, T string, t_idx int, y int, days_of_cash double, pay_dpd_mean_w6 double, size_cohort string")
    feats = ["days_of_cash", "pay_dpd_mean_w6", "size_cohort"]
    art = ms.Artefact("v1", {"boosted_B": md.fit_boosted(x, feats, md.ModelConfig(iterations=3)), "boosted_A": md.fit_boosted(x, feats[:1], md.ModelConfig(iterations=2))},
                      {"features_B": feats, "features_A": feats[:1], "platt": (1.0, 0.0), "main_model": "boosted_B", "size_edges": [1e4, 1e5, 1e6]})
    first = pr.predict(CompanySubset(star, ids, cfg), art, cfg)
    second = pr.predict(CompanySubset(CompanySubset(star, more, star.cfg), ids, cfg), art, cfg)
    for name in ("predictions", "predictions_latest", "explanations", "changes"):
        a, b = (sorted(map(str, r[name].drop("t_idx").collect())) for r in (first, second))
        assert a == b and a, name
    assert first["predictions"].select("company_id").distinct().count() == 3
    pr.write(first, str(tmp_path / "out"))
    latest = spark.read.option("header", True).csv(str(tmp_path / "out/predictions_latest"))
    assert latest.columns == pr.LATEST and latest.where("main_reasons is null").count() == 0
    s = spark.read.json(str(tmp_path / "out/summary")).first()
    assert s.n_companies == 3 and s.first_month == cfg.first_month and sum(v for v in s.health_band.asDict().values() if v) == latest.count()


def test_unseen_panel_is_built_beside_the_fits(spark, monkeypatch):
    """The panel of the unseen companies doesn't wait for the model; it is made anew only for a version with other bounds."""
    import threading
    from types import SimpleNamespace
    from cashlens.plans import modelling as mo
    built = threading.Event()
    ids, subset = spark.range(2).withColumnRenamed("id", "company_id"), SimpleNamespace(table=lambda *a: None, cfg="cfg")
    for at, name, fake in ((mo, "write_once", lambda df, name: df), (mo.lb, "group_holdout", lambda t: ids), (mo, "CompanySubset", lambda t, ids, cfg: subset),
                           (mo, "detect_config", lambda *a: "cfg"), (mo.cm, "write_monthly", lambda *a: None), (mo, "size_edges", lambda t: [1.0, 2.0]),
                           (pr, "features", lambda t, edges: built.set() or edges), (pr, "predict", lambda t, model, cfg, x=None: x)):
        monkeypatch.setattr(at, name, fake)
    for held, want in (([1.0, 2.0], [1.0, 2.0]), ([1.0, 3.0], None)):
        built.clear()
        monkeypatch.setattr(mo, "served", lambda t: SimpleNamespace(meta={"size_edges": held if built.wait(20) else "too late"}))
        assert mo.unseen(SimpleNamespace(spark=spark, cfg=None)) == want


def test_subsets_share_one_preparation(spark, rows):
    few = ["top1_in_share", "cash_months_of_outflow", "country"]
    shared = md.prepare_logistic(rows, [*MOVED, "country"], QUICK)
    alone, side = md.fit_logistic(rows, few, QUICK), md.fit_logistic(rows, few, QUICK, shared)
    both = md.predict(side, md.predict(alone, rows, few, "p_alone"), few, "p_side")
    assert both.agg(F.max(F.abs(F.col("p_alone") - F.col("p_side")))).first()[0] < 1e-9
    assert md.predict(alone, rows, few).agg(F.stddev("p")).first()[0] > 0


def test_labels_share_one_preparation(spark, rows):
    """A preparation with another label fits as that label alone does."""
    few = ["top1_in_share", "cash_months_of_outflow", "country"]
    both = rows.withColumn("y_other", (F.col("top1_in_share") > 0.2).cast("int"))
    other = md.relabelled(md.prepare_logistic(both, few, QUICK), "y_other")
    alone = md.fit_logistic(both.withColumn("y", F.col("y_other")), few, QUICK)
    d = md.predict(md.fit_logistic(other.frame, few, QUICK, other), md.predict(alone, rows, few, "p_alone"), few, "p_side")
    assert d.agg(F.max(F.abs(F.col("p_alone") - F.col("p_side")))).first()[0] < 1e-9


def test_thresholds_of_several_percentiles(spark):
    index = spark.createDataFrame([(i / 10, i > 10) for i in range(21)], "D double, is_reserved boolean")
    got = lb.thresholds(index, {"a": 0.85, "b": 0.25}).first()
    assert (round(got.a, 9), round(got.b, 9)) == (0.85, 0.25)


def test_fits_that_wait_for_the_driver_run_side_by_side(spark):
    """Some 100,000 rows keep the cores busy for a part of the time only."""
    import threading
    met = threading.Barrier(3, timeout=20)
    md.side_by_side(spark, [met.wait] * 3, 100_000)                    # breaks unless all three run at once


def test_fits_of_few_rows_run_side_by_side(spark):
    import threading
    met = threading.Barrier(3, timeout=20)

    def job(i):
        met.wait()                                                     # breaks unless all three run at once
        return i, spark.range(i).count()
    assert md.side_by_side(spark, [lambda i=i: job(i) for i in (1, 2, 3)], 1000) == [(1, 1), (2, 2), (3, 3)]
    one = []
    md.side_by_side(spark, [lambda i=i: one.append((i, threading.current_thread() is threading.main_thread())) for i in (1, 2)], 10**9)
    assert one == [(1, True), (2, True)]


def test_models_of_a_version_are_written_side_by_side(spark, tmp_path):
    import threading
    met = threading.Barrier(3, timeout=20)

    class Model:
        def write(self):
            return self

        def save(self, path):
            met.wait()                                                 # breaks unless all three are written at once
    version = ms.store(spark, str(tmp_path), {n: Model() for n in "abc"}, {})
    assert (tmp_path / "versions" / version / "metadata").exists()


@pytest.mark.parametrize("main, n", [("ensemble_B", 3), ("boosted_B", 2)])
def test_final_fits_do_not_wait_for_the_choice(spark, monkeypatch, main, n):
    import threading

    from cashlens.plans import modelling as m
    done, stored = threading.Event(), []

    def fitted(t, kind, features, fold, mc=None):
        if (kind, fold) == ("forest", None):
            done.set()
        return kind + features

    def choice(t):
        assert done.wait(20)
        return main, "p"
    for name, fake in {"train_rows": lambda t: spark.range(5).withColumn("T", F.lit("2001-01")), "fitted": fitted, "choice": choice,
                       "oof": lambda t: None, "size_edges": lambda t: [1.0, 2.0, 3.0]}.items():
        monkeypatch.setattr(m, name, fake)
    monkeypatch.setattr(md, "fit_platt", lambda *a: (1.0, 0.0))
    monkeypatch.setattr(md, "room", lambda *a: 100)
    monkeypatch.setattr(ms, "store", lambda spark, root, models, meta: stored.append((meta["rows"], models)) or meta["rows"])
    monkeypatch.setattr(ms, "promote", lambda *a, **k: None)
    t = StarTreasury(spark, SF)
    m.stored(t)
    kept = dict(stored)
    assert len(kept["all labelled"]) == n and kept["holdout training"] == {"boosted_B": "boostedB", "boosted_A": "boostedA"}
