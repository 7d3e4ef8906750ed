"""Hand-made series and tables with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashlens.config import LABEL_WEIGHTS, PanelConfig
from cashlens.functions import exprs, neighbours, ranking, wording
from cashlens.operators import decisions as dc, health, model, narrative as nv, panel as pn, projection as pj, providers as pv

CFG = PanelConfig(first_month="2024-09", last_month="2026-08")


def series(spark, rows, cols="company_id long, t_idx int, x double"):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(rows)], cols)


def last(df, c="y"):
    return [r[c] for r in df.orderBy("t_idx").collect()]


@pytest.mark.parametrize("rows,final,at2", [
    ([1., 2., 3., 4., 5., 6., 7., 8.], 1.0, 1.0), ([5.] * 8, 0.0, 0.0), ([None, 1., None, 3., None, 5., None, 7.], 1.0, None)])
def test_slope(spark, rows, final, at2):
    y = last(series(spark, rows).select("t_idx", pn.roll_slope("x", 6).alias("y")))
    assert y[-1] == pytest.approx(final) and (y[2] == pytest.approx(at2) if at2 is not None else y[2] is None)


def test_roll_looks_back_only(spark):
    assert last(series(spark, [1., 2., 3., 4., 100.]).select("t_idx", pn.roll("x", 3).alias("y")))[3:] == [9.0, 107.0]


def test_safe_div(spark):
    df = spark.createDataFrame([(0, 1., 0.), (1, 2., 4.), (2, None, 1.)], "t_idx int, a double, b double")
    assert last(df.select("t_idx", exprs.safe_div("a", "b").alias("y"))) == [None, 0.5, None]


def test_folds_keep_the_embargo():
    folds = model.temporal_folds(CFG, 16)
    assert folds[-1]["eval"] == [15, 16]
    assert all(min(f["eval"]) - f["train_max"] >= 7 for f in folds)
    assert all(max(f["eval"]) < 15 for f in folds[:-1])


def test_encoder_unseen(spark):
    train = spark.createDataFrame([("x",), ("y",)], "c string")
    out = model.encode(spark.createDataFrame([("x",), ("zzz",)], "c string"), train, "c")
    assert {r.c for r in out.collect()} == {"x", "__other__"}


def test_label_weights():
    assert sum(LABEL_WEIGHTS.values()) == pytest.approx(1.0)


def test_health_rules(spark):
    runs = {1: [.05, .05, .05, .08, .15, .25, .35, .45, .55, .60, .65, .70], 2: [.05] * 12, 3: [.05] * 5 + [.40, .06] + [.05] * 5}
    df = spark.createDataFrame([(c, i, p) for c, ps in runs.items() for i, p in enumerate(ps)], "company_id long, t_idx int, p double")
    out = {}
    for r in health.add_health(df, "p", CFG).orderBy("t_idx").collect():
        out.setdefault(r.company_id, []).append(r)
    assert out[1][-1].trajectory == "deteriorándose" and out[1][-1].is_structural
    assert out[2][-1].trajectory == "estable" and out[2][-1].is_exceptional and out[2][-1].health_band == "sólida"
    assert any(r.is_blip for r in out[3]) and out[3][-1].trajectory == "estable"
    assert all(r.trajectory == "estable" for r in out[1][:3])


def test_missing_health_is_lowest_band(spark):
    assert spark.range(1).select(exprs.health_band(F.lit(None).cast("double")).alias("b")).first().b == "riesgo"


def scored(spark, runs):
    return spark.createDataFrame([(c, f"m{i:02d}", i, float(h), float(s)) for c, (hs, ss) in runs.items() for i, (h, s) in enumerate(zip(hs, ss))],
                                 "company_id long, T string, t_idx int, health double, health_smooth double")


def test_projection_state(spark):
    r = pj.states(scored(spark, {1: ([50, 52, 54, 60, 55], [50, 52, 54, 60, 61])})).orderBy(F.desc("t_idx")).first()
    assert (r.level, r.surprise, r.d1, r.d3) == (61, -6, 1, 9)


def test_projection_pool(spark):
    p = pj.pool(pj.states(scored(spark, {1: ([80] * 14, [80] * 14), 2: ([80] * 9, [80] * 9)}))).collect()
    assert len(p) == 5 and {r.company_id for r in p} == {1}


def fan_of(spark, runs, target, k=400, min_near=40):
    st = pj.states(scored(spark, {c: (x, x) for c, x in runs.items()}))
    tg = st.where(F.col("company_id") == target).orderBy(F.desc("t_idx")).limit(1)
    nb = pj.neighbours(tg, pj.pool(st), 24, k)
    return {r.h: r for r in pj.fan(pj.kernel(nb, min_near), tg).collect()}


def test_fan_follows_like_states(spark):
    runs = {i: [85] * 14 for i in range(10)} | {100 + i: [max(40 - 2 * j, 0) for j in range(14)] for i in range(10)}
    assert fan_of(spark, runs, 0)[6].median == pytest.approx(85)
    low = fan_of(spark, {**runs, 999: [50, 48, 46, 44, 42, 40]}, 999)
    assert all(r.low <= r.median <= r.high for r in low.values()) and low[6].median < 35 and low[6].prob_drop5 > 0.8


def test_fan_excludes_own_future(spark):
    runs = {i: [60] * 14 for i in range(1, 13)} | {50: [90 - 3 * j for j in range(14)]}
    assert fan_of(spark, runs, 50, k=5, min_near=1)[6].median > 43      # its own future would give 33


@pytest.mark.parametrize("seed,skew,leaf", [(1, False, 4096), (2, True, 4096), (3, False, 60), (4, True, 60)])
def test_neighbours_equal_brute_force(spark, seed, skew, leaf):
    rnd = random.Random(seed)
    def point(i):
        if skew and i % 3 == 0:
            return (50.0, 0.0, 0.0, 0.0)                     # a third of all points share one state
        return tuple(rnd.gauss(50, 20) if d == 0 else rnd.gauss(0, 4) for d in range(4))
    rows = [(i // 6, i % 6, *point(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "company_id long, t_idx int, level double, surprise double, d1 double, d3 double")
    pool = df.withColumn("delta", F.array(F.lit(0.0)))
    scale = pool.agg(*[F.stddev_pop(d).alias(f"s_{d}") for d in pj.DIMS])
    got = neighbours.nearest(df, pool, scale, pj.DIMS, pj.DIM_WEIGHT, 20, "company_id", 6, ["company_id", "t_idx"],
                             ["company_id", "t_idx"], [], leaf).collect()
    s = [scale.first()[f"s_{d}"] for d in pj.DIMS]
    mine = {}
    for r in got:
        mine.setdefault((r.company_id, r.t_idx), []).append((r["rank"], r.dist))
    for t in rows:
        ds = sorted(math.sqrt(sum(((p[2 + i] - t[2 + i]) / s[i] * pj.DIM_WEIGHT[i]) ** 2 for i in range(4))) for p in rows if p[0] != t[0])[:20]
        assert [d for _, d in sorted(mine[t[:2]])] == pytest.approx(ds, abs=1e-9)


def test_tree_leaves_and_buckets_are_even():
    """No leaf holds much more than its share and no bucket more than its bound, whatever the skew of the states."""
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(0, 5, (40_000, 4))
    x[: 8_000, 0] = 0.0                                              # a value that a fifth shares in one dimension
    x[8_000:12_000] = rng.normal(900, .01, (4_000, 4))               # a far, dense clump
    tree = neighbours.Tree(x[::4], 40)
    size = np.bincount(tree.leaf(x), minlength=tree.leaves)
    assert tree.leaves == 40 and size.min() > 0 and size.max() < 2.5 * len(x) / 40
    parts = neighbours.buckets(x)
    assert max(map(len, parts)) <= neighbours.BUCKET and sorted(np.concatenate(parts)) == list(range(len(x)))
    alike = np.zeros((1000, 4))
    assert [len(b) for b in neighbours.buckets(alike)] == [1000] and neighbours.Tree(alike, 8).leaves == 1


def test_popular_state_spreads(spark):
    """A state shared by most of the pool and asked by most targets: thinned in the pool, several tasks a leaf."""
    df = spark.range(3000).selectExpr("id as company_id", "cast(0 as int) as t_idx", "if(id % 10 < 8, 1.0D, id * 1.0D) as level",
                                      "0.0D as surprise", "0.0D as d1", "0.0D as d3")
    scale = spark.createDataFrame([(1.0,) * 4], ", ".join(f"s_{d} double" for d in pj.DIMS))
    n, neighbours.TARGETS_A_TASK = neighbours.TARGETS_A_TASK, 100
    try:
        got = neighbours.nearest(df, df, scale, pj.DIMS, [1.0] * 4, 5, "company_id", 1, ["company_id", "t_idx"], ["company_id", "t_idx"], [], 50)
        rows = got.where("company_id in (7, 8)").orderBy("company_id", "rank").collect()
        assert got.count() == 15_000
    finally:
        neighbours.TARGETS_A_TASK = n
    assert [r.p_company_id for r in rows if r.company_id == 7] == [0, 1, 2, 3, 4] and all(r.dist == 0 for r in rows if r.company_id == 7)
    assert {r.p_company_id for r in rows if r.company_id == 8} == {9, 0, 1, 2, 3} and rows[-1].dist == 7


def test_ranking_equals_brute_force(spark):
    rnd = random.Random(3)
    vals = [(i, "a" if i % 2 else "b", 0.5 if i % 3 == 0 else round(rnd.random(), 3)) for i in range(600)]
    df = spark.createDataFrame(vals, "id long, g string, v double")
    pct = {r.id: r.p for r in ranking.percent_rank_avg(df, ["g"], "v", "p").collect()}
    for i, g, v in vals:
        xs = [w for _, h, w in vals if h == g]
        assert pct[i] == pytest.approx((sum(x < v for x in xs) + (sum(x == v for x in xs) + 1) / 2) / len(xs))
    q = {r.g: (r.a, r.b) for r in ranking.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.85}).collect()}
    for g in "ab":
        xs = sorted(w for _, h, w in vals if h == g)
        for got, p in zip(q[g], (0.1, 0.85)):
            pos = p * (len(xs) - 1)
            lo = int(pos)
            assert got == pytest.approx(xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (pos - lo))
    for rows in (7, 1000):                                # many buckets, one bucket
        order = [r.id for r in ranking.row_numbers(df, ["v", "id"], "r", rows).orderBy("r").collect()]
        assert order == [i for i, _, _ in sorted(vals, key=lambda x: (x[2], x[0]))]


def test_buckets_follow_the_rows(spark):
    """Half of all rows hold one value: the running counts stay exact, and few values make one bucket, many make many."""
    vals = sorted([3.0] * 500 + [float(i * 7919 % 1000) for i in range(500)])
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(5)
    for rows in (3, 1000):
        got = {r.v: (r.n, r.n_before, r.n_total) for r in ranking.cumulative(df, [], "v", rows=rows).collect()}
        assert got == {v: (vals.count(v), vals.index(v), 1000) for v in set(vals)}
    keyed = df.withColumn("id", F.monotonically_increasing_id())
    assert ranking.bucketed(keyed, ["v", "id"], 1000).select("__b").distinct().count() == 1
    sizes = [r["count"] for r in ranking.bucketed(keyed, ["v", "id"], 20).groupBy("__b").count().collect()]
    assert len(sizes) > 40 and max(sizes) <= 60
    assert ranking.cumulative(df.where("v < 0"), [], "v").count() == 0


@pytest.mark.parametrize("rows", [40, 100_000])
def test_bootstrap_equals_weighted_average_precision(spark, rows):
    from cashlens.operators import resampling
    rnd = random.Random(5)
    data = [(i, "2024-01", rnd.choice([0, 0, 1]), 0.5 if i % 2 else round(rnd.random(), 2), rnd.random()) for i in range(700)]
    df = spark.createDataFrame(data, "company_id long, T string, y int, a double, b double")
    keyed = df.withColumn("h", F.xxhash64(F.lit(42), "company_id", "T"))
    w = {r.company_id: resampling.weights(np.array([r.h]), 20)[0] for r in keyed.collect()}
    for p, at in (("a", 3), ("b", 4)):
        got = {r.rep: r.ap for r in resampling.precision_of_replicates(keyed, p, 20, rows).collect()}
        for rep in range(20):
            tp = flagged = ap = 0
            every = sum(w[r[0]][rep] * r[2] for r in data)
            for v in sorted({r[at] for r in data}, reverse=True):
                hit = sum(w[r[0]][rep] * r[2] for r in data if r[at] == v)
                tp, flagged = tp + hit, flagged + sum(w[r[0]][rep] for r in data if r[at] == v)
                ap += hit / every * tp / max(flagged, 1)
            assert got[rep] == pytest.approx(ap)
    one = resampling.bootstrap(df, "a", "b", 50, rows=rows).first()
    assert one.replicates == 50 and one.lift_lo <= one.lift_mean <= one.lift_hi


@pytest.mark.parametrize("services,types,kind", [
    (["_paypal_es"], ["checking"], "pagos"), (["x"], ["expensesPlatform"], "gastos"), (["qonto_fr"], ["checking"], "fintech"),
    (["inhousebanking"], ["checking"], "interno"), (["x"], ["card"], "tarjetas"), (["x"], ["investment"], "inversión"), (["x"], ["loan", "card"], "banco")])
def test_provider_kinds(spark, services, types, kind):
    p = spark.createDataFrame([("b", s, t) for s in services for t in types], "bank_name string, service string, type string")
    assert pv.provider_kinds(p).first().kind == kind


BASE = {c: 1.0 for c in dc.LEVER_FEATURES} | {"cash_conversion_days_w6": 58.0, "rec_dpd_mean_w3": 20.0, "rec_dpd_mean_w6": 18.0,
        "pay_term_days_w6": 30.0, "pay_dpd_mean_w6": 5.0, "debt_service_ratio_w6": 0.5, "days_of_cash": 20.0, "cash_months_of_outflow": 0.7,
        "cash_min_w6_norm": 0.2, "credit_util_T": 0.9, "credit_util_max_w6": 0.95, "top1_in_share": 0.5}


@pytest.mark.parametrize("metric,target", [("dso", 42.0), ("dpo", 40.0), ("dscr", 1.25), ("cash_days", 60.0), ("credit_usage", 0.7), ("concentration", 0.3)])
def test_lever_round_trip(spark, metric, target):
    df = spark.createDataFrame([tuple(BASE.values())], ", ".join(f"{c} double" for c in BASE))
    moved = df.withColumns({f: c for f, c in dc.overrides(metric, F.lit(target)).items()})
    assert moved.select(dc.metric_values()[metric].alias("v")).first().v == pytest.approx(target)


def test_cash_floor_never_above_cushion(spark):
    df = spark.createDataFrame([tuple(BASE.values())], ", ".join(f"{c} double" for c in BASE))
    r = df.select(*[c.alias(f) for f, c in dc.overrides("cash_days", F.lit(60.0)).items()]).first()
    assert r.cash_months_of_outflow == 2.0 and 0 < r.cash_min_w6_norm <= 2.0


@pytest.mark.parametrize("text,ok", [("tardas 72 días", True), ("72,4 días", True), ("caja de 1.418.780 €", True), ("usa el 74 %", True),
                                     ("cae 18,9 puntos", True), ("tardas 95 días", False), ("caja de 1.500.000 €", False)])
def test_number_grounding(spark, text, ok):
    digest = '{"dso": 72.4, "cash": 1418780, "use": 0.742, "change": -18.9}'
    assert spark.range(1).select(nv.grounded(F.lit(text), nv.known_values(F.lit(digest))).alias("g")).first().g is ok


def test_phrases(spark):
    cases = [("n_tx_w3_vs_w12", 1.25, "Actividad transaccional 3 m frente a 12 m: 1.25 x"), ("has_invoices", 1.0, "Facturación sincronizada desde ERP: sí"),
             ("credit_util_T", 0.5, "Utilización de líneas de crédito: 50%"), ("hhi_in", None, "Concentración de cobros por cliente (HHI): sin dato"),
             ("reconciled_delta_w3_w12", -0.12, "Cambio en la tasa de conciliación (3 m vs 12 m): -12 pp"),
             ("debt_granted_total", math.log1p(1234567), "Financiación concedida total: 1,234,567 €")]
    df = spark.createDataFrame([(f, v) for f, v, _ in cases], "feature string, value double")
    assert {r.feature: r.text for r in wording.with_text(df).collect()} == {f: t for f, _, t in cases}


def test_block_sizes():
    assert {b: sum(pn.FEATURE_BLOCK[f] == b for f in pn.FEATURES) for b in "ABCDEF"} == dict(A=30, B=37, C=42, D=12, E=10, F=23)


def test_no_local_scratch_on_a_cluster(tmp_path, monkeypatch):
    """Without a shared folder a cluster session gets an error and no folder is made."""
    import tempfile
    from types import SimpleNamespace

    from cashlens.sources.staging import scratch
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch(spark)
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("last", [16, 12, 9])
def test_fold_bounds(last):
    """Training ends an embargo before evaluation; folds don't overlap and end before the holdout."""
    from cashlens.config import PanelConfig
    from cashlens.operators.model import temporal_folds
    cfg = PanelConfig()
    folds = temporal_folds(cfg, last)
    months = [m for f in folds for m in f["eval"]]
    assert folds[-1]["name"] == "holdout" and months == sorted(set(months)) and months[-1] == last
    assert all(f["eval"][0] - f["train_max"] == cfg.embargo for f in folds) and all(f["train_max"] >= 3 for f in folds[:-1])


def test_monitor_keeps_late_movements(spark, tmp_path):
    from cashlens.streaming import monitor
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "user_id bigint, at string, value double"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src).selectExpr("user_id", "cast(at as timestamp) as ts", "value")
        monitor.run(stream, "user_id", "ts", "value", out, ckpt)
        return {(r.user_id, r["T"]): (r.n, r.total, r.active_days)
                for r in monitor.monthly(monitor.daily(spark, out, "user_id"), "user_id").collect()}

    assert arrive([(1, "2024-01-05 10:00:00", 2.0), (1, "2024-06-01 10:00:00", 1.0)]) == {(1, "2024-01"): (1, 2.0, 1), (1, "2024-06"): (1, 1.0, 1)}
    # more than 40 days before what has been seen: one on a known day, one on a new one, and one for a new key
    late = [(1, "2024-01-05 12:00:00", 4.0), (1, "2024-01-09 12:00:00", 8.0), (2, "2023-12-31 12:00:00", 1.0), (1, "2024-06-01 11:00:00", 5.0)]
    assert arrive(late) == {(1, "2024-01"): (3, 14.0, 2), (1, "2024-06"): (2, 6.0, 1), (2, "2023-12"): (1, 1.0, 1)}
    assert arrive([(1, "2024-06-02 11:00:00", 1.0)])[(1, "2024-06")] == (3, 7.0, 2)


def test_monitor_derives_alerts_of_touched_keys_only(spark, tmp_path):
    """Each run re-derives the keys of its batch, over all their months; the others keep their rows; folders stay few."""
    from cashlens.streaming import monitor
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema, seen = "user_id bigint, at string, value double", []

    def derive(months):
        seen.append({r.user_id for r in months.select("user_id").distinct().collect()})
        return monitor.activity_alerts(months, "user_id", CFG)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src).selectExpr("user_id", "cast(at as timestamp) as ts", "value")
        monitor.run(stream, "user_id", "ts", "value", out, ckpt, derive, fan_out=2)
        return {(r.user_id, r["T"]): (r.n, r.epoch) for r in monitor.current_alerts(spark, out, "user_id").collect()}

    arrive([(k, f"2024-0{m}-05 10:00:00", 1.0) for k in (1, 2) for m in (1, 2, 3)])
    got = arrive([(2, "2024-02-07 10:00:00", 1.0), (3, "2024-05-01 10:00:00", 1.0)])
    assert seen == [{1, 2}, {2, 3}]
    assert got == {(1, "2024-01"): (1, 0), (1, "2024-02"): (1, 0), (1, "2024-03"): (1, 0), (2, "2024-01"): (1, 1), (2, "2024-02"): (2, 1),
                   (2, "2024-03"): (1, 1), (3, "2024-05"): (1, 1)}
    for i in range(2, 9):
        got = arrive([(3, f"2024-05-0{i} 10:00:00", 2.0)])
    assert got[(3, "2024-05")] == (8, 8) and got[(1, "2024-01")] == (1, 0) and got[(2, "2024-02")] == (2, 1)
    assert {r.day.day: r.n for r in monitor.daily(spark, out, "user_id").where("user_id = 3").collect()} == {i: 1 for i in range(1, 9)}
    for log in (monitor.partials(spark, out, "user_id", 2), monitor.alert_log(spark, out, "user_id", 2)):
        assert len(log.live()) <= 3 and len(log.folders()) <= 8            # nine batches


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    from cashlens.sources import sinks
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("one_b", "two_b"):
            sinks.save_bucketed(spark.range(500).select(F.col("id").alias("company_id"), F.rand(1).alias(name)), name, str(tmp_path / name), 4)
        j = spark.table("one_b").join(spark.table("two_b"), "company_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and j.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        for name in ("one_b", "two_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_monthly_table_replaces_only_its_months(spark, tmp_path):
    from cashlens.sources import sinks
    path = str(tmp_path / "m")
    sinks.write_monthly(spark.createDataFrame([(1, "2024-01", 1), (1, "2024-02", 1)], "company_id long, T string, n int"), path)
    sinks.write_monthly(spark.createDataFrame([(1, "2024-02", 5), (2, "2024-02", 6)], "company_id long, T string, n int"), path)
    got = {(r.company_id, str(r["T"]), r.n) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "2024-01", 1), (1, "2024-02", 5), (2, "2024-02", 6)}


def test_integrity_counts_by_hand(spark):
    """Orphans, missing keys and uncovered companies, each table once."""
    from cashlens.operators import quality
    from cashlens.sources.treasury import Treasury
    make = spark.createDataFrame
    t = Treasury(spark, CFG, {
        "groups": make([("g",)], "group_id string"), "companies": make([(1, "g"), (2, "lost"), (3, None)], "company_id long, group_id string"),
        "banking_products": make([(10, 1), (11, 9)], "product_id long, company_id long"), "debt_products": make([(12, None)], "product_id long, company_id long"),
        "balances": make([(10, 1), (99, 1), (None, 8)], "product_id long, company_id long"),
        "transactions": make([(10, 1), (10, 1), (98, 1), (98, 1), (None, 1), (10, None), (12, 7)], "product_id long, company_id long"),
        "invoices": make([(2,), (2,), (6,), (None,)], "company_id long")})
    assert {r.check: r.n for r in quality.integrity(t).collect()} == {
        "companies.group_id_orphans": 2, "banking_products.company_orphans": 1, "debt_products.company_orphans": 1, "balances.company_orphans": 1,
        "transactions.company_orphans": 2, "invoices.company_orphans": 2, "balances.product_orphans": 1, "transactions.product_orphans": 2,
        "companies.without_transactions": 2, "companies.without_invoices": 2}


def test_size_cohorts_of_ties_repeats_and_missing_sizes(spark):
    """Quartiles by the rank of (size, company, month), as a plain sort gives them; a repeated company-month meets every rank it has."""
    from cashlens.operators.panel import size_cohort
    rows = [(c, m, None if c % 9 == 0 else float((c * 7 + m) % 5)) for c in range(1, 41) for m in range(3)]
    rows += [(5, 1, 0.0), (5, 1, 4.0), (None, 0, 2.0)]
    df = spark.createDataFrame(rows, "company_id long, t_idx int, size_outflow_12m double")
    got = size_cohort(df)
    key = lambda r: ((r[2] is not None, r[2] or 0.0), (r[0] is not None, r[0] or 0), r[1])
    ranked = [(r, 1 + i) for i, r in enumerate(sorted(rows, key=key))]
    edge = lambda q: 1 + (len(rows) - 1) * q                                                 # noqa: E731
    name = lambda i: "q1" if i <= edge(.25) else "q2" if i <= edge(.5) else "q3" if i <= edge(.75) else "q4"
    want = [(*a, name(i)) for a in rows for b, i in ranked if a[0] is not None and a[:2] == b[:2]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_exploded_months_are_not_shuffled(spark):
    """Look-back rows are dealt by company before they are exploded: no exchange lies above the explosion."""
    from cashlens.operators import company_month as cm
    from cashlens.sources import schemas
    from cashlens.sources.treasury import Treasury

    def one(name):
        schema = spark.createDataFrame([], schemas.ddl(name)).schema
        return spark.createDataFrame([(None,) * len(schema)], schema)
    t = Treasury(spark, PanelConfig(), {n: one(n) for n in ("transactions", "invoices")})
    for df in (cm.cm_concentration(t), cm.cm_invoice_lag(t)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0].split("Initial Plan")[-1]
        assert "Exchange" not in plan


def test_monthly_tables_are_written_side_by_side(spark, monkeypatch):
    import threading
    from cashlens.operators import company_month as cm
    from cashlens.sources.treasury import Treasury
    met = threading.Barrier(2, timeout=60)

    def maker(column):
        def make(t):
            met.wait()                                   # alone, a table would wait in vain
            return spark.createDataFrame([(1, 0, 5.0)], f"company_id bigint, t_idx int, {column} double")
        return make
    monkeypatch.setattr(cm, "cm_tx", maker("n_tx"))
    monkeypatch.setattr(cm, "cm_cash", maker("cash_balance"))
    t = Treasury(spark, PanelConfig(), {"companies": spark.createDataFrame([(1, None)], "company_id bigint, group_id string")})
    got = pn.dense(t, ["n_tx", "cash_balance"]).where("t_idx = 0").select("n_tx", "cash_balance").collect()
    assert [tuple(r) for r in got] == [(5.0, 5.0)]


def test_a_layer_is_built_once_by_threads(spark):
    import time
    from types import SimpleNamespace
    from cashlens.sources.staging import staged, together
    t, built = SimpleNamespace(), []

    def build():
        built.append(1)
        time.sleep(0.5)
        return spark.range(3)
    assert [d.count() for d in together(spark, [lambda: staged(t, "x", build)] * 4)] == [3] * 4 and len(built) == 1


def test_lines_meet_their_orders_once(spark, tmp_path):
    import datetime as dt
    from cashlens.sources.treasury import StarTreasury
    day = dt.datetime(1995, 3, 1)
    lines = [(1, 1), (2, 2), (None, 3), (9, 4)]          # order 1 comes twice, 9 never
    spark.createDataFrame([(o, n, 7, 4, day, 10.0, 100.0, "A", "F") for o, n in lines],
                          "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate timestamp, l_quantity double, "
                          "l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 41, "F", "1-URGENT"), (1, 42, "P", "1-URGENT"), (2, 43, "O", "4-NOT SPECIFIED"), (None, 44, "F", "1-URGENT")],
                          "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    t = StarTreasury(spark, str(tmp_path))
    tx, inv = t.table("transactions", "counterparty_id", "accounting_status"), t.table("invoices", "counterparty_id", "status")
    assert sorted(map(str, map(tuple, tx.collect()))) == sorted(map(str, [
        ("1", "RECONCILIATION_COMPLETED"), ("2", "DISCARDED"), (None, None), (None, None), (None, None)]))
    assert inv.count() == 0                              # company 4 has no invoices
    for df in (tx, inv):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
