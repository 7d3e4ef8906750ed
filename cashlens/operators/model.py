"""Risk models on Spark ML: preparation, temporal folds, fits, calibration, storage, tree contributions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable, Iterator, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, ImputerModel, OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cashlens.config import PanelConfig
from cashlens.functions.exprs import logit
from cashlens.operators.panel import FEATURES
from cashlens.sources.staging import together

CATEGORIES = ("country", "currency", "erp_any", "main_bank", "size_cohort")
MISSING = -9999.0            # trees split it off from every real value
OTHER = "__other__"
T_ = TypeVar("T_")


@dataclass(frozen=True)
class ModelConfig:
    regularisation: float = 0.05     # inverse strength, as in a C parameter
    min_frequency: int = 25
    iterations: int = 100
    step: float = 0.1
    depth: int = 5
    subsample: float = 0.8
    seed: int = 42
    ensemble_gain: float = 0.005


# ------------------------------------------------------------------------------- temporal folds
def temporal_folds(cfg: PanelConfig, last_labelled: int) -> list[dict]:
    """Expanding folds, oldest first, the final months as holdout last.

    Fold k from the end evaluates the two months that end 2k months before the holdout; its training months end an
    embargo earlier, when their outcomes were known, and must be four at least."""
    first = last_labelled - cfg.holdout_months + 1
    starts = [first - 2 * k for k in range(cfg.cv_folds, 0, -1)]
    usable = [m for m in starts if m - cfg.embargo >= 3]
    cv = [{"name": f"fold{i}", "eval": [m, m + 1], "train_max": m - cfg.embargo} for i, m in enumerate(usable, 1)]
    return [*cv, {"name": "holdout", "eval": list(range(first, last_labelled + 1)), "train_max": first - cfg.embargo}]


def split(df: DataFrame, fold: dict) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("t_idx") <= fold["train_max"]), df.where(F.col("t_idx").isin(*fold["eval"]))


# ---------------------------------------------------------------------------------- preparation
def seen_categories(train: DataFrame, c: str, min_frequency: int = 1) -> DataFrame:
    return train.groupBy(c).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") >= min_frequency).select(
        c, F.lit(True).alias("__seen"))


def encode(df: DataFrame, train: DataFrame, c: str, min_frequency: int = 1) -> DataFrame:
    """Categories not (often enough) seen in training become one bucket."""
    seen = seen_categories(train, c, min_frequency)
    return (df.join(seen, c, "left").withColumn(c, F.when(F.col("__seen"), F.col(c)).otherwise(OTHER)).drop("__seen"))


def category_levels(train: DataFrame, cats: list[str], min_frequency: int) -> dict[str, list[str]]:
    """The categories that at least ``min_frequency`` training rows have, most frequent first: what a fit freezes.

    One aggregate for all columns; the model keeps these names, so their number must suit the driver (a category of
    at least ``min_frequency`` rows each)."""
    rows = (train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cats]))).where("v is not null")
            .groupBy("c", "v").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_frequency).collect()) if cats else []
    return {c: [r.v for r in sorted((r for r in rows if r.c == c), key=lambda r: (-r.k, r.v))] or [OTHER] for c in cats}


def class_weight(train: DataFrame) -> tuple[float, float, int]:
    """Balanced weights (negative, positive) and row count: one aggregated row."""
    n, p = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    return n / (2.0 * max(n - p, 1)), n / (2.0 * max(p, 1)), n


def weighted(train: DataFrame) -> tuple[DataFrame, int]:
    w0, w1, n = class_weight(train)
    return train.withColumn("w", F.when(F.col("y") == 1, w1).otherwise(w0)).withColumn("label", F.col("y").cast("double")), n


def filled_columns(train: DataFrame, numeric: list[str]) -> list[str]:
    """Numeric features with at least one value in training (one aggregated row)."""
    row = train.agg(*[F.count(c).alias(c) for c in numeric]).first()
    return [c for c in numeric if row[c]]


# ----------------------------------------------------------------------------------------- fits
Fit = Callable[[DataFrame, list, ModelConfig], PipelineModel]


def _parts(features):
    return [f for f in features if f not in CATEGORIES], [f for f in features if f in CATEGORIES]


def _indexers(levels: dict[str, list[str]]):
    """Frozen categories of each column; rare, unseen and missing ones share the index after the last, in fit and transform."""
    return [StringIndexerModel.from_labels(known, c, f"{c}__i", handleInvalid="keep") for c, known in levels.items()]


@dataclass(frozen=True)
class Prepared:
    """Training rows with medians in place, and what the logistic fits on subsets of the features have in common."""

    frame: DataFrame
    imputer: ImputerModel
    numeric: list[str]
    levels: dict[str, list[str]]
    n: int


def prepare_logistic(train: DataFrame, features: list[str], mc: ModelConfig) -> Prepared:
    """Medians, frozen categories and class weights: each belongs to one column or to the rows, whatever the subset of ``features``."""
    num, cats = _parts(features)
    num = filled_columns(train, num)
    levels = category_levels(train, cats, mc.min_frequency)
    train, n = weighted(train)
    imputer = Imputer(inputCols=num, outputCols=[f"{c}__m" for c in num], strategy="median").fit(train)
    return Prepared(imputer.transform(train), imputer, num, levels, n)


def logistic_columns(prepared: Prepared) -> list[str]:
    """What the logistic fits read of a prepared frame, besides label and weight."""
    return [*[f"{c}__m" for c in prepared.numeric], *prepared.levels]


def relabelled(prepared: Prepared, y: str) -> Prepared:
    """The same rows, medians and categories with the column ``y`` as label, and its class weights."""
    frame, n = weighted(prepared.frame.withColumn("y", F.col(y)))
    return replace(prepared, frame=frame, n=n)


def fit_logistic(train: DataFrame, features: list[str], mc: ModelConfig, prepared: Prepared | None = None) -> PipelineModel:
    """Median imputation, standardised numbers, one-hot frozen categories, balanced ridge logistic.

    ``prepared``: ``prepare_logistic`` of the same rows and more features; the model then reads all of their columns."""
    prepared = prepared or prepare_logistic(train, features, mc)
    num, cats = _parts(features)
    num, levels, n = [c for c in num if c in prepared.numeric], {c: prepared.levels[c] for c in cats}, prepared.n
    stages = [VectorAssembler(inputCols=[f"{c}__m" for c in num], outputCol="__num"),
              StandardScaler(inputCol="__num", outputCol="__std", withMean=True, withStd=True), *_indexers(levels)]
    if cats:
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in cats], outputCols=[f"{c}__h" for c in cats],
                                    handleInvalid="keep", dropLast=False))
    stages += [VectorAssembler(inputCols=["__std", *[f"{c}__h" for c in cats]], outputCol="features"),
               LogisticRegression(weightCol="w", regParam=1.0 / (mc.regularisation * n), standardization=False, maxIter=100)]
    return PipelineModel([prepared.imputer, *Pipeline(stages=stages).fit(prepared.frame).stages])


def for_trees(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing numbers as a value outside every range."""
    num, _ = _parts(features)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in num})


ROWS_A_TASK = 20_000
WAITING = 8                  # fits for each one that the cores could hold by rows: their jobs mostly wait for the driver (four took 1.7 times as long as one)


def sized(train: DataFrame, rows: int, per_part: int = ROWS_A_TASK) -> DataFrame:
    """Partitions by row count: boosting runs several small jobs for each tree, whose cost on few rows is that of their tasks."""
    return train.repartition(-(-rows // per_part) or 1)


def room(spark: SparkSession, rows: int) -> int:
    """How many fits on up to ``rows`` rows each the cores have room for."""
    return max(1, WAITING * spark.sparkContext.defaultParallelism * ROWS_A_TASK // max(rows, 1))


def side_by_side(spark: SparkSession, jobs: list[Callable[[], T_]], rows: int) -> list[T_]:
    """Results of independent fits on up to ``rows`` rows each, in order. A fit of few rows keeps one task busy at a time,
    so as many run at once as the cores have room for; fits of many rows run one after the other."""
    return together(spark, jobs, min(room(spark, rows), len(jobs)))


def _fit_trees(train: DataFrame, features: list[str], mc: ModelConfig, kind, **params) -> PipelineModel:
    num, cats = _parts(features)
    levels = category_levels(train, cats, mc.min_frequency)
    train = sized(*weighted(for_trees(train, features)))
    bins = max([64, *(len(known) + 1 for known in levels.values())])
    classifier = kind(weightCol="w", minInstancesPerNode=20, maxBins=bins, seed=mc.seed, **params)
    return Pipeline(stages=[*_indexers(levels), VectorAssembler(
        inputCols=[*num, *[f"{c}__i" for c in cats]], outputCol="features"), classifier]).fit(train)


def fit_boosted(train: DataFrame, features: list[str], mc: ModelConfig) -> PipelineModel:
    return _fit_trees(train, features, mc, GBTClassifier, maxIter=mc.iterations, stepSize=mc.step, maxDepth=mc.depth,
                      subsamplingRate=mc.subsample, featureSubsetStrategy="0.6")


def fit_forest(train: DataFrame, features: list[str], mc: ModelConfig) -> PipelineModel:
    """A second tree model for contrast and averaging."""
    return _fit_trees(train, features, mc, RandomForestClassifier, numTrees=2 * mc.iterations, maxDepth=mc.depth + 2)


def predict(model: PipelineModel, df: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    trees = not isinstance(model.stages[-1], LogisticRegressionModel)
    num = _parts(features)[0]
    kept = df.withColumns({f"__keep_{c}": F.col(c) for c in num}) if trees else df     # the model reads filled columns
    scored = model.transform(for_trees(kept, features) if trees else kept).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*[F.col(f"__keep_{c}").alias(c) if trees and c in num else c for c in df.columns if c != out], out)


def average(p: str, q: str):
    return (F.col(p) + F.col(q)) / 2


def fit_platt(oof: DataFrame, p: str = "p") -> tuple[float, float]:
    """Slope and intercept of the sigmoid calibration on out-of-fold scores."""
    d = oof.select(F.col("y").cast("double").alias("label"), logit(p).alias("z"))
    m = LogisticRegression(regParam=1e-9, maxIter=100).fit(
        VectorAssembler(inputCols=["z"], outputCol="features").transform(d))
    return float(m.coefficients[0]), float(m.intercept)


# --------------------------------------------------------------------------- tree contributions
def tree_tables(model: PipelineModel) -> list[tuple[float, dict]]:
    """Nodes of every boosted tree as arrays. The size is that of the model, not of the data."""
    out = []
    gbt = model.stages[-1]
    for tree, weight in zip(gbt.trees, gbt.treeWeights):
        feat, thr, left, right, value = [], [], [], [], []

        def visit(node):
            i = len(feat)
            for a, v in ((feat, -1), (thr, 0.0), (left, -1), (right, -1), (value, float(node.prediction()))):
                a.append(v)
            if node.subtreeDepth() > 0:
                s = node.split()
                feat[i] = s.featureIndex()
                thr[i] = (float(s.threshold()) if s.getClass().getSimpleName() == "ContinuousSplit"
                          else frozenset(float(x) for x in s.leftCategories()))
                left[i] = visit(node.leftChild())
                right[i] = visit(node.rightChild())
            return i
        visit(tree._call_java("rootNode"))
        out.append((float(weight), {"feat": feat, "thr": thr, "left": left, "right": right, "value": value}))
    return out


def contribution_names(features: list[str]) -> list[str]:
    """Order of a contribution array: numbers first, then categories."""
    num, cats = _parts(features)
    return [*num, *cats]


def contribution_arrays(model: PipelineModel, df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """Per row one array with each feature's change of the expected margin along the decision paths. Base plus
    contributions is the model's margin. ``keep``: columns that go along."""
    names = contribution_names(features)
    trees = df.sparkSession.sparkContext.broadcast(tree_tables(model))               # the size of the model
    held = df.withColumns({f"__keep_{c}": F.col(c) for c in keep})                   # the model reads filled columns
    prepared = model.transform(for_trees(held, features)).select(
        "company_id", "t_idx", *[F.col(f"__keep_{c}").alias(c) for c in keep], vector_to_array("features").alias("__x"),
        vector_to_array("rawPrediction")[1].alias("margin"))
    schema = T.StructType([f for f in prepared.schema.fields if f.name != "__x"]
                          + T._parse_datatype_string("phi array<double>, base double").fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            phi, base = np.zeros((len(x), len(names))), 0.0
            for weight, t in trees.value:
                at, value = np.zeros(len(x), dtype=int), np.array(t["value"])
                base += weight * value[0]
                moving = np.ones(len(x), dtype=bool)
                while moving.any():
                    for node in np.unique(at[moving]):
                        rows = np.flatnonzero(moving & (at == node))
                        f = t["feat"][node]
                        if f < 0:
                            moving[rows] = False
                            continue
                        th = t["thr"][node]
                        goes = np.isin(x[rows, f], list(th)) if isinstance(th, frozenset) else x[rows, f] <= th
                        nxt = np.where(goes, t["left"][node], t["right"][node])
                        phi[rows, f] += weight * (value[nxt] - value[node])
                        at[rows] = nxt
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names)), pa.array(phi.ravel()))
            kept = [n for n in b.schema.names if n != "__x"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), lists, pa.array(np.full(len(x), base))], names=[*kept, "phi", "base"])
    return prepared.mapInArrow(walk, schema)


def contributions(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """The same with a row for each feature."""
    named = F.array(*[F.lit(n) for n in contribution_names(features)])
    return contribution_arrays(model, df, features).select(
        "company_id", "t_idx", "base", "margin", F.inline(F.arrays_zip(named.alias("feature"), "phi")))


ALL_FEATURES = FEATURES + ["size_cohort"]
