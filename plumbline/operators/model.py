"""Boosted-tree risk model on Spark ML: features, search by year, calibration, baselines, predictions."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import contract as C
from plumbline.errors import ContractViolation
from plumbline.functions.scalars import clip, logit
from plumbline.operators.metrics import calibration_bins, climatology, evaluate, evaluate_scores, score_table
from plumbline.operators.neighbours import scaler_stats
from plumbline.session import scratch_dir, written


def check_features(columns: list[str], features: list[str], label: str = "bust") -> None:
    """Refuse a table missing model columns, or a feature list holding targets or verification values."""
    missing = sorted(set([*features, label]) - set(columns))
    if missing:
        raise ContractViolation(f"model table lacks {missing}")
    leaked = [f for f in features if f in C.TARGET_COLUMNS or f.startswith(tuple(C.TARGET_PREFIXES))]
    if leaked:
        raise ContractViolation(f"targets among the features: {leaked}")


def feature_stages(train: DataFrame, numeric: list[str], category: str = "region_id") -> list:
    """One-hot category (an unknown one is an error) and numerics scaled with population statistics."""
    fitted = {row["feature"]: row for row in scaler_stats(train, numeric).collect()}
    scaled = ", ".join(f"(`{f}` - {fitted[f]['mean']!r}D) / {fitted[f]['scale']!r}D AS `{f}__z`" for f in numeric)
    return [
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        StringIndexer(inputCol=category, outputCol="_category", handleInvalid="error", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["_category"], outputCols=["_onehot"], dropLast=False),
        VectorAssembler(inputCols=["_onehot", *[f"{f}__z" for f in numeric]], outputCol="features"),
    ]


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def _ready_for_checkpoints(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(df.sparkSession))


@dataclass
class RiskModel:
    """Fitted parts; all are Spark ML models that can be saved and loaded."""

    features: PipelineModel
    trees: object
    calibrator: object
    baseline: object
    search: list[dict]
    numeric: list[str]
    category: str = "region_id"

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with raw, calibrated and baseline probabilities and the assembled ``features``."""
        prepared = self.features.transform(rows)
        raw = self.trees.setPredictionCol("_p1").setProbabilityCol("_q1").setRawPredictionCol("_r1").transform(prepared)
        floor = C.PROBABILITY_FLOOR
        raw = raw.withColumn("raw_probability", clip(positive_probability("_q1"), floor, 1 - floor))
        raw = _with_logit(raw)
        calibrated = self.calibrator.setPredictionCol("_p2").setProbabilityCol("_q2").setRawPredictionCol("_r2").transform(raw)
        both = self.baseline.setPredictionCol("_p3").setProbabilityCol("_q3").setRawPredictionCol("_r3").transform(calibrated)
        return both.select(
            *rows.columns,
            "features",
            "raw_probability",
            positive_probability("_q2").alias("bust_probability"),
            positive_probability("_q3").alias("logistic_baseline_probability"),
        )

    def feature_names(self) -> list[str]:
        """Original feature behind each position of ``features``."""
        categories = next(s for s in self.features.stages if hasattr(s, "labels")).labels
        return [self.category] * len(categories) + self.numeric

    def contract(self) -> dict:
        """What a saved model must be used with: features in order, categories in order, and how it was chosen."""
        facts = {
            "numeric": self.numeric,
            "category": self.category,
            "categories": list(next(s for s in self.features.stages if hasattr(s, "labels")).labels),
            "trees": self.trees.getNumTrees,
            "search": self.search,
        }
        return facts | {"content_sha256": hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()}

    def save(self, path: str) -> None:
        for name in _PARTS:
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        spark = SparkSession.active()
        contract = spark.createDataFrame([(json.dumps(self.contract(), sort_keys=True),)], "contract string")
        contract.coalesce(1).write.mode("overwrite").text(f"{path}/contract")

    @classmethod
    def load(cls, spark: SparkSession, path: str, numeric: list[str] | None = None) -> RiskModel:
        """A saved model; an altered contract, parts that do not fit it, and other features than ``numeric`` are errors."""
        stored = json.loads(spark.read.text(f"{path}/contract").first()[0])
        features = PipelineModel.load(f"{path}/features")
        trees = GBTClassificationModel.load(f"{path}/trees")
        calibrator, baseline = (LogisticRegressionModel.load(f"{path}/{name}") for name in ("calibrator", "baseline"))
        found = cls(features, trees, calibrator, baseline, stored["search"], stored["numeric"], stored["category"])
        problems = []
        if found.contract() != stored:
            problems.append("its parts or its record have changed")
        if numeric is not None and list(numeric) != found.numeric:
            problems.append("other features are expected")
        leaked = [f for f in found.numeric if f in C.TARGET_COLUMNS or f.startswith(tuple(C.TARGET_PREFIXES))]
        if leaked:
            problems.append(f"targets among the features: {leaked}")
        if problems:
            raise ContractViolation(f"saved model: {'; '.join(problems)}")
        return found


_PARTS = ("features", "trees", "calibrator", "baseline")


def _with_logit(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_logit", logit(F.col("raw_probability")))
    return VectorAssembler(inputCols=["_logit"], outputCol="_logit_vector").transform(rows)


def fit_risk_model(
    train: DataFrame,
    validation: DataFrame,
    numeric: list[str] | None = None,
    category: str = "region_id",
    label: str = "bust",
    candidates: list[dict] | None = None,
    seed: int = C.RANDOM_STATE,
) -> RiskModel:
    """Fit all parts; the candidate with the best validation average precision wins, the first on ties."""
    numeric = numeric or C.NUMERIC_FEATURES
    check_features(train.columns, [category, *numeric], label)
    _ready_for_checkpoints(train)
    target = F.col(label).cast("double").alias("_label")
    features = Pipeline(stages=feature_stages(train, numeric, category)).fit(train)
    # Assembled once: every candidate fit reads this table instead of repeating the feature work.
    fit_rows = written(features.transform(train).select("features", target), "train-features")
    held = written(features.transform(validation).select("features", target), "validation-features")
    search, best = [], None
    for settings in candidates or C.TREE_CANDIDATES:
        share = str(settings["subsamplingRate"])
        trees = GBTClassifier(
            labelCol="_label", featureSubsetStrategy=share, seed=seed, maxMemoryInMB=512, checkpointInterval=10, **settings
        ).fit(fit_rows)
        scored = trees.transform(held).select(F.col("_label").alias("bust"), positive_probability().alias("p"), F.lit(0.0).alias("c"))
        precision = evaluate(scored).select("pr_auc").first()[0]
        search.append({"parameters": settings, "validation_pr_auc": precision})
        if best is None or (precision or 0.0) > best[0]:
            best = (precision or 0.0, trees)
    trees = best[1]
    scored = _with_logit(
        trees.transform(held).withColumn(
            "raw_probability", clip(positive_probability(), C.PROBABILITY_FLOOR, 1 - C.PROBABILITY_FLOOR)
        )
    )
    penalty = lambda rows: 1.0 / rows.count()
    options = {"labelCol": "_label", "elasticNetParam": 0.0, "standardization": False}
    calibrator = LogisticRegression(featuresCol="_logit_vector", regParam=penalty(held), **options).fit(scored.select("_logit_vector", "_label"))
    baseline = LogisticRegression(maxIter=1000, regParam=penalty(fit_rows), **options).fit(fit_rows)
    return RiskModel(features, trees, calibrator, baseline, search, numeric, category)


def held_out_predictions(model: RiskModel, train: DataFrame, held_out: DataFrame, keys: list[str], label: str = "bust") -> DataFrame:
    """Prediction table: keys, label, split, raw, calibrated, climatology and baseline probabilities."""
    scored = climatology(train, model.score(held_out), label)
    return scored.select(
        *keys, label, "split", "raw_probability", "bust_probability", "climatology_probability", "logistic_baseline_probability"
    )


def evaluation_report(predictions: DataFrame, slices: list[str] | None = None, label: str = "bust") -> DataFrame:
    """Metrics of the model and both baselines per split (and slice)."""
    reports = []
    for name, column in (
        ("model", "bust_probability"),
        ("climatology_baseline", "climatology_probability"),
        ("logistic_regression_baseline", "logistic_baseline_probability"),
    ):
        rows = evaluate(predictions, ["split", *(slices or [])], label, column, "climatology_probability")
        reports.append(rows.withColumn("source", F.lit(name)))
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


def full_report(predictions: DataFrame, label: str = "bust", slices: tuple[str, ...] = ("lead_day", "region_id")) -> DataFrame:
    """Metrics and calibration bins per split: model and baselines overall, the model by every slice too.

    Columns ``split``, ``source``, ``slice`` (overall or a column), ``value``, the metrics, ``bins``. All sets are rows of one score table,
    so the predictions are read once and every metric is computed once for all of them.
    """
    sources = {
        "model": "bust_probability",
        "climatology_baseline": "climatology_probability",
        "logistic_regression_baseline": "logistic_baseline_probability",
    }
    whole = F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value"))
    parts = [F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in slices]
    pairs = F.array(*[F.struct(F.lit(name).alias("source"), F.col(column).alias("p")) for name, column in sources.items()])
    long = predictions.select("split", label, *slices, F.col("climatology_probability").alias("c"), F.inline(pairs))
    sets = F.when(F.col("source") == "model", F.array(whole, *parts)).otherwise(F.array(whole))
    keys = ["split", "source", "slice", "value"]
    scores = score_table(long.select("split", "source", label, "p", "c", F.inline(sets)), keys, label)
    entries = F.struct("bin", "lower", "upper", "count", "mean_probability", "observed_frequency")
    bins = calibration_bins(scores, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(entries)).alias("bins"))  # ten entries
    return evaluate_scores(scores, keys).join(bins, keys)


def replay_differences(stored: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float = C.REPLAY_TOLERANCE) -> DataFrame:
    """Violations: stored probabilities that the saved model does not reproduce."""
    names = ["raw_probability", "bust_probability"]
    again = recomputed.select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    joined = stored.join(again, keys, "left")
    agrees = [F.coalesce(F.abs(F.col(n) - F.col(f"_{n}")) <= tolerance, F.lit(False)) for n in names]
    return joined.filter(~(agrees[0] & agrees[1]))
