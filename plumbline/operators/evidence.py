"""Per-prediction evidence: additive attributions, top drivers, analog payloads, full explanations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import contract as C
from plumbline.functions.scalars import prediction_id, run_id
from plumbline.functions.trees import attributions, base_value, leaves_of
from plumbline.operators.model import RiskModel
from plumbline.operators.neighbours import analogs, scaled_vector, scaler_stats
from plumbline.session import scratch_dir, written

TOP_DRIVERS = 5


def tree_nodes(spark: SparkSession, trees, path: str) -> dict[int, dict]:
    """Nodes of a saved tree ensemble: bounded by trees times nodes per tree, never by data."""
    trees.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    found: dict[int, dict] = {}
    for tree, members in groupby(rows, key=lambda r: r["treeID"]):
        found[tree] = {}
        for row in members:
            split = row["split"]
            nominal = split["numCategories"] >= 0
            values = list(split["leftCategoriesOrThreshold"])
            found[tree][row["id"]] = {
                "left": row["leftChild"],
                "right": row["rightChild"],
                "feature": split["featureIndex"],
                "threshold": values[0] if values and not nominal else 0.0,
                "categories": tuple(values) if nominal else None,
                "cover": float(row["rawCount"]),
                "prediction": row["prediction"],
            }
    return found


def tree_attributions(model: RiskModel, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Contribution of every original feature to the log-odds, per prediction.

    Columns: keys, ``base_value``, ``raw_margin``, ``contributions`` (array of feature, shap_value; the
    one-hot positions are summed back to their category) and ``additive`` (base + sum = margin).
    The log-odds of a boosted classifier are twice its summed tree output.
    """
    nodes = tree_nodes(
        scored.sparkSession, model.trees, f"{scratch_dir(scored.sparkSession)}/trees-{model.trees.uid}"
    )
    leaves = []
    for tree, weight in enumerate(model.trees.treeWeights):
        leaves.extend(leaves_of(nodes[tree], 2.0 * weight))
    shared = scored.sparkSession.sparkContext.broadcast(leaves)
    base = base_value(leaves)
    position = model.feature_names()
    names = list(dict.fromkeys(position))
    gather = np.array([[float(p == n) for n in names] for p in position])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            values = attributions(np.stack(batch["_x"].to_numpy()), shared.value) @ gather
            yield batch[kept].assign(_values=list(values))

    margin = F.ln(F.col("raw_probability") / (F.lit(1.0) - F.col("raw_probability")))
    rows = scored.select(*keys, vector_to_array("features").alias("_x"), margin.alias("raw_margin"))
    kept = [*keys, "raw_margin"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    values = rows.mapInPandas(explain, f"{kinds}, _values array<double>")
    labels = F.array(*[F.lit(n) for n in names])
    contributions = F.zip_with(labels, "_values", lambda n, v: F.struct(n.alias("feature_name"), v.alias("shap_value")))
    summed = F.lit(base) + F.aggregate("_values", F.lit(0.0), lambda a, v: a + v)
    return values.select(
        *keys,
        F.lit(base).alias("base_value"),
        "raw_margin",
        contributions.alias("contributions"),
        (F.abs(summed - F.col("raw_margin")) <= 1e-5 + 1e-5 * F.abs("raw_margin")).alias("additive"),
    )


def _lookup(catalog: dict, position: int) -> Column:
    return F.create_map(*[F.lit(x) for name, entry in catalog.items() for x in (name, entry[position])])


def describe_drivers(contributions: str, values: Column, catalog: dict | None = None) -> Column:
    """Driver array: each contribution with display name, unit, feature value, direction and sentence."""
    catalog = catalog or C.FEATURE_CATALOG
    names, units = _lookup(catalog, 0), _lookup(catalog, 1)

    def one(entry: Column) -> Column:
        direction = F.when(entry["shap_value"] >= 0, "increased").otherwise("decreased")
        return F.struct(
            entry["feature_name"].alias("feature_name"),
            F.element_at(names, entry["feature_name"]).alias("display_name"),
            F.element_at(values, entry["feature_name"]).alias("value"),
            F.element_at(units, entry["feature_name"]).alias("unit"),
            entry["shap_value"].alias("shap_value"),
            direction.alias("direction"),
            F.concat(F.lit("Model risk "), direction, F.lit(" by this feature.")).alias("interpretation"),
        )

    return F.transform(contributions, one)


def top_drivers(drivers: str, positive: bool, k: int = TOP_DRIVERS) -> Column:
    """The k strongest drivers of one sign, by size then name, inside the row: no shuffle."""
    wanted = F.filter(drivers, (lambda d: d["shap_value"] > 0) if positive else (lambda d: d["shap_value"] < 0))
    size = lambda d: F.abs(d["shap_value"])

    def compare(a: Column, b: Column) -> Column:
        return (
            F.when(size(a) > size(b), -1)
            .when(size(a) < size(b), 1)
            .when(a["feature_name"] < b["feature_name"], -1)
            .when(a["feature_name"] > b["feature_name"], 1)
            .otherwise(0)
        )

    return F.slice(F.array_sort(wanted, compare), 1, k)


def feature_values(features: list[str]) -> Column:
    """Map of feature name to its value as text."""
    return F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("string"))])


def value_map(columns: list[str]) -> Column:
    """Map of column name to value."""
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))]).cast("map<string,double>")


def analog_scaler(train: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Scaler of the analog space, fitted on training rows only, with the number of rows behind it."""
    features = features or C.NUMERIC_FEATURES
    return scaler_stats(train, features).withColumn("fit_rows", F.lit(train.count()).cast("bigint"))


def analog_payloads(
    queries: DataFrame,
    train: DataFrame,
    stats: DataFrame,
    features: list[str] | None = None,
    k: int = C.ANALOG_COUNT,
    summary: list[str] | None = None,
) -> DataFrame:
    """Ordered analog list per prediction key, with feature and error summaries as maps.

    ``queries`` and ``train`` are labelled rows with the canonical columns.
    """
    features = features or C.NUMERIC_FEATURES
    vector = scaled_vector(stats, features)
    key = F.concat_ws("|", "region_id", F.col("lead_day").cast("string"), F.col("forecast_initialization_time").cast("string"))
    asked = queries.select(
        key.alias("qid"), "region_id", "lead_day", F.col("forecast_initialization_time").alias("q_init"),
        F.col("lead_day").alias("q_lead"), vector,
    )
    pool = train.select(
        key.alias("cid"), "region_id", "lead_day", F.col("forecast_initialization_time").alias("c_init"),
        F.col("lead_day").alias("c_lead"), vector,
    )
    found = analogs(asked, pool, k)
    event = F.struct(
        F.col("rank"),
        F.col("forecast_initialization_time").alias("initialization_time"),
        "valid_time",
        "region_id",
        "region_name",
        "lead_day",
        "distance",
        "bust",
        "severity",
        value_map(summary or C.ANALOG_FEATURES).alias("forecast_feature_summary"),
        value_map([c for c in C.ERROR_COLUMNS if c in train.columns]).alias("retrospective_error_summary"),
        "dataset_version",
    )
    detailed = found.select("qid", "cid", "rank", "distance").join(train.withColumn("cid", key), "cid").select("qid", event.alias("event"))
    # At most k events per prediction.
    by_rank = F.array_sort(F.collect_list("event"), lambda a, b: a["rank"] - b["rank"])
    listed = detailed.groupBy("qid").agg(by_rank.alias("historical_analogs"))
    return queries.select("region_id", "lead_day", "forecast_initialization_time", key.alias("qid")).join(listed, "qid").drop("qid")


def explanations(
    model: RiskModel,
    rows: DataFrame,
    train: DataFrame,
    provenance: dict[str, str],
    model_version: str,
    features: list[str] | None = None,
    catalog: dict | None = None,
    summary: list[str] | None = None,
) -> DataFrame:
    """One nested record per prediction row: probabilities, drivers, feature values and analogs."""
    keys = ["region_id", "lead_day", "forecast_initialization_time"]
    features = features or C.NUMERIC_FEATURES
    scored = written(model.score(rows), "scored-rows")
    shap = tree_attributions(model, scored, keys)
    history = analog_payloads(rows, train, written(analog_scaler(train, features), "analog-scaler"), features, summary=summary)
    joined = scored.drop("features").join(shap, keys).join(history, keys, "left")
    described = joined.withColumn(
        "_drivers", describe_drivers("contributions", feature_values([model.category, *features]), catalog)
    )
    time, region, lead = F.col("forecast_initialization_time"), F.col("region_id"), F.col("lead_day")
    facts = F.transform("_drivers", lambda d: d.dropFields("shap_value", "direction", "interpretation"))
    return described.select(
        prediction_id(F.lit(model_version), time, region, lead).alias("prediction_id"),
        run_id(time).alias("run_id"),
        "region_id",
        "region_name",
        "lead_day",
        time.alias("source_forecast_time"),
        "valid_time",
        F.col("raw_probability").alias("raw_model_output"),
        "bust_probability",
        (F.lit(1.0) - F.col("bust_probability")).alias("forecast_reliability"),
        F.lit(model_version).alias("model_version"),
        "dataset_version",
        "base_value",
        "additive",
        top_drivers("_drivers", True).alias("top_positive_drivers"),
        top_drivers("_drivers", False).alias("top_negative_drivers"),
        facts.alias("feature_values"),
        "historical_analogs",
        F.create_map(*[F.lit(x) for pair in provenance.items() for x in pair]).alias("provenance"),
    )
