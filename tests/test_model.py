"""Risk model, attributions and explanations."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import contract as C
from plumbline.errors import ContractViolation
from plumbline.functions import trees
from plumbline.operators import evidence, model, narrative
from plumbline.plans import jobs
from plumbline.plans.jobs import Layout
from plumbline.sources import documents, manifests, tables

SETTINGS = [
    {"maxDepth": 2, "stepSize": 0.2, "maxIter": 3, "minInstancesPerNode": 5, "subsamplingRate": 0.8},
    {"maxDepth": 3, "stepSize": 0.2, "maxIter": 4, "minInstancesPerNode": 5, "subsamplingRate": 0.8},
]


def _labelled_frame() -> pd.DataFrame:
    generator = np.random.default_rng(26079)
    rows = []
    for year in range(2018, 2023):
        for i in range(160):
            row = {name: float(generator.normal()) for name in C.FORECAST_FEATURES}
            row["region_id"], row["lead_day"] = f"imd-{i % 4 + 1:02d}", i % 10 + 1
            row["forecast_initialization_time"] = pd.Timestamp(year, 6, 1) + pd.Timedelta(hours=12 * (i // 4))
            row["bust"] = int(generator.normal() + 0.7 * row["precip24_mean_mm"] > 1)
            row["severity"], row["threshold"] = float(row["bust"]), 0.5
            row.update({c: 1.0 for c in C.ERROR_COLUMNS})
            rows.append(row)
    frame = pd.DataFrame(rows)
    frame["valid_time"] = frame.forecast_initialization_time + pd.to_timedelta(frame.lead_day, unit="D")
    frame["feature_source_time"] = frame.forecast_initialization_time
    return frame.assign(region_name="r", dataset_version="v", region_id_semantics="categorical")


@pytest.fixture(scope="module")
def labelled(spark):
    times = ["forecast_initialization_time", "valid_time", "feature_source_time"]
    table = spark.createDataFrame(_labelled_frame())
    typed = table.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})
    return typed.withColumns({"bust": F.col("bust").cast("byte"), "lead_day": F.col("lead_day").cast("int")}).cache()


@pytest.fixture(scope="module")
def fitted(labelled):
    rows = jobs.split_corpus(labelled)
    part = lambda name: rows.filter(F.col("split") == name)
    return model.fit_risk_model(part("train"), part("validation"), candidates=SETTINGS), rows


def test_feature_contract():
    columns = [*C.NUMERIC_FEATURES, "region_id", "bust"]
    model.check_features(columns, ["region_id", *C.NUMERIC_FEATURES])
    with pytest.raises(ContractViolation, match="lacks"):
        model.check_features(columns[1:], ["region_id", *C.NUMERIC_FEATURES])
    for leak in ("severity", "e_wind_mps", "z_extra", "analysis_t"):
        with pytest.raises(ContractViolation, match="targets"):
            model.check_features([*columns, leak], ["region_id", leak])


def test_search_keeps_the_best_candidate(fitted):
    risk, _ = fitted
    scores = [s["validation_pr_auc"] for s in risk.search]
    assert len(scores) == 2 and risk.trees.getMaxDepth() == SETTINGS[int(np.argmax(scores))]["maxDepth"]


def test_predictions_and_report(fitted):
    risk, rows = fitted
    train, held = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    table = model.held_out_predictions(risk, train, held, C.PREDICTION_KEYS).cache()
    assert table.count() == 320
    values = table.toPandas()
    for column in ("raw_probability", "bust_probability", "climatology_probability", "logistic_baseline_probability"):
        assert values[column].between(0, 1).all()
    report = model.evaluation_report(table).collect()
    assert len(report) == 6 and all(0 <= r.brier_score <= 1 for r in report)
    again = model.held_out_predictions(risk, train, held, C.PREDICTION_KEYS)
    assert model.replay_differences(table, again, C.PREDICTION_KEYS).isEmpty()
    off = table.withColumn("bust_probability", F.col("bust_probability") + 1e-6)
    assert model.replay_differences(off, again, C.PREDICTION_KEYS).count() == 320


def test_unknown_category_is_an_error(fitted):
    risk, rows = fitted
    with pytest.raises(Exception, match="(?i)unseen label"):
        risk.score(rows.withColumn("region_id", F.lit("imd-99"))).select("bust_probability").collect()


def _brute_force_shapley(nodes, x, weight):
    """Shapley values from their definition, with path-dependent expectations."""

    def expect(node, known):
        n = nodes[node]
        if n["left"] < 0:
            return n["prediction"]
        sides = (n["left"], n["right"])
        if n["feature"] in known:
            v = x[n["feature"]]
            left = v in n["categories"] if n["categories"] is not None else v <= n["threshold"]
            return expect(sides[0] if left else sides[1], known)
        return sum(nodes[s]["cover"] / n["cover"] * expect(s, known) for s in sides)

    features = range(len(x))
    values = np.zeros(len(x))
    for j in features:
        others = [f for f in features if f != j]
        for size in range(len(x)):
            for chosen in combinations(others, size):
                share = factorial(size) * factorial(len(x) - size - 1) / factorial(len(x))
                values[j] += share * (expect(0, {*chosen, j}) - expect(0, set(chosen)))
    return weight * values, weight * expect(0, set())


def test_attributions_equal_the_definition():
    leaf = lambda c, p: {"left": -1, "right": -1, "feature": -1, "threshold": 0.0, "categories": None, "cover": c, "prediction": p}
    inner = lambda c, f, t, a, b, cats=None: {"left": a, "right": b, "feature": f, "threshold": t, "categories": cats, "cover": c, "prediction": 0.0}
    nodes = {
        0: inner(100.0, 0, 0.5, 1, 2), 1: inner(60.0, 1, 0.0, 3, 4), 2: inner(40.0, 0, 1.5, 5, 6),
        3: leaf(20.0, 1.0), 4: inner(40.0, 2, 0.0, 7, 8, (1.0,)), 5: leaf(10.0, -2.0), 6: leaf(30.0, 3.0), 7: leaf(15.0, 0.5), 8: leaf(25.0, -1.0),
    }
    rows = np.array([[0.2, -1.0, 1.0], [1.0, 2.0, 0.0], [2.0, 0.0, 1.0], [0.4, 1.0, 0.0], [0.4, 1.0, 1.0]])
    leaves = trees.leaves_of(nodes, 0.3)
    found = trees.attributions(rows, leaves)
    for x, values in zip(rows, found):
        expected, base = _brute_force_shapley(nodes, x, 0.3)
        assert np.allclose(values, expected) and trees.base_value(leaves) == pytest.approx(base)


def test_explanations_are_additive_and_complete(fitted):
    risk, rows = fitted
    train, held = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    provenance = {"feature_contract": "f", "secret": "s"}
    table = evidence.explanations(risk, held, train, provenance, "tree-v1").cache()
    assert table.count() == 160 and table.filter("additive").count() == 160
    row = table.first()
    assert row.prediction_id == f"tree-v1__{row.source_forecast_time:%Y%m%dT%H%M%SZ}__{row.region_id}__d{row.lead_day:02d}"
    positive = [d.shap_value for d in row.top_positive_drivers]
    assert len(positive) <= 5 and positive == sorted(positive, reverse=True) and all(v > 0 for v in positive)
    negative = [d.shap_value for d in row.top_negative_drivers]
    assert negative == sorted(negative) and all(v < 0 for v in negative)
    assert len(row.feature_values) == 15 and len(row.historical_analogs) == 3
    analog = row.historical_analogs[0]
    assert analog.region_id == row.region_id and analog.initialization_time.year <= 2020
    assert set(analog.forecast_feature_summary) == set(C.ANALOG_FEATURES)
    context = narrative.narrative_context(table).withColumn("summary", narrative.evidence_summary())
    first = context.withColumn("sources", narrative.grounding_sources(narrative.evidence_presence())).first()
    assert first.provenance == {"feature_contract": "f"}
    assert {f.feature_name for f in first.approved_feature_values} == set(narrative.QUOTABLE_FEATURES)
    assert first.run_to_run_drift.feature_name == "run_to_run_mslp_drift_pa"
    assert "Closest past runs" in first.summary and "historical_analog_summaries" in first.sources
    checked = context.select(narrative.numbers_are_grounded(F.col("summary"), F.col("bust_probability")).alias("ok"))
    assert checked.filter("NOT ok").isEmpty()


def test_label_and_train_jobs(spark, labelled, tmp_path):
    layout = Layout(str(tmp_path))
    stored = labelled.select(*[f.name for f in C.DERIVED_ROW])
    noisy = stored.withColumns({c: F.abs(F.col("mslp_mean_pa") + F.lit(i)) for i, c in enumerate(C.ERROR_COLUMNS)})
    tables.write_cycles(noisy, layout.cycles)
    documents.write_json_report(spark.createDataFrame([("incomplete",)], "status string"), layout.manifest)
    with pytest.raises(ContractViolation, match="incomplete"):
        jobs.training_gate(spark, layout)
    documents.write_json_report(spark.createDataFrame([("complete",)], "status string"), layout.manifest)
    shares = jobs.label_corpus(spark, layout, threshold_min_samples=5).collect()
    assert [r.rows for r in shares] == [160] * 5
    record = spark.read.json(f"{layout.label_fit}/record").first()
    assert record.fit_years == [2018, 2019, 2020] and len(record.content_sha256) == 64
    report = jobs.train_and_evaluate(spark, layout, SETTINGS[:1])
    assert report.count() == 6
    assert spark.read.parquet(layout.predictions).count() == 320
    recorded = spark.read.parquet(f"{layout.manifest}-labelled")
    changed = recorded.withColumn("sha256", F.lit("0"))
    assert manifests.checksum_differences(recorded, changed).count() == recorded.count()
    fitted = model.fit_risk_model(*[jobs.split_corpus(tables.read_labelled(spark, layout.labelled)).filter(f"split = '{s}'") for s in ("train", "validation")], candidates=SETTINGS[:1])
    assert jobs.build_evidence(spark, layout, fitted, "tree-v1", {"a": "b"}).count() == 320


def test_saved_models_load_with_their_contract_only(spark, fitted, tmp_path):
    risk, rows = fitted
    path = f"{tmp_path}/model"
    risk.save(path)
    again = model.RiskModel.load(spark, path, C.NUMERIC_FEATURES)
    held = rows.filter("split = 'test'")
    stored = risk.score(held).select(*C.PREDICTION_KEYS, "raw_probability", "bust_probability")
    assert model.replay_differences(stored, again.score(held), C.PREDICTION_KEYS).isEmpty()
    assert again.contract() == risk.contract() and again.feature_names() == risk.feature_names()
    with pytest.raises(ContractViolation, match="other features"):
        model.RiskModel.load(spark, path, C.NUMERIC_FEATURES[::-1])
    text = spark.read.text(f"{path}/contract").first()[0]
    spark.createDataFrame([(text.replace("season_sin", "season_cos2"),)], "contract string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")
    with pytest.raises(ContractViolation, match="changed"):
        model.RiskModel.load(spark, path)
    risk.save(path)
    other = model.fit_risk_model(*[rows.filter(f"split = '{s}'") for s in ("train", "validation")], candidates=[{**SETTINGS[0], "maxIter": 2}])
    other.trees.write().overwrite().save(f"{path}/trees")
    with pytest.raises(ContractViolation, match="changed"):
        model.RiskModel.load(spark, path)


def test_full_report_holds_every_set_once(fitted):
    risk, rows = fitted
    train, held = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    table = model.held_out_predictions(risk, train, held, C.PREDICTION_KEYS).cache()
    report = model.full_report(table).collect()
    overall = {(r.split, r.source): r for r in report if r.slice == "overall"}
    assert len(overall) == 6 and {r.value for r in overall.values()} == {"all"}
    for old in model.evaluation_report(table).collect():
        new = overall[old.split, old.source]
        for name in ("brier_score", "pr_auc", "roc_auc", "expected_calibration_error", "top_20_percent_risk_recall"):
            assert getattr(new, name) == pytest.approx(getattr(old, name))
        assert [b.bin for b in new.bins] == list(range(10)) and sum(b["count"] for b in new.bins) == new.rows
    leads = {r.value for r in report if r.slice == "lead_day" and r.split == "test_2022" or r.slice == "lead_day"}
    assert leads == {str(r.lead_day) for r in table.select("lead_day").distinct().collect()}
    by_region = [r for r in report if r.slice == "region_id" and r.split == "test"]
    assert sum(r.rows for r in by_region) == overall["test", "model"].rows


def test_evidence_is_built_from_disk_after_a_replay(spark, labelled, tmp_path):
    layout = Layout(str(tmp_path))
    stored = labelled.select(*[f.name for f in C.DERIVED_ROW])
    noisy = stored.withColumns({c: F.abs(F.col("mslp_mean_pa") + F.lit(i)) for i, c in enumerate(C.ERROR_COLUMNS)})
    tables.write_cycles(noisy, layout.cycles)
    documents.write_json_report(spark.createDataFrame([("complete",)], "status string"), layout.manifest)
    jobs.label_corpus(spark, layout, threshold_min_samples=5)
    jobs.train_and_evaluate(spark, layout, SETTINGS[:1])
    record = spark.read.json(f"{layout.report}-record").first()
    assert record.prediction_rows == 320 and record.test_years == [2022] and len(record.search) == 1 and len(record.feature_columns) == 15
    assert spark.read.json(layout.report).filter("slice <> 'overall'").count() > 10
    assert jobs.build_evidence(spark, layout, None, "tree-v1", {"a": "b"}).count() == 320
    off = spark.read.parquet(layout.predictions).withColumn("bust_probability", F.col("bust_probability") / 2).cache()
    off.count()
    tables.write_predictions(off, layout.predictions)
    with pytest.raises(ContractViolation, match="reproduce"):
        jobs.build_evidence(spark, layout, None, "tree-v1", {"a": "b"})
