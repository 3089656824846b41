"""Contract checks, identifiers, text guards, tables and views."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline import contract as C
from plumbline.errors import ContractViolation, raise_if_any
from plumbline.functions import scalars
from plumbline.operators import narrative, quality, views
from plumbline.sources import manifests, tables

TIME = "forecast_initialization_time"


def test_leakage_is_rejected(spark):
    rows = spark.createDataFrame(
        [(datetime(2020, 6, 2), datetime(2020, 6, 1))], f"feature_source_time timestamp_ntz, {TIME} timestamp_ntz"
    )
    with pytest.raises(ContractViolation, match="source"):
        raise_if_any(quality.late_sources(rows), "late source")
    assert quality.leaked_columns(["analysis_x", "t2m", "verification_y"]) == ["analysis_x", "verification_y"]


def test_units(spark):
    units = [(v, (u or [None])[0]) for v, u in C.FORECAST_UNITS.items()]
    table = spark.createDataFrame(units, "variable string, units string")
    assert quality.unit_violations(table, C.FORECAST_UNITS).isEmpty()
    wrong = table.withColumn("units", F.when(F.col("variable") == "geopotential", "m").otherwise(F.col("units")))
    found = quality.unit_violations(wrong.filter("variable <> '2m_temperature'"), C.FORECAST_UNITS).collect()
    assert {(r.variable, r.problem) for r in found} == {("geopotential", "units"), ("2m_temperature", "missing")}


def test_non_finite_values_are_counted(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (float("nan"), 2.0), (float("inf"), 3.0), (None, 4.0)], "a double, b double")
    assert [tuple(r) for r in quality.non_finite_counts(rows, ["a", "b"]).collect()] == [("a", 3)]


def test_cycle_validity(spark):
    rows = [(datetime(2020, 6, 1 + c), lead, f"imd-{r:02d}", "v") for c in range(3) for lead in range(1, 11) for r in range(1, 37)]
    table = spark.createDataFrame(rows, f"{TIME} timestamp_ntz, lead_day int, region_id string, dataset_version string")
    day = F.dayofmonth(TIME)
    broken = table.withColumn("lead_day", F.when((day == 2) & (F.col("lead_day") == 3), 11).otherwise(F.col("lead_day"))).withColumn(
        "dataset_version", F.when(day == 3, "w").otherwise("v")
    )
    judged = quality.cycle_validity(broken, "v")
    assert [r.valid for r in judged.orderBy(TIME).collect()] == [True, False, False]


def test_ranges(spark):
    rows = spark.createDataFrame([(1, 0.5, 1), (11, 0.5, 0), (3, 1.2, 2), (None, None, 0)], "lead_day int, bust_probability double, bust int")
    found = [r.violations for r in quality.range_violations(rows, quality.response_checks()).collect()]
    assert found == [["lead"], ["probability", "label"], ["lead", "probability"]]
    text = spark.createDataFrame([("fine",), ("   ",), ("x" * 501,)], "t string")
    assert quality.range_violations(text, {"t": quality.text_check("t", 500)}).count() == 2


def test_identifiers_round_trip(spark):
    rows = spark.createDataFrame([(datetime(2022, 9, 30, 12), "imd-07", 3)], f"{TIME} timestamp_ntz, region_id string, lead_day int")
    made = rows.select(
        scalars.run_id(F.col(TIME)).alias("run"),
        scalars.prediction_id(F.lit("tree-v1"), F.col(TIME), F.col("region_id"), F.col("lead_day")).alias("pid"),
        scalars.iso_nanos(F.col(TIME)).alias("iso"),
    )
    row = made.select("*", scalars.parse_run_id(F.col("run")).alias("t"), scalars.parse_prediction_id(F.col("pid")).alias("p")).first()
    assert row.run == "run-20220930T120000Z" and row.iso == "2022-09-30T12:00:00.000000000"
    assert row.pid == "tree-v1__20220930T120000Z__imd-07__d03"
    assert row.t == datetime(2022, 9, 30, 12) and (row.p.region_id, row.p.lead_day) == ("imd-07", 3)
    for text in ("run-20220930T120000", "run-20220930T120000Z ", "xrun-20220930T120000Z", "run-20221330T120000Z"):
        assert spark.range(1).select(scalars.parse_run_id(F.lit(text)).alias("t")).first().t is None


def _flag(spark, column, *texts, p=0.35):
    rows = spark.createDataFrame([(i, t, p) for i, t in enumerate(texts)], "i int, t string, p double")
    return [r.f for r in rows.select("i", column.alias("f")).orderBy("i").collect()]


def test_numbers_in_texts(spark):
    grounded = narrative.numbers_are_grounded(F.col("t"), F.col("p"))
    texts = [
        "changed the risk to 95%", "risk probability is 0.95", "it is 35.0% or 65 %", "reliability near 0.65.",
        "no numbers", "v1.35% is a version", "35%36%", "é12% is part of a word",
    ]
    assert _flag(spark, grounded, *texts) == [False, False, True, True, True, True, False, True]


def test_unsupported_claims(spark):
    claim = narrative.has_unsupported_claim(F.col("t"))
    texts = ["A cyclone will form", "Storm Surge", "it WILL LEAD TO rain", "floodlight", "because", "éflood", "it proves"]
    assert _flag(spark, claim, *texts) == [True, True, True, False, False, False, True]


def test_question_key_ignores_case_and_blanks(spark):
    keys = _flag(spark, narrative.question_hash(F.col("t")), "Why  IS\tit\n high?", " why is it high? ", "Why is it low?")
    assert keys[0] == keys[1] != keys[2]
    rows = spark.createDataFrame([("A b", 2), ("a  B", 1), ("c", 3)], "q string, at int")
    found = narrative.first_per_question(rows, "q", ["at"]).collect()
    assert {(r.q, r.askings) for r in found} == {("a  B", 2), ("c", 1)}
    parts = {"model_version": F.lit("m"), "mode": F.lit("simple")}
    key = lambda p: spark.range(1).select(narrative.cache_key(F.lit("q"), p).alias("k")).first().k
    assert key(parts) == key(dict(reversed(parts.items()))) != key({**parts, "mode": F.lit("other")})


def _predictions(spark):
    rows = [(datetime(2022, 6, 1 + c), lead, f"imd-{r:02d}", (r * lead % 37) / 37) for c in range(2) for lead in range(1, 11) for r in range(1, 37)]
    table = spark.createDataFrame(rows[:-1], f"{TIME} timestamp_ntz, lead_day int, region_id string, bust_probability double")
    return table.withColumn("valid_time", F.col(TIME) + F.make_dt_interval(F.col("lead_day")))


def test_views(spark):
    table = _predictions(spark)
    runs = views.runs(table).collect()
    assert [(r.data_status, r.records) for r in runs] == [("partial", 359), ("complete", 360)]
    assert runs[0].available_lead_days == list(range(1, 11))
    assert views.risk_maps(table).count() == 19 * 36
    curves = views.lead_curves(table).collect()
    assert len(curves) == 71 and [p.lead_day for p in curves[0].points] == list(range(1, 11))
    best = views.highest_risk_region(table).filter("lead_day = 1").first()
    assert best.region_id == "imd-36"
    bands = [spark.range(1).select(views.risk_band(F.lit(p)).alias("b")).first().b for p in (0.0, 0.25, 0.5, 0.75)]
    assert bands == [0, 1, 2, 3]
    named = views.with_identity(table, "m")
    assert named.select("prediction_id").distinct().count() == 719
    assert views.find_explanation(named, "m__20220601T000000Z__imd-01__d01").count() == 1


def test_point_filters_reach_both_scans(spark, tmp_path):
    table = _predictions(spark)
    table.write.parquet(f"{tmp_path}/p")
    table.withColumn("region_name", F.lit("x")).write.parquet(f"{tmp_path}/l")
    found = views.prediction_rows(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/l"), ["region_name"], lead_day=4, region_id="imd-05")
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(lead_day,4)") >= 2 and plan.count("EqualTo(region_id,imd-05)") >= 2


def test_labelled_table_is_pruned_and_manifest_checked(spark, tmp_path):
    path = f"{tmp_path}/labelled"
    tables.write_labelled(_predictions(spark).withColumn("bust", F.lit(1)), path)
    july = tables.read_labelled(spark, path).filter("year = 2022 AND month = 7")
    assert july.isEmpty() and "PartitionFilters: [isnotnull(year" in july._jdf.queryExecution().executedPlan().toString()
    sums = manifests.file_checksums(spark, path).cache()
    assert manifests.checksum_differences(sums, sums).isEmpty()
    assert manifests.checksum_differences(sums, sums.withColumn("path", F.lit("gone"))).count() == 2 * sums.count() - (sums.count() - 1)
    with pytest.raises(ContractViolation, match="no cycle partitions"):
        (tmp_path / "empty").mkdir()
        tables.read_cycles(spark, f"{tmp_path}/empty")


def test_parameterized_sql(spark):
    tables.register_views(predictions=_predictions(spark))
    assert tables.query(spark, "SELECT count(*) AS n FROM predictions WHERE lead_day = :lead", lead=3).first().n == 72


def test_manifest_status(spark):
    wanted = spark.createDataFrame([(1,), (2,)], "k int")
    have = spark.createDataFrame([(1, 360), (3, 360)], "k int, rows int")
    row = manifests.corpus_summary(wanted, have, "k", 360).first()
    assert (row.missing, row.unexpected, row.status) == (1, 1, "incomplete")
    full = manifests.corpus_summary(wanted, wanted.withColumn("rows", F.lit(360)), "k", 360).first()
    assert full.status == "complete" and manifests.manifest_total_matches(have, 720)


def test_source_coverage_of_means_and_members(spark):
    rows = [(datetime(2020, 6, 1), 24, 500, None, 9.0, 70.0), (datetime(2020, 7, 1), 24, 850, None, 9.0, 70.0)]
    names = "init_time timestamp_ntz, lead_hours int, level_hpa int, number int, latitude double, longitude double"
    grid = spark.createDataFrame(rows, names)
    check = lambda df, **more: sorted(r.violation for r in quality.coverage_violations(df, [24], [500, 850], "2020-06-01", "2020-07-01", **more).collect())
    assert check(grid, mean_source=True, months=[6], domain=True) == []
    assert check(grid.withColumn("number", F.lit(3)), mean_source=True) == ["members in a mean source"]
    assert check(grid.withColumn("latitude", F.lit(80.0)), months=[1], domain=True) == ["empty domain", "empty months"]
    assert check(grid.drop("level_hpa", "latitude"), domain=True) == ["missing dimension latitude", "missing dimension level_hpa"]
    assert check(grid.drop("number"), mean_source=True) == []
    assert check(grid, members=50) == ["members 0"]
    assert "short coverage" in check(grid.limit(0), domain=True)
