"""Incremental validity of stored cycles, digests of any size, hot cycles."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline import contract as C
from plumbline.plans import cycles
from plumbline.plans.jobs import Layout, build_corpus
from plumbline.sources import manifests, tables
from tests.test_jobs import START, TIME, sources  # noqa: F401

STAMP = "2020-06-01T00"


@pytest.fixture(scope="module")
def corpus(spark, sources, tmp_path_factory):  # noqa: F811
    layout = Layout(str(tmp_path_factory.mktemp("corpus")))
    assert build_corpus(spark, sources[0], layout, [2020]).first().status == "complete"
    return layout


def files_of(layout, stamp=STAMP):
    return sorted(Path(layout.cycles).rglob(f"init={stamp}/*.parquet"))


def log_of(spark, layout):
    return {r.init: r for r in spark.read.parquet(f"{layout.manifest}-cycles").collect()}


def rerun(spark, made, layout):
    spark.catalog.refreshByPath(layout.cycles)
    return build_corpus(spark, made, layout, [2020]).first()


def replace(spark, layout, rows):
    rows = rows.cache()
    rows.count()
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "init").mode("overwrite").parquet(layout.cycles)
    spark.catalog.refreshByPath(layout.cycles)


def test_unchanged_cycles_are_not_read(spark, sources, corpus):  # noqa: F811
    log = spark.read.parquet(f"{corpus.manifest}-cycles")
    assert cycles.changed_inits(cycles.listed(spark, corpus.cycles), log) == []
    other = [f for f in files_of(corpus, "2020-06-01T12")]
    held = [f.read_bytes() for f in other]
    before = [(f.stat().st_atime_ns, f.stat().st_mtime_ns) for f in other]
    import os

    for f, data in zip(other, held):  # the same size and time, but nothing that could be read
        f.write_bytes(b"\0" * len(data))
    for f, times in zip(other, before):
        os.utime(f, ns=times)
    for crc in Path(corpus.cycles).rglob(".*.crc"):
        crc.unlink()
    try:
        assert rerun(spark, sources[0], corpus).status == "complete"
        log = spark.read.parquet(f"{corpus.manifest}-cycles")
        assert {r.init: r.valid for r in log.collect()} == {STAMP: True, "2020-06-01T12": True}
    finally:
        for f, data, times in zip(other, held, before):
            f.write_bytes(data)
            os.utime(f, ns=times)


def test_only_changed_partitions_are_scanned(spark, corpus):
    rows = cycles.read_stored(spark, corpus.cycles, [STAMP])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(init" in plan or "PartitionFilters: [(init" in plan
    read = {r.f for r in rows.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read and all(f"init={STAMP}" in f for f in read)


def test_a_corrupt_file_makes_its_cycle_pending(spark, sources, corpus):  # noqa: F811
    for f in files_of(corpus):
        f.write_bytes(b"not a parquet file at all, however long it may be")
    for crc in Path(corpus.cycles).rglob(".*.crc"):
        crc.unlink()
    state = cycles.current(spark, corpus.cycles, spark.read.parquet(f"{corpus.manifest}-cycles"), "grid-v1", 360, 36)
    assert {r.init: (r.rows, r.valid) for r in state.collect()} == {STAMP: (0, False), "2020-06-01T12": (360, True)}
    assert rerun(spark, sources[0], corpus).status == "complete"
    assert log_of(spark, corpus)[STAMP].valid


@pytest.mark.parametrize("change", ["type", "missing", "spread", "null", "value"])
def test_changed_files_make_their_cycle_pending(spark, sources, corpus, change):  # noqa: F811
    stored = spark.read.parquet(corpus.cycles).filter(F.col(TIME) == F.lit(START).cast("timestamp_ntz"))
    changed = {
        "type": lambda: stored.withColumn("lead_day", F.col("lead_day").cast("string")),
        "missing": lambda: stored.drop("u10_mean_mps"),
        "spread": lambda: stored.withColumn("mslp_spread_pa", F.lit(1.0)),
        "null": lambda: stored.withColumn("season_sin", F.when(F.col("lead_day") > 1, F.col("season_sin"))),
        "value": lambda: stored.withColumn("mslp_mean_pa", F.lit(1.0)),
    }[change]()
    replace(spark, corpus, changed)
    log = spark.read.parquet(f"{corpus.manifest}-cycles")
    assert cycles.changed_inits(cycles.listed(spark, corpus.cycles), log) == [STAMP]
    state = {r.init: r.valid for r in cycles.current(spark, corpus.cycles, log, "grid-v1", 360, 36).collect()}
    assert state == {STAMP: False, "2020-06-01T12": True}
    status = rerun(spark, sources[0], corpus)
    assert (status.status, status.row_count) == ("complete", 720)
    clean = spark.read.schema(C.DERIVED_ROW).parquet(corpus.cycles)
    assert clean.filter("mslp_mean_pa = 1.0 OR season_sin IS NULL").isEmpty()


def test_touched_files_with_the_same_content_stay_valid(spark, corpus):
    before = log_of(spark, corpus)[STAMP]
    replace(spark, corpus, spark.read.parquet(corpus.cycles).filter(F.col(TIME) == F.lit(START).cast("timestamp_ntz")))
    log = spark.read.parquet(f"{corpus.manifest}-cycles")
    after = {r.init: r for r in cycles.current(spark, corpus.cycles, log, "grid-v1", 360, 36).collect()}[STAMP]
    assert after.valid and after.fingerprint == before.fingerprint and after.mark != before.mark


def test_manifest_tells_gaps_alignment_and_weights(spark, sources, corpus, tmp_path):  # noqa: F811
    layout = Layout(str(tmp_path))
    first = build_corpus(spark, sources[0], layout, [2020], max_cycles=1).first()
    gaps = [(r.init, r.problem) for r in spark.read.parquet(f"{layout.manifest}-gaps").collect()]
    assert gaps == [("2020-06-01T12", "missing")] and first.missing == 1
    status = spark.read.json(corpus.manifest).first()
    assert (status.state_alignment, status.precipitation_alignment, status.dataset_version) == ("identity", "identity", "grid-v1")
    assert status.weights_fingerprint == manifests.table_fingerprint(sources[0].weights).first().fingerprint


def test_a_hot_cycle_is_written_by_many_tasks(spark, tmp_path):
    root = str(tmp_path / "cycles")
    time = lambda day: F.lit(datetime(2020, 6, day)).cast("timestamp_ntz")
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 10 < 9, time(1)).otherwise(time(2)).alias(TIME),
        (F.col("id") % 10).cast("int").alias("lead_day"),
        F.sha2(F.col("id").cast("string"), 256).alias("region_id"),
    )
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = spark.conf.get(name)
    spark.conf.set(name, "1m")
    try:
        tables.write_cycles(rows, root)
    finally:
        spark.conf.set(name, held)
    hot = list(Path(root).rglob("init=2020-06-01T00/*.parquet"))
    assert len(hot) > 4
    tables.write_cycles(rows.filter(F.col(TIME) == time(1)).limit(10), root)
    counts = {r.init: r["count"] for r in spark.read.parquet(root).groupBy("init").count().collect()}
    assert sorted(counts.values()) == [10, 20_000]


def test_content_digests_see_values_order_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifests, "BLOCK_ROWS", 64)
    rows = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1)
    rows.sortWithinPartitions("id").write.parquet(f"{tmp_path}/a")
    rows.sortWithinPartitions(F.desc("id")).write.parquet(f"{tmp_path}/b")
    rows.withColumn("text", F.when(F.col("id") != 700, F.col("text"))).write.parquet(f"{tmp_path}/c")
    digest = lambda name: manifests.content_digests(spark.read.parquet(f"{tmp_path}/{name}")).first()
    a, b, c = (digest(n) for n in "abc")
    assert a.rows == b.rows == c.rows == 1000
    assert a.fingerprint == b.fingerprint != c.fingerprint
    assert len({a.sha256, b.sha256, c.sha256}) == 3
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert digest("a") == a
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
