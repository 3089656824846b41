"""Batch jobs: corpus, labels, training, evidence, and the gate between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import contract as C
from plumbline.errors import ContractViolation, raise_if_any
from plumbline.functions.scalars import content_hash
from plumbline.operators import coordinates, evidence, labels, model, quality
from plumbline.plans import cycles
from plumbline.plans.derive import checked_cycles, derive_rows, same_axes
from plumbline.session import written
from plumbline.sources import documents, manifests, tables

TIME = "forecast_initialization_time"


@dataclass(frozen=True)
class Layout:
    """Folders of one corpus."""

    root: str

    def __getattr__(self, name: str) -> str:
        known = {"cycles", "quarantine", "labelled", "label_fit", "manifest", "predictions", "model", "report", "analog_scaler", "explanations"}
        if name not in known:
            raise AttributeError(name)
        return f"{self.root}/{name}"


@dataclass(frozen=True)
class Sources:
    """Inputs of the corpus job."""

    forecast: DataFrame
    previous: DataFrame
    analysis: DataFrame
    weights: DataFrame
    axes: tuple[DataFrame, DataFrame]
    dataset_version: str
    regions: int = C.REGION_COUNT
    analysis_axes: tuple[DataFrame, DataFrame] | None = None

    @property
    def rows_per_cycle(self) -> int:
        return self.regions * C.LEAD_DAYS


def check_sources(sources: Sources, units: dict[str, DataFrame], first: str, last: str, members: int | None = None) -> DataFrame:
    """Source contract report: unit and coverage violations of the landing tables.

    Without ``members`` the forecast is a table of ensemble means and must not hold any.
    """
    found = [
        quality.unit_violations(units["forecast"], C.FORECAST_UNITS).select(
            F.concat_ws(" ", F.lit("forecast"), "variable", "problem").alias("violation")
        ),
        quality.unit_violations(units["analysis"], C.ANALYSIS_UNITS).select(
            F.concat_ws(" ", F.lit("analysis"), "variable", "problem").alias("violation")
        ),
        quality.coverage_violations(
            sources.forecast, C.LEAD_HOURS, C.PRESSURE_LEVELS, first, last, members, members is None, C.SEASON_MONTHS, True
        ),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _log(spark: SparkSession, layout: Layout) -> DataFrame:
    """The cycle log of the last run, read before it may be replaced."""
    path = f"{layout.manifest}-cycles"
    return written(cycles.known(spark, path if _exists(spark, path) else None), "cycle-log")


def _cycle_state(spark: SparkSession, layout: Layout, sources: Sources, trusted: list[str] | None = None) -> DataFrame:
    """Files, rows and verdict of every stored cycle; only cycles whose files changed since the last run are read."""
    log = _log(spark, layout)
    if not _exists(spark, layout.cycles):
        return log.limit(0)
    found = cycles.current(spark, layout.cycles, log, sources.dataset_version, sources.rows_per_cycle, sources.regions, trusted)
    return written(found, "cycle-state")


def pending_cycles(expected: DataFrame, state: DataFrame) -> DataFrame:
    """Expected cycles that are not stored as valid ones."""
    valid = state.filter("valid").select(F.to_timestamp_ntz("init", F.lit(cycles.STAMP)).alias("init_time"))
    return expected.join(valid, "init_time", "left_anti")


def build_corpus(
    spark: SparkSession,
    sources: Sources,
    layout: Layout,
    years: list[int],
    max_cycles: int | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Derive all pending cycles in one plan and replace their partitions; returns the corpus status.

    Invalid stored cycles are copied to the quarantine folder before they are replaced. The manifest is
    written even when a check fails, so the next run continues from what is stored. ``only`` restricts the
    run to some cycles.
    """
    if max_cycles is not None and max_cycles < 0:
        raise ContractViolation("max_cycles must not be negative")
    expected = written(coordinates.expected_cycles(sources.forecast, years), "expected-cycles")
    raise_if_any(coordinates.bad_cycle_hours(expected), "unexpected initialization hours")
    state = _cycle_state(spark, layout, sources)
    pending = pending_cycles(expected, state)
    if only is not None:
        pending = pending.join(only.select("init_time").distinct(), "init_time", "left_semi")
    if max_cycles is not None:
        pending = pending.orderBy("init_time").limit(max_cycles)
    pending = written(pending, "pending-cycles")
    try:
        if not pending.isEmpty():
            stamps = [r[0] for r in pending.select(F.date_format("init_time", cycles.STAMP)).collect()]  # one per cycle
            if not state.isEmpty():
                bad = cycles.read_stored(spark, layout.cycles, stamps).drop("year", "month", "init")
                tables.write_cycles(bad.filter(F.col(TIME).isNotNull()), layout.quarantine)
            derived = derive_rows(
                sources.forecast, sources.previous, sources.analysis, sources.weights, sources.axes,
                sources.dataset_version, pending, analysis_axes=sources.analysis_axes,
            )
            rows = checked_cycles(derived)
            raise_if_any(quality.wrong_counts(rows, [TIME], sources.rows_per_cycle), "incomplete cycles")
            raise_if_any(quality.wrong_counts(rows, [TIME, "lead_day"], sources.regions), "incomplete leads")
            raise_if_any(
                pending.select(F.col("init_time").alias(TIME)).join(rows.select(TIME).distinct(), TIME, "left_anti"),
                "cycles without rows",
            )
            tables.write_cycles(rows, layout.cycles)
            state = _cycle_state(spark, layout, sources, stamps)
    finally:
        state.write.mode("overwrite").parquet(f"{layout.manifest}-cycles")
        status = corpus_status(expected, state, sources)
        documents.write_json_report(status, layout.manifest)
        wanted, present = _wanted(expected), state.filter("rows > 0").select("init")
        manifests.manifest_gaps(wanted, present, "init").write.mode("overwrite").parquet(f"{layout.manifest}-gaps")
    return status


def _wanted(expected: DataFrame) -> DataFrame:
    return expected.select(F.date_format("init_time", cycles.STAMP).alias("init"))


def corpus_status(expected: DataFrame, state: DataFrame, sources: Sources) -> DataFrame:
    """One row: completeness of the stored cycles, the alignment used and a fingerprint of the region weights."""
    summary = manifests.corpus_summary(_wanted(expected), state.filter("rows > 0"), "init", sources.rows_per_cycle)
    own_grid = sources.analysis_axes is not None and not same_axes(sources.analysis_axes, sources.axes)
    weights = manifests.table_fingerprint(sources.weights).select("fingerprint")
    facts = {
        "dataset_version": F.lit(sources.dataset_version),
        "state_alignment": F.lit("bilinear" if own_grid else "identity"),
        "precipitation_alignment": F.lit("conservative" if own_grid else "identity"),
        "weights_fingerprint": weights.scalar(),
    }
    return written(summary.withColumns(facts), "corpus-status")


def label_corpus(spark: SparkSession, layout: Layout, train_years: list[int] | None = None, **options) -> DataFrame:
    """Gate on a complete corpus, fit on training years, label everything; returns prevalence by year."""
    status = spark.read.json(layout.manifest).first()
    if status is None or status["status"] != "complete":
        raise ContractViolation("corpus is incomplete; build it before labelling")
    rows = tables.read_cycles(spark, layout.cycles)
    year = F.year(TIME)
    fit = labels.fit_labels(rows, year.isin(train_years or C.TRAIN_YEARS), **options)
    fit.stats.write.mode("overwrite").parquet(f"{layout.label_fit}/stats")
    fit.thresholds.write.mode("overwrite").parquet(f"{layout.label_fit}/thresholds")
    documents.write_json_report(_fit_record(fit, train_years or C.TRAIN_YEARS, options), f"{layout.label_fit}/record")
    labelled = fit.apply(rows)
    tables.write_labelled(labelled, layout.labelled)
    stored = tables.read_labelled(spark, layout.labelled)
    raise_if_any(labels.unlabelled(stored), "rows without fitted statistics or threshold")
    files = manifests.content_digests(stored)
    files.write.mode("overwrite").parquet(f"{layout.manifest}-labelled")
    return labels.prevalence(stored, year)


def _fit_record(fit: labels.LabelFit, train_years: list[int], options: dict) -> DataFrame:
    """One row describing a label fit: its parameters and fingerprints of both fitted tables."""
    one = F.lit(1).alias("_one")
    stats = manifests.table_fingerprint(fit.stats).select(F.col("fingerprint").alias("stats_fingerprint"), one)
    thresholds = manifests.table_fingerprint(fit.thresholds).select(F.col("fingerprint").alias("threshold_fingerprint"), one)
    facts = {
        "fit_years": F.array(*[F.lit(y) for y in train_years]),
        "minimum_group_samples": F.lit(options.get("min_samples", C.MIN_GROUP_SAMPLES)),
        "epsilon": F.lit(C.Z_EPSILON),
        "limit": F.lit(C.Z_LIMIT),
        "threshold_quantile": F.lit(options.get("share", C.THRESHOLD_QUANTILE)),
    }
    record = stats.join(thresholds, "_one").drop("_one").withColumns(facts)
    return record.withColumn("content_sha256", content_hash(*record.columns))


def split_corpus(labelled: DataFrame, train: list[int] | None = None, validation: int = C.VALIDATION_YEAR, test: int = C.TEST_YEAR) -> DataFrame:
    rows = coordinates.with_split(labelled, F.year(TIME), train or C.TRAIN_YEARS, validation, test)
    raise_if_any(coordinates.split_violations(rows), "temporal split does not hold")
    return rows


def train_and_evaluate(
    spark: SparkSession, layout: Layout, candidates: list[dict] | None = None, numeric: list[str] | None = None, **years
) -> DataFrame:
    """Verify labelled files, fit, calibrate, predict held-out years and report metrics."""
    changed = manifests.checksum_differences(
        manifests.content_digests(tables.read_labelled(spark, layout.labelled)), spark.read.parquet(f"{layout.manifest}-labelled")
    )
    raise_if_any(changed, "labelled files differ from their manifest")
    rows = split_corpus(tables.read_labelled(spark, layout.labelled), **years)
    part = lambda name: rows.filter(F.col("split") == name)
    train, held = part("train"), rows.filter(F.col("split") != "train")
    fitted = model.fit_risk_model(train, part("validation"), numeric, candidates=candidates)
    fitted.save(layout.model)
    predictions = model.held_out_predictions(fitted, train, held, C.PREDICTION_KEYS)
    tables.write_predictions(predictions, layout.predictions)
    stored = spark.read.parquet(layout.predictions)
    replayed(spark, layout, stored, held, numeric)
    report = written(model.full_report(stored), "evaluation")
    documents.write_json_report(report, layout.report)
    record = _training_record(spark, fitted, stored, train, rows)
    documents.write_json_report(record, f"{layout.report}-record")
    return report.filter(F.col("slice") == "overall")


def replayed(spark: SparkSession, layout: Layout, stored: DataFrame, rows: DataFrame, numeric: list[str] | None = None) -> model.RiskModel:
    """The saved model, after it has reproduced the stored probabilities; anything else is an error."""
    saved = model.RiskModel.load(spark, layout.model, numeric)
    again = saved.score(rows).select(*C.PREDICTION_KEYS, "raw_probability", "bust_probability")
    raise_if_any(model.replay_differences(stored, again, C.PREDICTION_KEYS), "stored probabilities that the saved model does not reproduce")
    return saved


def _training_record(spark: SparkSession, fitted: model.RiskModel, stored: DataFrame, train: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: contract, search, years, row counts and fingerprints of what was fitted on and predicted."""
    contract = fitted.contract()
    one = F.lit(1).alias("_one")
    predicted = manifests.table_fingerprint(stored).select(F.col("rows").alias("prediction_rows"), F.col("fingerprint").alias("prediction_fingerprint"), one)
    fitted_on = manifests.table_fingerprint(train).select(F.col("rows").alias("training_rows"), F.col("fingerprint").alias("training_fingerprint"), one)
    years = rows.agg(*[F.sort_array(F.collect_set(F.when(F.col("split") == s, F.year(TIME)))).alias(f"{s}_years") for s in ("train", "validation", "test")])
    facts = {
        "feature_columns": F.array(F.lit(contract["category"]), *[F.lit(n) for n in contract["numeric"]]),
        "contract_sha256": F.lit(contract["content_sha256"]),
        "random_state": F.lit(C.RANDOM_STATE),
        "search": F.array(*[F.struct(F.to_json(F.create_map(*[F.lit(str(x)) for pair in s["parameters"].items() for x in pair])).alias("parameters"), F.lit(s["validation_pr_auc"]).cast("double").alias("validation_pr_auc")) for s in contract["search"]]),
    }
    record = predicted.join(fitted_on, "_one").join(years.select("*", one), "_one").drop("_one").withColumns(facts)
    return record.withColumn("content_sha256", content_hash(*record.columns))


def build_evidence(
    spark: SparkSession, layout: Layout, fitted: model.RiskModel | None, model_version: str, provenance: dict[str, str], **years
) -> DataFrame:
    """Fit the analog scaler and store one explanation per held-out prediction.

    Without ``fitted`` the saved model is loaded, and must reproduce the stored probabilities first.
    """
    rows = split_corpus(tables.read_labelled(spark, layout.labelled), **years)
    train, held = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") != "train")
    if fitted is None:
        fitted = replayed(spark, layout, spark.read.parquet(layout.predictions), held)
    scaler = written(evidence.analog_scaler(train, fitted.numeric), "analog-scaler")
    source = manifests.table_fingerprint(spark.read.parquet(f"{layout.manifest}-labelled")).select("fingerprint")
    scaler.withColumn("source_fingerprint", source.scalar()).write.mode("overwrite").parquet(layout.analog_scaler)
    records = evidence.explanations(fitted, held, train, provenance, model_version, fitted.numeric)
    records = written(records, "explanations")
    raise_if_any(records.filter(~F.col("additive")), "attributions do not add up to the margin")
    records.withColumn("year", F.year("source_forecast_time")).write.partitionBy("year").mode("overwrite").parquet(layout.explanations)
    return spark.read.parquet(layout.explanations)


def training_gate(spark: SparkSession, layout: Layout, train_years: list[int] | None = None, **options) -> DataFrame:
    """Labels and training in order; refuses to train on an incomplete corpus."""
    label_corpus(spark, layout, train_years)
    return train_and_evaluate(spark, layout, **options)
