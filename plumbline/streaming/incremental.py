"""Continuous form of the corpus job: new forecast files are derived as they arrive."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline import contract as C
from plumbline.plans.jobs import Layout, Sources, build_corpus


def follow_forecasts(
    spark: SparkSession, landing: str, sources: Sources, layout: Layout, years: list[int], checkpoint: str
) -> StreamingQuery:
    """Process every file that has landed since the last run, then stop.

    The stream only tells which runs have news: their cycles are derived from the full landing table,
    because drift and verification need other runs. A batch replayed after a failure rewrites the same
    partitions, so the result is the same.
    """
    arrivals = spark.readStream.schema(C.FORECAST_GRID).parquet(landing).select("init_time")

    def derive(batch: DataFrame, _: int) -> None:
        news = batch.distinct()
        if news.isEmpty():
            return
        table = spark.read.schema(C.FORECAST_GRID).parquet(landing)
        build_corpus(spark, replace(sources, forecast=table, previous=table), layout, years, only=news)

    return (
        arrivals.writeStream.foreachBatch(derive)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
