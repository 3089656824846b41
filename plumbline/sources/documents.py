"""JSON sources and sinks: region manifests, GeoJSON, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_FEATURES = (
    "type string, features array<struct<id string, properties struct<region_id int, region_name string>, "
    "geometry struct<type string, coordinates string>>>"
)
_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def read_region_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest JSON to rows (region_id, source_name, region_name)."""
    schema = "regions array<struct<id int, source_name string, name string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("regions"))
    return rows.select(F.col("id").alias("region_id"), "source_name", F.col("name").alias("region_name"))


def _signed_rings(polygon: Column) -> Column:
    """First ring of a polygon is its outline, the others are holes."""
    return F.transform(
        polygon, lambda ring, i: F.struct(F.when(i == 0, 1).otherwise(-1).alias("sign"), ring.alias("points"))
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection to (region_id, region_name, rings); Polygon and MultiPolygon."""
    feature = F.explode("features").alias("f")
    rows = spark.read.schema(_FEATURES).option("multiLine", True).json(path).select(feature)
    text = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(text, _MULTI)).otherwise(
        F.array(F.from_json(text, _POLYGON))
    )
    rings = F.flatten(F.transform(polygons, _signed_rings))
    return rows.select("f.properties.region_id", "f.properties.region_name", rings.alias("rings"))


def geojson_feature(number: Column, canonical: Column, name: Column, outline: Column) -> Column:
    """One GeoJSON feature as text; ``outline`` is the array of rings of a polygon."""
    properties = F.struct(number.alias("region_id"), name.alias("region_name"), canonical.alias("canonical_region_id"))
    geometry = F.struct(F.lit("Polygon").alias("type"), outline.alias("coordinates"))
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), canonical.alias("id"), properties.alias("properties"), geometry.alias("geometry")
        )
    )


def parse_feature(text: Column) -> Column:
    """Struct of a GeoJSON feature text holding a polygon."""
    return F.from_json(
        text,
        "type string, id string, properties struct<region_id int, region_name string, canonical_region_id string>, "
        f"geometry struct<type string, coordinates {_POLYGON}>",
    )


def write_json_report(report: DataFrame, path: str) -> None:
    """A small report as JSON lines with columns in sorted order."""
    report.select(*sorted(report.columns)).coalesce(1).write.mode("overwrite").json(path)
