"""The given business tables in the shapes the operators expect.

Every binding reads whole tables; the shapes (cells, leads, regions) are arithmetic on their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import contract as C
from plumbline.operators import labels
from plumbline.operators.coordinates import with_split
from plumbline.operators.regions import normalized_weights
from plumbline.session import written
from plumbline.sources.landing import write_landing

TRAIN = [1995, 1996, 1997, 1998]
VALIDATION = 1999
TEST_YEARS = [2000, 2001]
MIN_SAMPLES = 400


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def errors(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as verification errors: region = supplier nation, lead = line number, 8 for round orders."""
    line, supplier, part = (table(spark, d, t) for t in ("lineitem", "supplier", "part"))
    joined = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return joined.select(
        "l_orderkey",
        F.col("s_nationkey").cast("string").alias("region_id"),
        F.when(F.col("l_orderkey") % 100 == 0, 8).otherwise(F.col("l_linenumber")).alias("lead_day"),
        F.year("l_shipdate").alias("yr"),
        F.col("l_shipdate").alias("forecast_initialization_time"),
        "l_quantity",
        "l_extendedprice",
        F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")).alias("e_precip_mm"),
        F.abs(F.col("l_quantity") - 25).alias("e_mslp_pa"),
        F.col("l_discount").alias("e_wind_mps"),
        F.col("l_tax").alias("e_temperature_k"),
    )


def is_train(year: str = "yr"):
    return F.col(year).between(TRAIN[0], TRAIN[-1])


def label_fit(spark: SparkSession, d: str) -> labels.LabelFit:
    """Fit of the ``errors`` binding."""
    return labels.fit_labels(errors(spark, d), is_train(), min_samples=MIN_SAMPLES)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return label_fit(spark, d).apply(errors(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled order lines with a probability from the quantity (many ties) and a climatology."""
    rows = labelled(spark, d)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(0.08) * F.col("l_quantity") - 3)))
    return rows.withColumns({"p": p, "c": F.col("lead_day") / F.lit(20.0)})


def grid(spark: SparkSession, d: str) -> DataFrame:
    """12 x 12 cells per year with averages of three fields."""
    line = table(spark, d, "lineitem")
    lat_i, lon_i = F.col("l_partkey") % 12, F.col("l_orderkey") % 12
    return (
        line.withColumns({"lat_i": lat_i.cast("int"), "lon_i": lon_i.cast("int"), "yr": F.year("l_shipdate")})
        .withColumns({"latitude": 6.0 + 1.5 * F.col("lat_i"), "longitude": 68.0 + 1.5 * F.col("lon_i")})
        .groupBy("yr", "lat_i", "lon_i", "latitude", "longitude")
        .agg(
            F.avg("l_extendedprice").alias("f"),
            F.avg("l_quantity").alias("u"),
            F.avg(F.col("l_discount") * 100).alias("v"),
        )
    )


def axis(rows: DataFrame, index: str, column: str) -> DataFrame:
    return rows.select(F.col(index).alias("idx"), F.col(column).alias("value")).distinct()


def grid_axes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cells = grid(spark, d)
    return written(axis(cells, "lat_i", "latitude"), "lat-axis"), written(axis(cells, "lon_i", "longitude"), "lon-axis")


def grid_areas(spark: SparkSession, d: str) -> DataFrame:
    """Cell areas of the grid, each cell belonging to the region (lat_i + lon_i) % 5."""
    cells = grid(spark, d).select("lat_i", "lon_i", "latitude", "longitude").distinct()
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))
    band = F.sin(F.radians(F.col("latitude") + 0.75)) - F.sin(F.radians(F.col("latitude") - 0.75))
    placed = cells.withColumns({"region_id": (F.col("lat_i") + F.col("lon_i")) % 5, "area_m2": band * F.radians(F.lit(1.5))})
    return placed.join(region, "region_id")


def part_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as small longitude/latitude boxes."""
    part = table(spark, d, "part")
    west = F.lit(68.0) + (F.col("p_partkey") * 53 % 2719) / F.lit(100.0)
    south = F.lit(6.0) + (F.col("p_partkey") * 37 % 2917) / F.lit(100.0)
    size = F.lit(0.1) + F.col("p_size") / F.lit(40.0)
    boxes = part.select(
        F.col("p_partkey").alias("region_id"), F.col("p_name").alias("region_name"),
        west.alias("w"), south.alias("s"), (west + size).alias("e"), (south + size).alias("n"),
    )
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(point("w", "s"), point("e", "s"), point("e", "n"), point("w", "n"), point("w", "s"))
    return boxes.select("region_id", "region_name", F.array(F.struct(F.lit(1).alias("sign"), ring.alias("points"))).alias("rings"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as historical events: region = label, lead = id mod 17, start = id."""
    rows = table(spark, d, "embeddings")
    return rows.select(
        "vec_id", F.col("label").alias("region_id"), (F.col("vec_id") % 17).cast("int").alias("lead_day"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)],
    )


DIMENSIONS = [f"e{i}" for i in range(64)]


def floor_time(column: str, hours: int):
    """Start of the ``hours`` slot of the day, without leaving zone-free time."""
    c = column
    return F.expr(f"make_timestamp_ntz(year({c}), month({c}), day({c}), CAST((hour({c}) DIV {hours}) * {hours} AS INT), 0, 0)")


def cycles(spark: SparkSession, d: str) -> DataFrame:
    """Events as run values: init = 12 h slot, lead = 24, 48 or 72 h by user, region = event type."""
    events = table(spark, d, "events")
    return events.select(
        floor_time("ts", 12).alias("init_time"),
        (F.lit(24) * (F.col("user_id") % 3 + 1)).cast("int").alias("lead_hours"),
        F.col("event_type").alias("region_id"),
        "user_id",
        "value",
    )


def clustered_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as boxes in clusters of forty, one cluster per degree: overlaps grow with the parts and not with their square."""
    part = table(spark, d, "part")
    at, cluster = F.col("p_partkey") % 40, F.expr("CAST(p_partkey DIV 40 AS BIGINT)")
    west = F.lit(-175.0) + cluster % 350 + at * 0.02
    south = F.lit(-75.0) + F.expr("CAST(p_partkey DIV 14000 AS BIGINT)") % 150 + (F.col("p_partkey") * 7 % 40) * 0.02
    size = F.lit(0.05) + F.col("p_size") / 200
    boxes = part.select(F.col("p_partkey").alias("region_id"), F.col("p_name").alias("region_name"), west.alias("w"), south.alias("s"), (west + size).alias("e"), (south + size).alias("n"))
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(point("w", "s"), point("e", "s"), point("e", "n"), point("w", "n"), point("w", "s"))
    return boxes.select("region_id", "region_name", F.array(F.struct(F.lit(1).alias("sign"), ring.alias("points"))).alias("rings"))


def event_field(spark: SparkSession, d: str, lines: int) -> DataFrame:
    """Events as a field: mean value of every 6 h slot and cell of a ``lines`` x ``lines`` grid, the slot's mean where a cell has none."""
    placed = table(spark, d, "events").select(
        floor_time("ts", 6).alias("t"),
        (F.col("user_id") % lines).cast("int").alias("i"),
        (F.col("event_id") % lines).cast("int").alias("j"),
        "value",
    )
    index = F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))
    slots = placed.groupBy("t").agg(F.avg("value").alias("_mean"))
    frame = slots.select("t", "_mean", index.alias("i")).select("*", index.alias("j"))
    cells = placed.groupBy("t", "i", "j").agg(F.avg("value").alias("_value"))
    return frame.join(cells, ["t", "i", "j"], "left").select("t", "i", "j", F.coalesce("_value", "_mean").alias("v"))


RUN_LEADS = [24, 48, 72]


def weather(spark: SparkSession, d: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Landing tables made of events below ``root``: two-member runs at 0 and 12 h, and an analysis on lines between theirs."""
    v, lead, one = F.col("v"), F.col("lead_hours"), F.lit(None).cast("int")
    entry = lambda name, level, value, units: F.struct(
        F.lit(name).alias("variable"), level.alias("level_hpa"), value.alias("value"), F.lit(units).alias("units")
    )
    forecast = [
        entry("mean_sea_level_pressure", one, 100000 + 10 * v + lead, "Pa"),
        entry("2m_temperature", one, 280 + v / 10, "K"),
        entry("10m_u_component_of_wind", one, v / 7 - 3, "m s**-1"),
        entry("10m_v_component_of_wind", one, v / 9 + lead / 24, "m s**-1"),
        entry("u_component_of_wind", F.lit(850), v / 5, "m s**-1"),
        entry("v_component_of_wind", F.lit(850), v / 6 - lead / 12, "m s**-1"),
        entry("geopotential", F.lit(500), 54000 + 20 * v, "m**2 s**-2"),
        entry("geopotential", F.lit(850), 14000 + 10 * v, "m**2 s**-2"),
        entry("total_precipitation_24hr", one, v / 10000, None),
    ]
    analysis = [
        entry("mean_sea_level_pressure", one, 100000 + 10 * v, "Pa"),
        entry("2m_temperature", one, 280 + v / 10, "K"),
        entry("10m_u_component_of_wind", one, v / 7 - 3, "m s**-1"),
        entry("10m_v_component_of_wind", one, v / 9, "m s**-1"),
        entry("total_precipitation_6hr", one, v / 40, "mm"),
    ]
    place = [(6 + 1.5 * F.col("i")).alias("latitude"), (68 + 1.5 * F.col("j")).alias("longitude")]
    between = [(5.25 + 1.5 * F.col("i")).alias("latitude"), (67.25 + 1.5 * F.col("j")).alias("longitude")]
    each = lambda values: F.explode(F.array(*[F.lit(x) for x in values]))
    leads = sorted({*RUN_LEADS, *[x + C.RUN_LAG_HOURS for x in RUN_LEADS]})
    runs = event_field(spark, d, 5).filter(F.hour("t").isin(0, 12))
    runs = runs.select(F.col("t").alias("init_time"), *place, "v", each(leads).alias("lead_hours")).select("*", each([0, 1]).alias("number"))
    runs = runs.select("init_time", "lead_hours", "number", "latitude", "longitude", F.inline(F.array(*forecast)))
    runs = runs.withColumn("value", F.col("value") * (1 + F.col("number") * 0.0131071))
    truth = event_field(spark, d, 6).select(F.col("t").alias("valid_time"), *between, F.inline(F.array(*analysis)))
    write_landing(runs, f"{root}/forecast", "init_time")
    write_landing(truth, f"{root}/analysis", "valid_time")
    return spark.read.parquet(f"{root}/forecast"), spark.read.parquet(f"{root}/analysis")


def even_axes(spark: SparkSession, low: tuple[float, float], lines: int) -> tuple[DataFrame, DataFrame]:
    """Latitude and longitude lines 1.5 degrees apart."""
    axis_of = lambda start: spark.range(lines).select(F.col("id").cast("int").alias("idx"), (F.lit(start) + 1.5 * F.col("id")).alias("value"))
    return axis_of(low[0]), axis_of(low[1])


def weather_weights(spark: SparkSession, d: str) -> DataFrame:
    """The regions' shares in the cells of the runs, by area; a cell belongs to region (i + j) % 5."""
    cells = spark.range(25).select((F.col("id") % 5).cast("int").alias("lat_i"), F.expr("CAST(id DIV 5 AS INT)").alias("lon_i"))
    latitude = 6 + 1.5 * F.col("lat_i")
    band = F.sin(F.radians(latitude + 0.75)) - F.sin(F.radians(latitude - 0.75))
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))
    areas = cells.withColumns({"region_id": (F.col("lat_i") + F.col("lon_i")) % 5, "area_m2": band}).join(region, "region_id")
    return normalized_weights(areas)


def orders_as_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as predictions: region = customer nation, lead = order mod 10 + 1, start = order day."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    lead = (F.col("o_orderkey") % 10 + 1).cast("int")
    return joined.select(
        "o_orderkey",
        F.format_string("imd-%02d", F.col("c_nationkey") + 1).alias("region_id"),
        lead.alias("lead_day"),
        F.col("o_orderdate").alias("forecast_initialization_time"),
        (F.col("o_orderdate") + F.make_dt_interval(lead)).alias("valid_time"),
        (F.col("o_totalprice") / F.lit(500000.0)).alias("bust_probability"),
        F.col("c_mktsegment").alias("region_name"),
    )


def risk_rows(spark: SparkSession, d: str) -> DataFrame:
    """One prediction per (run month, lead, region): mean order value as probability."""
    orders = orders_as_predictions(spark, d)
    t = "forecast_initialization_time"
    month = F.expr(f"make_timestamp_ntz(year({t}), month({t}), 1, 0, 0, 0)")
    return (
        orders.withColumn("forecast_initialization_time", month)
        .groupBy("forecast_initialization_time", "lead_day", "region_id")
        .agg(F.round(F.avg("bust_probability"), 12).alias("bust_probability"))
        .withColumn("valid_time", F.col("forecast_initialization_time") + F.make_dt_interval(F.col("lead_day")))
    )


def full_risk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Risks of every month, lead and nation; a pair without orders has its nation's mean.

    One nation misses the leads that add up with the month to a multiple of seven, so that some groups stay incomplete.
    """
    t = "forecast_initialization_time"
    risks, orders = risk_rows(spark, d).drop("valid_time"), orders_as_predictions(spark, d)
    nation = table(spark, d, "nation").select(F.format_string("imd-%02d", F.col("n_nationkey") + 1).alias("region_id"))
    mean = orders.groupBy("region_id").agg(F.avg("bust_probability").alias("_mean"))
    overall = orders.agg(F.avg("bust_probability")).scalar()
    means = nation.join(mean, "region_id", "left").select(
        F.struct("region_id", F.round(F.coalesce("_mean", overall), 12).alias("_mean")).alias("_entry")
    )
    # One entry per nation.
    frame = risks.select(t).distinct().withColumn("_nations", means.agg(F.collect_list("_entry")).scalar())
    frame = frame.select(t, F.inline("_nations")).select("*", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("lead_day"))
    hole = (F.col("region_id") == "imd-03") & ((F.col("lead_day") + F.month(t)) % 7 == 0)
    filled = frame.filter(~hole).join(risks, [t, "lead_day", "region_id"], "left")
    return filled.select(
        t,
        "lead_day",
        "region_id",
        F.coalesce("bust_probability", "_mean").alias("bust_probability"),
        (F.col(t) + F.make_dt_interval(F.col("lead_day"))).alias("valid_time"),
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Statements to check: two claims made from each order, and every document as it is."""
    orders, documents = table(spark, d, "orders"), table(spark, d, "documents")
    k = F.col("o_orderkey")
    claim = F.concat(
        F.lit("The bust probability is "), (k % 101).cast("string"), F.lit("% and the reliability 0."),
        F.lpad((k * 3 % 1000).cast("string"), 3, "0"), F.lit(" today."),
        F.when(k % 7 == 0, " A Cyclone will form.").otherwise(""),
    )
    made = orders.select(
        F.concat(F.lit("o"), k.cast("string")).alias("answer_id"), claim.alias("answer"), ((k % 101) / F.lit(100.0)).alias("p")
    )
    whole = documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("answer_id"), F.col("text").alias("answer"),
        ((F.col("doc_id") % 1000) / F.lit(1000.0)).alias("p"),
    )
    return made.unionByName(whole)


MODEL_FEATURES = ["l_quantity", "l_extendedprice", "discount", "tax", "lead_number"]


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled order lines as unique (region, lead, day) rows with a split, ready for the risk model.

    Only columns that are not part of the label are features here.
    """
    rows = labelled(spark, d)
    rows = with_split(rows, F.col("yr"), TRAIN, VALIDATION, TEST_YEARS).withColumnRenamed("split", "_split")
    grouped = rows.groupBy("region_id", "lead_day", "forecast_initialization_time", F.col("_split").alias("split")).agg(
        F.max("bust").alias("bust"),
        F.avg("severity").alias("severity"),
        F.avg("l_quantity").alias("l_quantity"),
        F.avg("l_extendedprice").alias("l_extendedprice"),
        F.avg("e_wind_mps").alias("discount"),
        F.avg("e_temperature_k").alias("tax"),
        *[F.avg(c).alias(c) for c in C.ERROR_COLUMNS],
    )
    return grouped.withColumns(
        {
            "lead_number": F.col("lead_day").cast("double"),
            "valid_time": F.col("forecast_initialization_time") + F.make_dt_interval(F.col("lead_day")),
            "region_name": F.concat(F.lit("nation "), F.col("region_id")),
            "dataset_version": F.lit("order-lines-v1"),
        }
    )
