"""Names, schemas and fixed parameters of the risk-evidence data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Physical constants and tolerances.
GRAVITY = 9.80665
EARTH_RADIUS_M = 6371008.8
GRID_TOLERANCE_DEG = 1e-6
WEIGHT_SUM_TOLERANCE = 1e-8

# Forecast geometry, domain and season.
LEAD_HOURS = [24, 48, 72, 96, 120, 144, 168, 192, 216, 240]
LEAD_DAYS = len(LEAD_HOURS)
REGION_COUNT = 36
ROWS_PER_CYCLE = REGION_COUNT * LEAD_DAYS
CYCLE_HOURS = [0, 12]
SEASON_MONTHS = [6, 7, 8, 9]
LATITUDE_RANGE = (6.0, 38.0)
LONGITUDE_RANGE = (68.0, 98.0)
PRECIP_STEP_OFFSETS_H = [18, 12, 6, 0]
RUN_LAG_HOURS = 12
SEASON_PERIOD_DAYS = 366
PRESSURE_LEVELS = [500, 850]
MEMBER_COUNT = 50

# Temporal split.
TRAIN_YEARS = [2018, 2019, 2020]
VALIDATION_YEAR = 2021
TEST_YEAR = 2022

# Label definition.
MIN_GROUP_SAMPLES = 30
MAD_SCALE = 1.4826
Z_EPSILON = 1e-6
Z_LIMIT = 8.0
THRESHOLD_QUANTILE = 0.85
COMPONENT_COLUMNS = {
    "precip": "e_precip_mm",
    "mslp": "e_mslp_pa",
    "wind": "e_wind_mps",
    "temperature": "e_temperature_k",
}
COMPONENT_WEIGHTS = {"precip": 0.40, "mslp": 0.20, "wind": 0.20, "temperature": 0.20}

# Evaluation and calibration.
CALIBRATION_BINS = 10
TOP_RISK_QUANTILE = 0.8
PROBABILITY_FLOOR = 1e-7
REPLAY_TOLERANCE = 1e-9

# Units accepted per source variable (an empty list means any unit).
FORECAST_UNITS = {
    "mean_sea_level_pressure": ["Pa"],
    "2m_temperature": ["K"],
    "10m_u_component_of_wind": ["m s**-1"],
    "10m_v_component_of_wind": ["m s**-1"],
    "u_component_of_wind": ["m s**-1"],
    "v_component_of_wind": ["m s**-1"],
    "geopotential": ["m**2 s**-2"],
    "total_precipitation": ["m"],
    "total_precipitation_24hr": [],
}
ANALYSIS_UNITS = {
    "mean_sea_level_pressure": ["Pa"],
    "2m_temperature": ["K"],
    "10m_u_component_of_wind": ["m s**-1"],
    "10m_v_component_of_wind": ["m s**-1"],
    "total_precipitation_6hr": ["m"],
}

# Model features with display name and unit.
FEATURE_CATALOG = {
    "region_id": ("Region", None),
    "lead_day": ("Forecast Lead", "day"),
    "mslp_gradient_pa_per_km": ("MSLP Gradient", "Pa/km"),
    "mslp_mean_pa": ("Mean Sea-Level Pressure", "Pa"),
    "precip24_mean_mm": ("24-hour Precipitation", "mm"),
    "run_to_run_mslp_drift_pa": ("Run-to-run MSLP Drift", "Pa"),
    "season_cos": ("Season Cosine", None),
    "season_sin": ("Season Sine", None),
    "temperature2m_mean_k": ("2 m Temperature", "K"),
    "thickness500_850_m": ("500–850 hPa Thickness", "m"),
    "u10_mean_mps": ("10 m Zonal Wind", "m/s"),
    "v10_mean_mps": ("10 m Meridional Wind", "m/s"),
    "vorticity850_s1": ("850 hPa Relative Vorticity", "s^-1"),
    "wind10_mean_mps": ("10 m Wind Speed", "m/s"),
    "wind850_mean_mps": ("850 hPa Wind Speed", "m/s"),
}
NUMERIC_FEATURES = [name for name in FEATURE_CATALOG if name != "region_id"]
FORECAST_FEATURES = [name for name in NUMERIC_FEATURES if name != "lead_day"]
ERROR_COLUMNS = list(COMPONENT_COLUMNS.values())
SPREAD_COLUMNS = [
    "mslp_spread_pa",
    "temperature2m_spread_k",
    "u10_spread_mps",
    "v10_spread_mps",
    "precip24_spread_mm",
]
TARGET_COLUMNS = ERROR_COLUMNS + ["severity", "threshold", "bust"] + [f"z_{name}" for name in COMPONENT_COLUMNS]
TARGET_PREFIXES = ["analysis_", "verification_", "e_", "z_"]
CYCLE_KEYS = ["forecast_initialization_time", "lead_day", "region_id"]
PREDICTION_KEYS = ["region_id", "lead_day", "forecast_initialization_time", "valid_time"]

# Features summarised for each historical analog.
ANALOG_COUNT = 3
ANALOG_FEATURES = ["mslp_mean_pa", "precip24_mean_mm", "run_to_run_mslp_drift_pa", "wind10_mean_mps"]

# Boosted-tree settings tried on the validation year.
TREE_CANDIDATES = [
    {"maxDepth": 3, "stepSize": 0.05, "maxIter": 250, "minInstancesPerNode": 5, "subsamplingRate": 0.8},
    {"maxDepth": 5, "stepSize": 0.05, "maxIter": 300, "minInstancesPerNode": 5, "subsamplingRate": 0.8},
    {"maxDepth": 4, "stepSize": 0.08, "maxIter": 200, "minInstancesPerNode": 10, "subsamplingRate": 0.9},
    {"maxDepth": 6, "stepSize": 0.04, "maxIter": 350, "minInstancesPerNode": 10, "subsamplingRate": 0.8},
]
RANDOM_STATE = 26079


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


FORECAST_GRID = T.StructType(
    [
        T.StructField("init_time", T.TimestampNTZType()),
        T.StructField("lead_hours", T.IntegerType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("level_hpa", T.IntegerType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("variable", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
ANALYSIS_GRID = T.StructType(
    [
        T.StructField("valid_time", T.TimestampNTZType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("variable", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
DERIVED_ROW = T.StructType(
    _fields(["region_id", "region_name", "dataset_version", "region_id_semantics"], T.StringType())
    + _fields(["forecast_initialization_time", "feature_source_time", "valid_time"], T.TimestampNTZType())
    + _fields(["lead_day"], T.IntegerType())
    + _fields(FORECAST_FEATURES + ERROR_COLUMNS, T.DoubleType())
)
