"""Declared tables: names, types and keys of every input.

Unsigned source integers are held in the next wider signed Spark type; narrow
floats are read as declared and computed on in double.
"""

from pyspark.sql import types as T

# --- fixed values: column names and widths that inputs and outputs must carry ---

SERIES_KEYS = ["county", "is_business", "product_type", "is_consumption"]

FORECAST_VARIABLES = [
    "temperature",
    "dewpoint",
    "cloudcover_high",
    "cloudcover_low",
    "cloudcover_mid",
    "cloudcover_total",
    "10_metre_u_wind_component",
    "10_metre_v_wind_component",
    "direct_solar_radiation",
    "surface_solar_radiation_downwards",
    "snowfall",
    "total_precipitation",
]

HISTORY_VARIABLES = [
    "temperature",
    "dewpoint",
    "rain",
    "snowfall",
    "surface_pressure",
    "cloudcover_total",
    "cloudcover_low",
    "cloudcover_mid",
    "cloudcover_high",
    "windspeed_10m",
    "winddirection_10m",
    "shortwave_radiation",
    "direct_solar_radiation",
    "diffuse_radiation",
]

# history variables whose daily mean is stored as a whole number (truncated)
HISTORY_WHOLE_NUMBERS = {
    "cloudcover_total": "short",
    "cloudcover_low": "short",
    "cloudcover_mid": "short",
    "cloudcover_high": "short",
    "winddirection_10m": "int",
    "shortwave_radiation": "int",
    "direct_solar_radiation": "int",
    "diffuse_radiation": "int",
}

LEAD_HOURS = (22, 45)

# --- end of fixed values ---


_TYPES = {
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "boolean": T.BooleanType(),
}


def table_schema(**columns: str) -> T.StructType:
    """StructType from ``name="short"`` pairs; timestamps carry no zone."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in columns.items()])


SCHEMAS = {
    "train": table_schema(
        county="short", is_business="short", product_type="short", target="double",
        is_consumption="short", datetime="timestamp", row_id="long",
    ),
    "target": table_schema(
        target="double", county="short", is_business="short", product_type="short",
        is_consumption="short", datetime="timestamp",
    ),
    "test": table_schema(
        county="short", is_business="short", product_type="short",
        is_consumption="short", datetime="timestamp", row_id="long",
    ),
    "client": table_schema(
        product_type="short", county="short", eic_count="int",
        installed_capacity="float", is_business="short", date="date",
    ),
    "electricity": table_schema(forecast_date="timestamp", euros_per_mwh="float"),
    "gas": table_schema(
        forecast_date="timestamp", lowest_price_per_mwh="float",
        highest_price_per_mwh="float",
    ),
    "forecast_weather": table_schema(**{
        "latitude": "float", "longitude": "float", "hours_ahead": "short",
        **{v: "float" if v in ("temperature", "dewpoint") else "double"
           for v in FORECAST_VARIABLES},
        "origin_datetime": "timestamp",
    }),
    "historical_weather": table_schema(**{
        "datetime": "timestamp",
        **{v: HISTORY_WHOLE_NUMBERS.get(v, "float") for v in HISTORY_VARIABLES},
        "latitude": "float", "longitude": "float",
    }),
    "location": table_schema(longitude="float", latitude="float", county="short"),
}

# the columns that identify one row of each table
TABLE_KEYS = {
    "train": [*SERIES_KEYS, "datetime"],
    "target": [*SERIES_KEYS, "datetime"],
    "test": ["row_id"],
    "client": ["date", "county", "is_business", "product_type"],
    "gas": ["forecast_date"],
    "electricity": ["forecast_date"],
    "forecast_weather": ["origin_datetime", "latitude", "longitude", "hours_ahead"],
    "historical_weather": ["datetime", "latitude", "longitude"],
    "location": ["latitude", "longitude"],
}

# the column a bounded look-back filters on
TABLE_TIME = {
    "target": "datetime",
    "client": "date",
    "gas": "forecast_date",
    "electricity": "forecast_date",
    "forecast_weather": "origin_datetime",
    "historical_weather": "datetime",
}

# live batches name the instant to forecast differently
BATCH_RENAMES = {"prediction_datetime": "datetime"}
