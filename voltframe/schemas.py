"""Row types, allowed values and market metadata."""

from __future__ import annotations

from pyspark.sql import types as T

# Contract vocabulary and units per event type.
EVENT_TYPES = ("demand", "generation", "price", "weather")
QUALITY_STATUSES = ("valid", "missing", "estimated", "invalid")
UNITS = {
    "demand": ("MW",),
    "generation": ("MW",),
    "price": ("EUR/MWh",),
    "weather": ("degC", "m/s", "%", "W/m2"),
}
SCHEMA_VERSION = "1.0"

# Message topics.
TOPICS = {
    "demand": "grid.demand.v1",
    "generation": "grid.generation.v1",
    "price": "market.prices.v1",
    "weather": "weather.forecasts.v1",
}
DEAD_LETTER_TOPIC = "energy.dead-letter.v1"
TOPIC_PATTERN = r"grid\..*|market\..*|weather\..*|energy\..*"

# Weather dimensions and their units.
WEATHER_UNITS = {
    "temperature_2m": "degC",
    "wind_speed_10m": "m/s",
    "relative_humidity_2m": "%",
    "shortwave_radiation": "W/m2",
}
WEATHER_DIMENSIONS = tuple(WEATHER_UNITS)

# Market country to time zone.
MARKET_TIMEZONES = {
    "AL": "Europe/Tirane",
    "AT": "Europe/Vienna",
    "BA": "Europe/Sarajevo",
    "BE": "Europe/Brussels",
    "BG": "Europe/Sofia",
    "CH": "Europe/Zurich",
    "CY": "Asia/Nicosia",
    "CZ": "Europe/Prague",
    "DE": "Europe/Berlin",
    "DK": "Europe/Copenhagen",
    "EE": "Europe/Tallinn",
    "ES": "Europe/Madrid",
    "FI": "Europe/Helsinki",
    "FR": "Europe/Paris",
    "GB": "Europe/London",
    "GR": "Europe/Athens",
    "HR": "Europe/Zagreb",
    "HU": "Europe/Budapest",
    "IE": "Europe/Dublin",
    "IT": "Europe/Rome",
    "LT": "Europe/Vilnius",
    "LU": "Europe/Luxembourg",
    "LV": "Europe/Riga",
    "ME": "Europe/Podgorica",
    "MK": "Europe/Skopje",
    "NL": "Europe/Amsterdam",
    "NO": "Europe/Oslo",
    "PL": "Europe/Warsaw",
    "PT": "Europe/Lisbon",
    "RO": "Europe/Bucharest",
    "RS": "Europe/Belgrade",
    "SE": "Europe/Stockholm",
    "SI": "Europe/Ljubljana",
    "SK": "Europe/Bratislava",
    "XK": "Europe/Belgrade",
}
DELIVERY_TIMEZONE = "Europe/Madrid"

# National holidays with a fixed date (month, day), only used for ES.
FIXED_HOLIDAYS = (
    (1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25),
)

# Weather stations and their weight in the regional mean.
STATIONS = (
    ("madrid", 40.4168, -3.7038, 0.30),
    ("barcelona", 41.3874, 2.1686, 0.24),
    ("valencia", 39.4699, -0.3763, 0.17),
    ("seville", 37.3891, -5.9845, 0.16),
    ("bilbao", 43.2630, -2.9350, 0.13),
)
STATION_SCHEMA = "station string, latitude double, longitude double, weight double"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("area", T.StringType()),
        T.StructField("interval_start", T.TimestampType()),
        T.StructField("interval_end", T.TimestampType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("revision", T.IntegerType()),
        T.StructField("quality_status", T.StringType()),
        T.StructField("dimension", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("request_params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload_checksum", T.StringType()),
    ]
)
EVENT_COLUMNS = tuple(f.name for f in EVENT_SCHEMA)
# Columns kept once an event is curated (request details stay in bronze).
SILVER_COLUMNS = tuple(c for c in EVENT_COLUMNS if c not in ("source_url", "request_params"))

BRONZE_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("kafka_timestamp", T.TimestampType()),
        T.StructField("key", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

FORECAST_SCHEMA = T.StructType(
    [
        T.StructField("forecast_id", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("area", T.StringType()),
        T.StructField("issue_time", T.TimestampType()),
        T.StructField("valid_from", T.TimestampType()),
        T.StructField("valid_to", T.TimestampType()),
        T.StructField("point", T.DoubleType()),
        T.StructField("p10", T.DoubleType()),
        T.StructField("p50", T.DoubleType()),
        T.StructField("p90", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("data_snapshot_id", T.StringType()),
        T.StructField("quality_flags", T.ArrayType(T.StringType())),
        T.StructField("is_shadow", T.BooleanType()),
    ]
)
FORECAST_KEY = ("target", "area", "issue_time", "valid_from", "model_version", "is_shadow")

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("input_checksum", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("before_snapshot_id", T.StringType()),
        T.StructField("after_snapshot_id", T.StringType()),
        T.StructField("completed_at", T.TimestampType()),
    ]
)


def unit_for_target(target: str) -> str:
    return UNITS["price" if target == "price" else "demand"][0]
