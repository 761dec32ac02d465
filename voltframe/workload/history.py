"""Queries over market history, payload documents and time-grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltframe.functions import hashing, timegrid
from voltframe.operators import series
from voltframe.operators.features import series_gaps
from voltframe.schemas import FIXED_HOLIDAYS, STATIONS, WEATHER_DIMENSIONS
from voltframe.sources import history, payloads
from voltframe.workload.registry import register
from voltframe.workload.tables import AREA, HISTORY, SERIES, SERIES_KEYS, TYPED

LOCAL = "(ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid'"
ZONE_KEYS = ("country_code", "zone_key")


@register(
    "scan_filtered",
    f"""WITH {HISTORY} SELECT timestamp_utc, country_code, zone_key, load, revision_number, record_id FROM history
    WHERE timestamp_utc >= TIMESTAMP '1996-01-01' AND timestamp_utc <= TIMESTAMP '1998-12-31 23:59:59'
    QUALIFY row_number() OVER (PARTITION BY country_code, zone_key, timestamp_utc
      ORDER BY revision_number DESC, record_id DESC) = 1""",
)
def scan_filtered(t):
    """Time-bounded scan with pushed-down bounds, newest revision per zone and time stamp."""
    rows = history.load_raw_table(t.history, start_year=1996, end_year=1998)
    return rows.select("timestamp_utc", *ZONE_KEYS, "load", "revision_number", "record_id")


@register(
    "latest_revision",
    f"WITH {HISTORY} SELECT country_code, zone_key, timestamp_utc, load, revision_number, record_id FROM newest",
)
def latest_revision(t):
    rows = series.latest_revision(
        t.history, [*ZONE_KEYS, "timestamp_utc"], "revision_number", ["record_id"]
    )
    return rows.select(*ZONE_KEYS, "timestamp_utc", "load", "revision_number", "record_id")


UUID5 = """lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""


@register(
    "as_events",
    f"""WITH {HISTORY}, hashed AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') ||
        encode('entsoe-hist-' || CAST(record_id AS VARCHAR))) AS h FROM newest)
    SELECT {UUID5} AS event_id, zone_key AS area, timestamp_utc AS interval_start,
      timestamp_utc + to_minutes(CASE resolution WHEN 'PT60M' THEN 60 WHEN 'PT30M' THEN 30 ELSE 15 END) AS interval_end,
      load AS value, CASE WHEN revision_number = 0 THEN 1 ELSE revision_number END AS revision,
      CASE WHEN load IS NULL THEN 'missing' ELSE 'valid' END AS quality_status,
      CAST(record_id AS VARCHAR) AS payload_checksum FROM hashed""",
)
def as_events(t):
    """History rows as canonical events with name-based UUIDs."""
    events = history.load_as_events(t.history, "demand")
    return events.select(
        "event_id", "area", "interval_start", "interval_end", "value", "revision", "quality_status", "payload_checksum"
    )


@register("list_zones", f"WITH {HISTORY} SELECT DISTINCT country_code, zone_key, zone_name FROM history")
def list_zones(t):
    return history.list_zones(t.history)


@register(
    "ambiguous_zones",
    f"""WITH {HISTORY} SELECT country_code, count(DISTINCT zone_key) AS zones FROM history GROUP BY 1
    HAVING count(DISTINCT zone_key) > 1""",
)
def ambiguous_zones(t):
    return history.ambiguous_zones(t.history)


@register(
    "series_summary",
    f"""WITH {HISTORY} SELECT country_code, zone_key, count(*) AS total_records, min(timestamp_utc) AS start_time,
      max(timestamp_utc) AS end_time, min(load) AS min_value, max(load) AS max_value, avg(load) AS mean_value,
      'actual_load' AS dataset_type, 'MW' AS unit FROM newest GROUP BY 1, 2""",
    digits=8,
    doubles="min_value max_value mean_value",
)
def series_summary(t):
    return history.summarize(t.history, "demand")


# --- payload documents -----------------------------------------------------------------------

STATION_WEIGHTS = ", ".join(f"('{s}', {w})" for s, _, _, w in STATIONS)
STATION_OF = "CASE event_type WHEN 'click' THEN 'madrid' WHEN 'view' THEN 'barcelona' WHEN 'purchase' THEN 'valencia' WHEN 'signup' THEN 'seville' ELSE 'bilbao' END"


def station_documents(t):
    """One hourly document per station and day, as the weather service would send it."""
    station = (
        F.when(F.col("event_type") == "click", "madrid")
        .when(F.col("event_type") == "view", "barcelona")
        .when(F.col("event_type") == "purchase", "valencia")
        .when(F.col("event_type") == "signup", "seville")
        .otherwise("bilbao")
    )
    hour = timegrid.floor_to(F.col("ts"), 3600)
    mean = F.round(F.sum("value"), 2) / F.count("value")
    hourly = t.events.groupBy(station.alias("station"), hour.alias("hour")).agg(
        mean.alias("m"), F.count(F.lit(1)).alias("n")
    )
    # Readings: four variables per hour; humidity is missing when the hour's event count is even.
    fields = [
        F.date_format("hour", "yyyy-MM-dd'T'HH:mm").alias("time"),
        F.col("m").alias("temperature_2m"),
        (F.col("m") * 0.5).alias("wind_speed_10m"),
        F.when(F.col("n") % 2 == 1, F.col("m") + 1.0).alias("relative_humidity_2m"),
        (F.col("m") * 10.0).alias("shortwave_radiation"),
    ]
    # A document holds one day of one station: at most 24 entries.
    days = hourly.groupBy("station", F.to_date("hour").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("h")
    )
    arrays = [F.col("h")["time"].alias("time"), *[F.col("h")[d].alias(d) for d in WEATHER_DIMENSIONS]]
    document = F.to_json(F.struct(F.struct(*arrays).alias("hourly")), {"ignoreNullFields": "false"})
    return days.select("station", document.alias("payload"))


@register(
    "weather_weighted",
    f"""WITH weights(station, w) AS (VALUES {STATION_WEIGHTS}),
    hourly AS (SELECT {STATION_OF} AS station, date_trunc('hour', ts) AS valid_time, round(sum(value), 2) / count(value) AS m,
      count(*) AS n FROM events GROUP BY 1, 2),
    readings AS (SELECT station, valid_time, unnest(['temperature_2m', 'wind_speed_10m', 'relative_humidity_2m',
      'shortwave_radiation']) AS dimension, unnest([m, m * 0.5, CASE WHEN n % 2 = 1 THEN m + 1.0 END, m * 10.0]) AS value FROM hourly)
    SELECT valid_time, dimension, sum(value * CAST(w AS DOUBLE)) AS value, sum(CAST(w AS DOUBLE)) AS weight_sum
    FROM readings JOIN weights USING (station) WHERE value IS NOT NULL GROUP BY 1, 2""",
    digits=9,
    doubles="value weight_sum",
)
def weather_weighted(t):
    """Station JSON to regional weather: explode, unpivot, weight."""
    return payloads.regional_weather(payloads.station_readings(station_documents(t)))


@register(
    "xml_points",
    """WITH docs AS (SELECT event_id AS document_id, date_trunc('hour', ts) AS s, value,
        CASE event_id % 4 WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 60 END AS mins, event_type FROM events),
      points AS (SELECT *, unnest([1, 2, 4]) AS position FROM docs WHERE mins IS NOT NULL)
    SELECT document_id, CASE WHEN event_type = 'view' THEN 'B16' END AS dimension, CAST(position AS INTEGER) AS position,
      s + to_minutes(mins * (position - 1)) AS interval_start, s + to_minutes(mins * position) AS interval_end,
      value + position AS value FROM points""",
    doubles="value",
)
def xml_points(t):
    """Market XML: series, periods and points; unknown resolutions and empty points are skipped."""
    resolution = F.element_at(
        F.array(*[F.lit(r) for r in ("PT15M", "PT30M", "PT60M", "P1D")]), (F.col("event_id") % 4 + 1).cast("int")
    )
    start = F.date_format(timegrid.floor_to(F.col("ts"), 3600), "yyyy-MM-dd'T'HH:mm'Z'")
    psr = F.when(F.col("event_type") == "view", F.lit("<MktPSRType><psrType>B16</psrType></MktPSRType>")).otherwise("")

    def point(position: int, tag: str) -> list:
        return [
            F.lit(f"<Point><position>{position}</position><{tag}>"),
            (F.col("value") + position).cast("string"),
            F.lit(f"</{tag}></Point>"),
        ]

    document = F.concat(
        F.lit('<Publication_MarketDocument xmlns="urn:market:publication"><TimeSeries>'), psr,
        F.lit("<Period><timeInterval><start>"), start, F.lit("</start></timeInterval><resolution>"), resolution,
        F.lit("</resolution>"), *point(1, "quantity"), *point(2, "price.amount"),
        F.lit("<Point><position>3</position></Point>"), *point(4, "quantity"),
        F.lit("</Period></TimeSeries></Publication_MarketDocument>"),
    )
    docs = t.events.select(F.col("event_id").alias("document_id"), document.alias("payload"))
    return payloads.market_points(docs).drop("payload_checksum")


# --- time grid -------------------------------------------------------------------------------

HOLIDAYS = ", ".join(str(m * 100 + d) for m, d in FIXED_HOLIDAYS)
CALENDAR_SQL = f"""WITH stamped AS (SELECT event_id, {LOCAL} AS l FROM events
    UNION ALL SELECT -1 - o_orderkey, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' FROM orders),
  parts AS (SELECT event_id, CAST(hour(l) AS INTEGER) AS hour, CAST(minute(l) // 15 AS INTEGER) AS quarter,
    CAST(isodow(l) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(l) AS INTEGER) AS day_of_year,
    CAST(month(l) AS INTEGER) AS month, CAST(isodow(l) >= 6 AS INTEGER) AS is_weekend,
    CAST(month(l) * 100 + day(l) IN ({HOLIDAYS}) AS INTEGER) AS is_holiday FROM stamped)
  SELECT *, CAST(hour BETWEEN 8 AND 11 AS INTEGER) AS is_morning_peak, CAST(hour BETWEEN 19 AND 22 AS INTEGER) AS is_evening_peak,
    sin(2 * pi() * hour / 24.0) AS sin_hour, cos(2 * pi() * hour / 24.0) AS cos_hour,
    sin(2 * pi() * day_of_week / 7.0) AS sin_day_of_week, cos(2 * pi() * day_of_week / 7.0) AS cos_day_of_week,
    sin(2 * pi() * day_of_year / 365.25) AS sin_day_of_year, cos(2 * pi() * day_of_year / 365.25) AS cos_day_of_year FROM parts"""


def stamps(t):
    """All event and order time stamps with an id (orders count down from -1)."""
    return t.events.select("event_id", "ts").unionByName(
        t.orders.select((-1 - F.col("o_orderkey")).alias("event_id"), F.col("o_orderdate").alias("ts"))
    )


@register(
    "calendar_features", CALENDAR_SQL,
    doubles="sin_hour cos_hour sin_day_of_week cos_day_of_week sin_day_of_year cos_day_of_year",
)
def calendar_features(t):
    return timegrid.calendar_features(stamps(t), "ts").drop("ts")


@register(
    "local_delivery",
    f"""WITH zones AS (SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'Europe/Madrid' WHEN 1 THEN 'Europe/Lisbon'
        ELSE 'Asia/Nicosia' END AS zone FROM events)
    SELECT event_id, zone, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE zone AS DATE) AS delivery_date,
      CAST(date_diff('minute', ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE zone) AS INTEGER) AS offset_minutes FROM zones""",
)
def local_delivery(t):
    """Local delivery date and UTC offset with a time zone per row's market."""
    country = F.element_at(F.array(F.lit("ES"), F.lit("pt"), F.lit("CY")), (F.col("user_id") % 3 + 1).cast("int"))
    zone = timegrid.market_timezone_column(country)
    zoned = t.events.select("event_id", "ts", zone.alias("zone"))
    return zoned.select(
        "event_id", "zone",
        timegrid.local_delivery_date(F.col("ts"), F.col("zone")).alias("delivery_date"),
        timegrid.offset_minutes(F.col("ts"), F.col("zone")).alias("offset_minutes"),
    )


@register(
    "delivery_intervals",
    """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS delivery_date FROM orders),
    bounds AS (SELECT delivery_date, (CAST(delivery_date AS TIMESTAMP) AT TIME ZONE 'Europe/Madrid') AT TIME ZONE 'UTC' AS lo,
      (CAST(delivery_date + 1 AS TIMESTAMP) AT TIME ZONE 'Europe/Madrid') AT TIME ZONE 'UTC' AS hi FROM days),
    starts AS (SELECT delivery_date, lo, unnest(range(lo, hi, INTERVAL 15 MINUTE)) AS valid_from FROM bounds)
    SELECT delivery_date, CAST(date_diff('minute', lo, valid_from) // 15 + 1 AS INTEGER) AS interval_number, valid_from,
      valid_from + INTERVAL 15 MINUTE AS valid_to FROM starts""",
)
def delivery_intervals(t):
    """All quarter hours of every local day: 96, or 92 and 100 when clocks change."""
    days = t.orders.select(F.to_date("o_orderdate").alias("delivery_date")).distinct()
    return timegrid.explode_delivery_day(days, "delivery_date")


@register(
    "interval_number",
    f"""WITH quarters AS (SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS q FROM events),
    local AS (SELECT *, (date_trunc('day', (q AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid') AT TIME ZONE 'Europe/Madrid')
      AT TIME ZONE 'UTC' AS midnight FROM quarters)
    SELECT event_id, CAST(date_diff('minute', midnight, q) // 15 + 1 AS INTEGER) AS interval_number FROM local""",
)
def interval_number(t):
    quarter = timegrid.floor_quarter_hour(F.col("ts"))
    return t.events.select("event_id", timegrid.interval_number(quarter).alias("interval_number"))


@register("floor_quarter_hour", "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter FROM events")
def floor_quarter_hour(t):
    return t.events.select("event_id", timegrid.floor_quarter_hour(F.col("ts")).alias("quarter"))


@register(
    "forecast_intervals",
    """WITH issues AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS issue_time FROM events),
    demand AS (SELECT 'demand' AS target, issue_time, unnest(range(1, 25)) AS horizon_step FROM issues),
    nextday AS (SELECT issue_time, CAST((issue_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS DATE) + 1 AS d FROM issues),
    price AS (SELECT 'price' AS target, issue_time, unnest(range((CAST(d AS TIMESTAMP) AT TIME ZONE 'Europe/Madrid') AT TIME ZONE 'UTC',
      (CAST(d + 1 AS TIMESTAMP) AT TIME ZONE 'Europe/Madrid') AT TIME ZONE 'UTC', INTERVAL 15 MINUTE)) AS valid_from FROM nextday)
    SELECT target, issue_time, CAST(horizon_step AS INTEGER) AS horizon_step, issue_time + to_minutes(15 * horizon_step) AS valid_from,
      issue_time + to_minutes(15 * (horizon_step + 1)) AS valid_to FROM demand
    UNION ALL SELECT target, issue_time, CAST(row_number() OVER (PARTITION BY issue_time ORDER BY valid_from) AS INTEGER),
      valid_from, valid_from + INTERVAL 15 MINUTE FROM price""",
)
def forecast_intervals(t):
    """Intervals each possible issue time has to cover, for demand and for prices."""
    issues = t.events.select(timegrid.floor_quarter_hour(F.col("ts")).alias("issue_time")).distinct()
    parts = [
        timegrid.forecast_intervals(issues, target).select(F.lit(target).alias("target"), "*")
        for target in ("demand", "price")
    ]
    return parts[0].unionByName(parts[1])


@register(
    "expand_intervals",
    f"""WITH {TYPED}, quarters AS (SELECT *, unnest(range(interval_start, interval_end, INTERVAL 15 MINUTE)) AS valid_time
      FROM typed WHERE value IS NOT NULL)
    SELECT event_type, area, valid_time, value FROM quarters QUALIFY row_number() OVER (PARTITION BY event_type, area, valid_time
      ORDER BY revision DESC, ingested_at DESC, event_id DESC NULLS LAST, eid DESC) = 1""",
)
def expand_intervals(t):
    """Hourly revisions to a revision-aware quarter-hour series."""
    chosen = t.typed_events.withColumn("event_id", F.coalesce("event_id", F.lit("")))
    return series.events_to_series(chosen, keys=SERIES_KEYS)


WEATHER_SQL = f"""WITH {TYPED}, quarters AS (SELECT *, unnest(range(interval_start, interval_end, INTERVAL 15 MINUTE)) AS valid_time
      FROM typed WHERE value IS NOT NULL AND event_type = 'weather' AND published_at <= TIMESTAMP '2024-01-25'),
    latest AS (SELECT * FROM quarters QUALIFY row_number() OVER (PARTITION BY area, valid_time, dimension
      ORDER BY revision DESC, ingested_at DESC, event_id DESC NULLS LAST, eid DESC) = 1)
    SELECT area, valid_time, {", ".join(f"avg(value) FILTER (dimension = '{d}') AS {d}" for d in WEATHER_DIMENSIONS)}
    FROM latest GROUP BY 1, 2"""


@register("weather_pivot", WEATHER_SQL)
def weather_pivot(t):
    """Wide weather known at a cut-off, newest revision per quarter hour and dimension."""
    chosen = t.typed_events.withColumn("event_id", F.coalesce("event_id", F.lit("")))
    return series.weather_frame(chosen, available_at=F.lit("2024-01-25").cast("timestamp"))


@register(
    "resample_ffill",
    f"""WITH bins AS (SELECT event_type, {AREA} AS area, time_bucket(INTERVAL 15 MINUTE, ts) AS valid_time,
        avg(value) AS value FROM events GROUP BY 1, 2, 3),
    bounds AS (SELECT event_type, area, min(valid_time) AS lo, max(valid_time) AS hi FROM bins GROUP BY 1, 2),
    spine AS (SELECT event_type, area, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS valid_time FROM bounds),
    grid AS (SELECT * FROM spine LEFT JOIN bins USING (event_type, area, valid_time))
    SELECT event_type, area, valid_time, last_value(value IGNORE NULLS) OVER (PARTITION BY event_type, area ORDER BY valid_time
      ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS value FROM grid""",
    doubles="value",
)
def resample_ffill(t):
    """Quarter-hour bin means on a full grid, gaps filled from at most four steps back."""
    return series.resample(t.observations, keys=SERIES_KEYS, seconds=900).select(*SERIES_KEYS, "valid_time", "value")


@register(
    "series_gaps",
    f"""WITH bins AS (SELECT event_type, {AREA} AS area, time_bucket(INTERVAL 15 MINUTE, ts) AS valid_time FROM events GROUP BY 1, 2, 3),
    seen AS (SELECT *, lag(valid_time) OVER (PARTITION BY event_type, area ORDER BY valid_time) AS previous_time FROM bins)
    SELECT event_type, area, valid_time, previous_time, 'gap' AS violation,
      CAST(date_diff('minute', previous_time, valid_time) // 15 - 1 AS BIGINT) AS missing_steps
    FROM seen WHERE valid_time - previous_time <> INTERVAL 15 MINUTE""",
)
def series_gaps_query(t):
    """Breaks in the quarter-hour grid of every series."""
    bins = t.observations.groupBy(
        *SERIES_KEYS, timegrid.floor_quarter_hour(F.col("valid_time")).alias("valid_time")
    ).agg(F.avg("value").alias("value"))
    return series_gaps(bins, keys=SERIES_KEYS, steps_per_day=96).select(
        *SERIES_KEYS, "valid_time", "previous_time", "violation", "missing_steps"
    )


HOURS_SQL = ", ".join(f"avg(value) FILTER (hour(ts) = {h}) AS h{h:02d}" for h in range(24))


@register(
    "seasonality_profile",
    f"SELECT event_type, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, {HOURS_SQL} FROM events GROUP BY 1, 2",
    digits=9,
    doubles=" ".join(f"h{h:02d}" for h in range(24)),
)
def seasonality_profile(t):
    return series.seasonality_profile(t.observations, keys=["event_type"])


@register(
    "persistence_forecast",
    f"""WITH {SERIES}, tail AS (SELECT *, row_number() OVER (PARTITION BY event_type, area ORDER BY valid_time DESC) AS back FROM series),
    steps AS (SELECT unnest(range(1, 61)) AS horizon_step)
    SELECT event_type, area, CAST(horizon_step AS INTEGER) AS horizon_step, value AS forecast FROM tail JOIN steps
      ON 24 - back = (horizon_step - 1) % 24 WHERE back <= 24""",
)
def persistence_forecast(t):
    return series.persistence_forecast(t.series, keys=SERIES_KEYS, steps_lag=24, horizon_steps=60)


@register(
    "stable_key",
    f"""WITH {TYPED} SELECT eid, sha256('["' || event_type || '","' || area || '","' ||
      strftime(date_trunc('day', interval_start), '%Y-%m-%dT%H:%M:%S') || '+00:00","' ||
      strftime(interval_start, '%Y-%m-%dT%H:%M:%S') || '+00:00"]') AS stable_key FROM typed""",
)
def stable_key(t):
    return t.forecast_writes.select(F.col("write_no").alias("eid"), hashing.forecast_stable_key().alias("stable_key"))
