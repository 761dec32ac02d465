"""The given tables seen as power-market inputs, and the same mapping as SQL text.

Every adapter is a plain projection or one aggregation of whole tables, so the work of a query
grows with the tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.functions.timegrid import floor_to
from voltframe.operators.backtest import BacktestPlan, shifted_values
from voltframe.operators.series import time_spine
from voltframe.session import durable
from voltframe.schemas import DEAD_LETTER_TOPIC, TOPICS, WEATHER_DIMENSIONS

SERIES_KEYS = ("event_type", "area")
PLAN = BacktestPlan(train_days=8, test_days=2, step_days=2, steps_per_day=24, lead=24)
NOW = "2024-01-31 12:00:00"


def minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n.cast("int"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))

    @property
    def now(self) -> Column:
        return F.lit(NOW).cast("timestamp")

    @cached_property
    def typed_events(self) -> DataFrame:
        """``events`` as versioned measurements, with every defect the curation rules look for."""
        eid = F.col("event_id")
        kind = (
            F.when(F.col("event_type") == "click", "demand")
            .when(F.col("event_type") == "view", "generation")
            .when(F.col("event_type") == "purchase", "price")
            .when(F.col("event_type") == "signup", "weather")
            .otherwise("unknown")
        )
        dims = F.array(*[F.lit(d) for d in WEATHER_DIMENSIONS])
        units = F.array(*[F.lit(u) for u in ("degC", "m/s", "%", "W/m2")])
        slot = (eid % 4 + 1).cast("int")
        unit = (
            F.when(eid % 50 == 7, "kW")
            .when(kind == "weather", F.element_at(units, slot))
            .when(kind == "price", "EUR/MWh")
            .otherwise("MW")
        )
        quality = (
            F.when(eid % 20 == 0, "missing")
            .when(eid % 20 == 1, "estimated")
            .when(eid % 20 == 2, "invalid")
            .when(eid % 20 == 3, F.lit(None).cast("string"))
            .otherwise("valid")
        )
        start = floor_to(F.col("ts"), 3600)
        return self.events.select(
            eid.alias("eid"),
            F.lit("1.0").alias("schema_version"),
            F.when(eid % 211 != 3, F.lpad(eid.cast("string"), 12, "0")).alias("event_id"),
            F.concat(F.lit("src"), (eid % 3).cast("string")).alias("source"),
            kind.alias("event_type"),
            F.concat(F.lit("Z"), (F.col("user_id") % 3).cast("string")).alias("area"),
            start.alias("interval_start"),
            (start + F.expr("INTERVAL 1 HOUR")).alias("interval_end"),
            F.col("ts").alias("published_at"),
            (F.col("ts") + minutes((eid * 37) % 240)).alias("ingested_at"),
            F.when(eid % 20 != 0, F.col("value")).alias("value"),
            unit.alias("unit"),
            F.when(eid % 97 == 5, 0).otherwise((F.floor(eid / 7) % 4 + 1)).cast("int").alias("revision"),
            quality.alias("quality_status"),
            F.when(kind == "weather", F.element_at(dims, slot)).alias("dimension"),
            F.sha2(F.concat(F.lit("payload-"), F.floor(eid / 25).cast("string")), 256).alias("payload_checksum"),
            F.when(eid % 53 == 9, "unexpected").alias("note"),
        )

    @cached_property
    def bronze(self) -> DataFrame:
        """Raw envelopes: the measurements as JSON text, some of it broken or without an offset."""
        eid = F.col("eid")
        columns = [c for c in self.typed_events.columns if c != "eid"]
        text = F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"})
        naive = F.regexp_replace(text, r'("published_at":"[^"+]*)\+00:00"', '$1"')
        topics = F.create_map(*[F.lit(x) for item in TOPICS.items() for x in item])
        return self.typed_events.select(
            F.coalesce(F.try_element_at(topics, "event_type"), F.lit(DEAD_LETTER_TOPIC)).alias("topic"),
            (eid % 4).cast("int").alias("partition"),
            eid.alias("offset"),
            F.col("ingested_at").alias("kafka_timestamp"),
            F.col("event_id").alias("key"),
            F.when(eid % 101 == 11, '{"schema_version":"broken"')
            .when(eid % 59 == 4, naive)
            .otherwise(text)
            .alias("raw_payload"),
            "ingested_at",
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """Hourly sums per event type and area; stored, so the raw table is scanned once per query."""
        return durable(
            self.events.groupBy(
                "event_type",
                F.concat(F.lit("Z"), (F.col("user_id") % 3).cast("string")).alias("area"),
                floor_to(F.col("ts"), 3600).alias("valid_time"),
            ).agg(F.sum("value").alias("_sum"))
        )

    @cached_property
    def series(self) -> DataFrame:
        """Hourly sums without gaps (24 steps per day) over a base level that changes by day."""
        base = (F.unix_date(F.to_date("valid_time")) % 11).cast("double")
        spine = time_spine(self.hourly, keys=SERIES_KEYS, seconds=3600)
        return spine.join(self.hourly, [*SERIES_KEYS, "valid_time"], "left").select(
            *SERIES_KEYS, "valid_time", F.round(F.coalesce("_sum", F.lit(0.0)) + base, 2).alias("value")
        )

    @cached_property
    def observations(self) -> DataFrame:
        """Irregular raw observations per event type and area."""
        return self.events.select(
            "event_type",
            F.concat(F.lit("Z"), (F.col("user_id") % 3).cast("string")).alias("area"),
            F.col("ts").alias("valid_time"),
            "value",
            "event_id",
        )

    @cached_property
    def learner_outputs(self) -> DataFrame:
        """Quantiles of three simple learners around the value one day earlier; one is crossed."""
        base = shifted_values(
            self.series, keys=SERIES_KEYS, steps_per_day=24, offsets={"lag_24h": 24}
        ).filter(F.col("lag_24h").isNotNull())
        lag = F.col("lag_24h")
        quantiles = {}
        for i, sign in ((1, 1.0), (2, -1.0), (3, 1.0)):
            quantiles[f"p10_{i}"] = lag * (1.0 - 0.1 * i * sign)
            quantiles[f"p50_{i}"] = lag * 1.0
            quantiles[f"p90_{i}"] = lag * (1.0 + 0.1 * i * sign)
        return base.withColumns(quantiles).withColumnRenamed("value", "actual")

    @cached_property
    def intervals_forecast(self) -> DataFrame:
        """One simple forecast per row: 0.8, 1.0 and 1.1 times the value one day earlier."""
        lag = F.col("lag_24h")
        return self.learner_outputs.select(
            *SERIES_KEYS, "valid_time", "actual", (lag * 0.8).alias("p10"), (lag * 1.0).alias("p50"),
            (lag * 1.1).alias("p90"), (lag * 1.0).alias("predicted"),
        )

    @cached_property
    def history(self) -> DataFrame:
        """Orders as revisioned load records of nations (bidding zones) in regions (countries)."""
        nations = self.read("nation").join(
            self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        placed = self.read("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        key = F.col("o_orderkey")
        return self.orders.join(placed, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderdate").alias("timestamp_utc"),
            F.col("r_name").alias("country_code"),
            F.col("n_name").alias("zone_key"),
            F.concat(F.lit("Zone "), F.col("n_name")).alias("zone_name"),
            F.when(key % 17 != 0, F.col("o_totalprice")).alias("load"),
            (key % 3).cast("int").alias("revision_number"),
            F.when(key % 4 == 0, "PT60M").when(key % 4 == 1, "PT30M").when(key % 4 == 2, "PT15M").alias("resolution"),
            key.alias("record_id"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """Daily order value per priority and status with the value of a week ago as forecast."""
        days = self.orders.groupBy(
            "o_orderpriority", F.col("o_orderdate").alias("valid_time")
        ).agg(F.round(F.sum("o_totalprice"), 2).alias("actual"))
        past = days.select(
            "o_orderpriority",
            (F.col("valid_time") + F.expr("INTERVAL 7 DAYS")).alias("valid_time"),
            F.col("actual").alias("predicted"),
        )
        return days.join(past, ["o_orderpriority", "valid_time"])

    @cached_property
    def forecast_writes(self) -> DataFrame:
        """A log of forecast writes, many of them to the same natural key."""
        eid = F.col("eid")
        v = F.coalesce("value", F.lit(1.0))
        return self.typed_events.select(
            F.concat(F.lit("f-"), F.lpad(eid.cast("string"), 12, "0")).alias("forecast_id"),
            F.col("event_type").alias("target"),
            "area",
            floor_to(F.col("interval_start"), 86_400).alias("issue_time"),
            F.col("interval_start").alias("valid_from"),
            F.when(eid % 71 == 0, F.col("interval_start")).otherwise(F.col("interval_end")).alias("valid_to"),
            v.alias("point"),
            F.when(eid % 29 == 0, v + 1).otherwise(v * 0.8).alias("p10"),
            v.alias("p50"),
            (v * 1.2).alias("p90"),
            F.lit("MW").alias("unit"),
            F.lit("seasonal-quantile").alias("model_name"),
            F.concat(F.lit("v"), (eid % 2).cast("string")).alias("model_version"),
            F.lit("live-0").alias("data_snapshot_id"),
            F.array(F.lit("real_source_data")).alias("quality_flags"),
            (eid % 3 == 0).alias("is_shadow"),
            eid.alias("write_no"),
        )

    @cached_property
    def stored_forecasts(self) -> DataFrame:
        from voltframe.operators.forecasts import upsert_by_natural_key

        return upsert_by_natural_key(self.forecast_writes, order=["write_no"])

    @cached_property
    def candidates(self) -> DataFrame:
        """Model candidates: one per event type, area and day, error = mean value of that day."""
        daily = self.events.groupBy(
            F.concat(F.lit("Z"), (F.col("user_id") % 3).cast("string")).alias("area"),
            F.col("event_type").alias("target"),
            floor_to(F.col("ts"), 86_400).alias("evaluated_at"),
        ).agg((F.round(F.sum("value"), 2) / F.count("value")).alias("mae"))
        return durable(
            daily.select(
                "area",
                "target",
                F.lit("operational").alias("product"),
                "evaluated_at",
                F.concat(F.lit("m-"), F.date_format("evaluated_at", "yyyyMMdd")).alias("version"),
                "mae",
                F.lit(52.0).alias("baseline_mae"),
            )
        )

    @cached_property
    def windows(self) -> DataFrame:
        """Evaluation windows: hourly mean value against a fixed reference error."""
        return self.events.groupBy(
            F.concat(F.lit("Z"), (F.col("user_id") % 3).cast("string")).alias("area"),
            F.col("event_type").alias("target"),
            floor_to(F.col("ts"), 3600).alias("window_start"),
        ).agg((F.round(F.sum("value"), 2) / F.count("value")).alias("champion_error")).withColumn("reference_error", F.lit(36.0))


# --- the same inputs as SQL ------------------------------------------------------------------

AREA = "'Z' || CAST(user_id % 3 AS VARCHAR)"

TYPED = """
typed AS (
  SELECT event_id AS eid, '1.0' AS schema_version,
    CASE WHEN event_id % 211 <> 3 THEN lpad(CAST(event_id AS VARCHAR), 12, '0') END AS event_id,
    'src' || CAST(event_id % 3 AS VARCHAR) AS source,
    CASE event_type WHEN 'click' THEN 'demand' WHEN 'view' THEN 'generation' WHEN 'purchase' THEN 'price'
      WHEN 'signup' THEN 'weather' ELSE 'unknown' END AS event_type,
    'Z' || CAST(user_id % 3 AS VARCHAR) AS area,
    date_trunc('hour', ts) AS interval_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS interval_end,
    ts AS published_at, ts + to_minutes((event_id * 37) % 240) AS ingested_at,
    CASE WHEN event_id % 20 <> 0 THEN value END AS value,
    CASE WHEN event_id % 50 = 7 THEN 'kW'
      WHEN event_type = 'signup' THEN (['degC', 'm/s', '%', 'W/m2'])[event_id % 4 + 1]
      WHEN event_type = 'purchase' THEN 'EUR/MWh' ELSE 'MW' END AS unit,
    CAST(CASE WHEN event_id % 97 = 5 THEN 0 ELSE (event_id // 7) % 4 + 1 END AS INTEGER) AS revision,
    CASE event_id % 20 WHEN 0 THEN 'missing' WHEN 1 THEN 'estimated' WHEN 2 THEN 'invalid'
      WHEN 3 THEN NULL ELSE 'valid' END AS quality_status,
    CASE WHEN event_type = 'signup' THEN (['temperature_2m', 'wind_speed_10m', 'relative_humidity_2m',
      'shortwave_radiation'])[event_id % 4 + 1] END AS dimension,
    sha256('payload-' || CAST(event_id // 25 AS VARCHAR)) AS payload_checksum,
    CASE event_type WHEN 'click' THEN 'grid.demand.v1' WHEN 'view' THEN 'grid.generation.v1'
      WHEN 'purchase' THEN 'market.prices.v1' WHEN 'signup' THEN 'weather.forecasts.v1'
      ELSE 'energy.dead-letter.v1' END AS topic
  FROM events)"""

BUSINESS_KEY = (
    "sha256(source || '|' || event_type || '|' || area || '|' || "
    "strftime(interval_start, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || coalesce(dimension, ''))"
)

ACCEPTED = """eid % 101 <> 11 AND event_id IS NOT NULL AND quality_status IS NOT NULL
    AND interval_end > interval_start
    AND event_type IN ('demand', 'generation', 'price', 'weather')
    AND NOT (quality_status = 'valid' AND value IS NULL)
    AND NOT (quality_status = 'missing' AND value IS NOT NULL)
    AND ((event_type IN ('demand', 'generation') AND unit = 'MW') OR (event_type = 'price' AND unit = 'EUR/MWh')
      OR (event_type = 'weather' AND unit IN ('degC', 'm/s', '%', 'W/m2')))"""

VALID = f"""{TYPED},
valid AS (SELECT {BUSINESS_KEY} AS business_key, * FROM typed WHERE {ACCEPTED})"""

SERIES = f"""
hourly AS (SELECT event_type, {AREA} AS area, date_trunc('hour', ts) AS valid_time, sum(value) AS s
  FROM events GROUP BY 1, 2, 3),
bounds AS (SELECT event_type, area, min(valid_time) AS lo, max(valid_time) AS hi FROM hourly GROUP BY 1, 2),
spine AS (SELECT event_type, area, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS valid_time FROM bounds),
series AS (SELECT event_type, area, valid_time, round(coalesce(s, 0.0)
    + CAST(date_diff('day', DATE '1970-01-01', CAST(valid_time AS DATE)) % 11 AS DOUBLE), 2) AS value
  FROM spine LEFT JOIN hourly USING (event_type, area, valid_time))"""

LEARNERS = f"""{SERIES},
based AS (SELECT *, lag(value, 24) OVER (PARTITION BY event_type, area ORDER BY valid_time) AS lag_24h FROM series),
learners AS (SELECT event_type, area, valid_time, value AS actual, lag_24h,
    lag_24h * 0.9 AS p10_1, lag_24h AS p50_1, lag_24h * 1.1 AS p90_1,
    lag_24h * 1.2 AS p10_2, lag_24h AS p50_2, lag_24h * 0.8 AS p90_2,
    lag_24h * 0.7 AS p10_3, lag_24h AS p50_3, lag_24h * 1.3 AS p90_3
  FROM based WHERE lag_24h IS NOT NULL),
simple AS (SELECT event_type, area, valid_time, actual, lag_24h * 0.8 AS p10, lag_24h AS p50, lag_24h * 1.1 AS p90,
    lag_24h AS predicted FROM learners)"""

HISTORY = """
history AS (
  SELECT o_orderdate AS timestamp_utc, r_name AS country_code, n_name AS zone_key, 'Zone ' || n_name AS zone_name,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS load, CAST(o_orderkey % 3 AS INTEGER) AS revision_number,
    CASE o_orderkey % 4 WHEN 0 THEN 'PT60M' WHEN 1 THEN 'PT30M' WHEN 2 THEN 'PT15M' END AS resolution,
    o_orderkey AS record_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey),
newest AS (SELECT * FROM history QUALIFY row_number() OVER (
    PARTITION BY country_code, zone_key, timestamp_utc ORDER BY revision_number DESC, record_id DESC) = 1)"""

DAILY = """
days AS (SELECT o_orderpriority, o_orderdate AS valid_time, round(sum(o_totalprice), 2) AS actual
  FROM orders GROUP BY 1, 2),
daily AS (SELECT a.o_orderpriority, a.valid_time, a.actual, b.actual AS predicted FROM days a JOIN days b
  ON a.o_orderpriority = b.o_orderpriority AND b.valid_time = a.valid_time - INTERVAL 7 DAY)"""

WRITES = f"""{TYPED},
writes AS (SELECT 'f-' || lpad(CAST(eid AS VARCHAR), 12, '0') AS forecast_id, event_type AS target, area,
    date_trunc('day', interval_start) AS issue_time, interval_start AS valid_from,
    CASE WHEN eid % 71 = 0 THEN interval_start ELSE interval_end END AS valid_to,
    coalesce(value, 1.0) AS point,
    CASE WHEN eid % 29 = 0 THEN coalesce(value, 1.0) + 1 ELSE coalesce(value, 1.0) * 0.8::DOUBLE END AS p10,
    coalesce(value, 1.0) AS p50, coalesce(value, 1.0) * 1.2::DOUBLE AS p90,
    'v' || CAST(eid % 2 AS VARCHAR) AS model_version, eid % 3 = 0 AS is_shadow, eid AS write_no
  FROM typed),
stored AS (SELECT arg_min(forecast_id, write_no) AS forecast_id, target, area, issue_time, valid_from, model_version,
    is_shadow, arg_max(valid_to, write_no) AS valid_to, arg_max(point, write_no) AS point,
    arg_max(p10, write_no) AS p10, arg_max(p50, write_no) AS p50, arg_max(p90, write_no) AS p90
  FROM writes GROUP BY target, area, issue_time, valid_from, model_version, is_shadow)"""

CANDIDATES = f"""
candidates AS (SELECT {AREA} AS area, event_type AS target, 'operational' AS product,
    date_trunc('day', ts) AS evaluated_at, 'm-' || strftime(date_trunc('day', ts), '%Y%m%d') AS version,
    round(sum(value), 2) / count(value) AS mae, 52.0::DOUBLE AS baseline_mae
  FROM events GROUP BY ALL)"""

WINDOWS = f"""
windows AS (SELECT {AREA} AS area, event_type AS target, date_trunc('hour', ts) AS window_start,
    round(sum(value), 2) / count(value) AS champion_error, 36.0::DOUBLE AS reference_error
  FROM events GROUP BY ALL)"""
