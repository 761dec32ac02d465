"""Source documents to event rows: market XML, station weather JSON, event JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voltframe.functions.hashing import iso_utc, uuid5_url
from voltframe.operators.curate import contract_violations
from voltframe.schemas import EVENT_SCHEMA, STATION_SCHEMA, STATIONS, WEATHER_DIMENSIONS, WEATHER_UNITS

# Period resolutions in seconds; other resolutions are skipped.
RESOLUTION_SECONDS = {"PT15M": 900, "PT30M": 1800, "PT60M": 3600}

DOCUMENT_SCHEMA = """
  TimeSeries array<struct<
    `MktPSRType`: struct<psrType: string>,
    `Period`: array<struct<
      `timeInterval`: struct<`start`: string, `end`: string>,
      resolution: string,
      `Point`: array<struct<position: string, quantity: string, `price.amount`: string>>
    >>
  >>
"""
XML_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents as ``(path, payload)``; a document is one bounded API response."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("payload"))


def market_points(documents: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per usable point of each document; other columns are carried along."""
    kept = [F.col(c) for c in documents.columns if c != payload]
    parsed = documents.select(
        *kept,
        F.sha2(payload, 256).alias("payload_checksum"),
        F.from_xml(payload, DOCUMENT_SCHEMA, XML_OPTIONS).alias("_doc"),
    )
    names = [c for c in parsed.columns if c != "_doc"]
    series = parsed.select(*names, F.explode("_doc.TimeSeries").alias("_s"))
    periods = series.select(
        *names, F.col("_s.MktPSRType.psrType").alias("dimension"), F.explode("_s.Period").alias("_p")
    )
    seconds = F.create_map(*[F.lit(x) for item in RESOLUTION_SECONDS.items() for x in item])
    points = periods.select(
        *names,
        "dimension",
        # Period starts come without seconds, which a time stamp with an offset must have.
        F.try_to_timestamp(
            F.regexp_replace("_p.timeInterval.start", r"T(\d{2}:\d{2})(Z|[+-])", "T$1:00$2")
        ).alias("_start"),
        F.try_element_at(seconds, F.col("_p.resolution")).alias("_seconds"),
        F.explode("_p.Point").alias("_pt"),
    ).filter(F.col("_start").isNotNull() & F.col("_seconds").isNotNull())
    step = F.col("_seconds") * F.lit(1_000_000).cast("long")
    start = F.unix_micros("_start") + step * (F.col("_position") - 1)
    filled = F.nullif(F.col("_pt.quantity"), F.lit(""))
    priced = F.nullif(F.col("_pt").getField("price.amount"), F.lit(""))
    return (
        points.withColumns(
            {
                "_position": F.col("_pt.position").cast("int"),
                "value": F.coalesce(filled, priced).cast("double"),
            }
        )
        .filter(F.col("_position").isNotNull() & F.col("value").isNotNull())
        .select(
            *names,
            "dimension",
            F.col("_position").alias("position"),
            F.timestamp_micros(start).alias("interval_start"),
            F.timestamp_micros(start + step).alias("interval_end"),
            "value",
        )
    )


def _provenance(source_url: str | None, request_params: dict[str, str] | None) -> list[Column]:
    """Where a payload came from, as event columns."""
    params = [F.lit(x) for item in sorted((request_params or {}).items()) for x in item]
    known = F.create_map(*params) if params else F.create_map().cast("map<string,string>")
    return [F.lit(source_url).cast("string").alias("source_url"), known.alias("request_params")]


def market_events(
    documents: DataFrame, target: str, *, area: str, retrieved_at: Column, payload: str = "payload", source_url: str | None = None,
    request_params: dict[str, str] | None = None,
) -> DataFrame:
    """Points as canonical events of one target and area, with the request that fetched them."""
    points = market_points(documents.select(payload), payload)
    return points.select(
        F.lit("1.0").alias("schema_version"),
        F.sha2(F.concat_ws("|", "payload_checksum", "dimension", F.col("interval_start").cast("string")), 256).alias("event_id"),
        F.lit("entsoe").alias("source"),
        F.lit(target).alias("event_type"),
        F.lit(area).alias("area"),
        "interval_start",
        "interval_end",
        retrieved_at.alias("published_at"),
        retrieved_at.alias("ingested_at"),
        "value",
        F.lit("EUR/MWh" if target == "price" else "MW").alias("unit"),
        F.lit(1).alias("revision"),
        F.lit("valid").alias("quality_status"),
        "dimension",
        *_provenance(source_url, request_params),
        "payload_checksum",
    )


STATION_PAYLOAD = (
    "hourly struct<time: array<string>, "
    + ", ".join(f"{d}: array<double>" for d in WEATHER_DIMENSIONS)
    + ">"
)


def station_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATIONS), STATION_SCHEMA)


def station_readings(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``(station, valid_time, dimension, value)`` from hourly station documents."""
    parsed = payloads.select("station", F.from_json(payload, STATION_PAYLOAD).alias("_d"))
    zipped = F.arrays_zip("_d.hourly.time", *[F.col(f"_d.hourly.{d}") for d in WEATHER_DIMENSIONS])
    hours = parsed.select("station", F.explode(zipped).alias("_h"))
    wide = hours.select(
        "station",
        F.to_timestamp(F.col("_h.time")).alias("valid_time"),
        *[F.col("_h")[d].alias(d) for d in WEATHER_DIMENSIONS],
    )
    return wide.unpivot(["station", "valid_time"], list(WEATHER_DIMENSIONS), "dimension", "value")


def regional_weather(readings: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weighted sum over stations per hour and dimension.

    Null readings are skipped without renormalising; ``weight_sum`` shows how much weight arrived.
    The built-in table has five fixed rows and is broadcast; for a table of one's own Spark decides.
    """
    table = F.broadcast(station_weights(readings.sparkSession)) if weights is None else weights
    return (
        readings.filter(F.col("value").isNotNull())
        .join(table.select("station", "weight"), "station")
        .groupBy("valid_time", "dimension")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("value"), F.sum("weight").alias("weight_sum"))
    )


def weather_events(
    regional: DataFrame, *, area: str, retrieved_at: Column, checksum: Column, source_url: str | None = None,
    request_params: dict[str, str] | None = None,
) -> DataFrame:
    units = F.create_map(*[F.lit(x) for item in WEATHER_UNITS.items() for x in item])
    return regional.select(
        F.lit("1.0").alias("schema_version"),
        uuid5_url(
            F.concat_ws("|", F.lit("open-meteo"), F.lit(area), "dimension", iso_utc(F.col("valid_time")), checksum)
        ).alias("event_id"),
        F.lit("open-meteo").alias("source"),
        F.lit("weather").alias("event_type"),
        F.lit(area).alias("area"),
        F.col("valid_time").alias("interval_start"),
        (F.col("valid_time") + F.expr("INTERVAL 1 HOUR")).alias("interval_end"),
        retrieved_at.alias("published_at"),
        retrieved_at.alias("ingested_at"),
        "value",
        units[F.col("dimension")].alias("unit"),
        F.lit(1).alias("revision"),
        F.lit("valid").alias("quality_status"),
        "dimension",
        *_provenance(source_url, request_params),
        checksum.alias("payload_checksum"),
    )


def market_rejects(documents: DataFrame, payload: str = "payload") -> DataFrame:
    """Documents that give no point, with their other columns, checksum and ``reason``.

    ``empty`` and ``malformed`` documents, those ``without_series`` (an acknowledgement, say), and those whose series hold
    ``no_usable_point``: no known resolution, start, position or value.
    """
    kept = [F.col(c) for c in documents.columns if c != payload]
    marked = documents.withColumn("_doc", F.from_xml(payload, DOCUMENT_SCHEMA + ", _corrupt_record string", XML_OPTIONS))
    # Whether a document gives a point is decided by the parser of points itself, per checksum.
    checksum = F.sha2(payload, 256)
    usable = market_points(documents.select(payload), payload).select("payload_checksum").distinct()
    reason = (
        F.when(F.col(payload).isNull() | (F.trim(payload) == ""), "empty")
        .when(F.col("_doc").isNull() | F.col("_doc._corrupt_record").isNotNull(), "malformed")
        .when(F.coalesce(F.size("_doc.TimeSeries"), F.lit(0)) <= 0, "without_series")
        .otherwise("no_usable_point")
    )
    rows = marked.select(*kept, F.coalesce(checksum, F.lit("")).alias("payload_checksum"), reason.alias("reason"))
    return rows.join(usable, "payload_checksum", "left_anti")


def station_rejects(payloads: DataFrame, weights: DataFrame | None = None, payload: str = "payload") -> DataFrame:
    """Station documents that add nothing to the regional mean: ``(station, payload_checksum, reason)``.

    ``unknown_station``, ``malformed``, and ``without_hours`` for documents that hold no hour.
    """
    known = (station_weights(payloads.sparkSession) if weights is None else weights).select("station", F.lit(True).alias("_known")).distinct()
    parsed = payloads.withColumn("_d", F.from_json(payload, STATION_PAYLOAD + ", _corrupt_record string"))
    reason = (
        F.when(F.col("_known").isNull(), "unknown_station")
        .when(F.col("_d").isNull() | F.col("_d._corrupt_record").isNotNull(), "malformed")
        .when(F.coalesce(F.size("_d.hourly.time"), F.lit(0)) <= 0, "without_hours")
    )
    marked = parsed.join(known, "station", "left").withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return marked.select("station", F.sha2(payload, 256).alias("payload_checksum"), "reason")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)`` of text files: 1-based line numbers, however the files were split.

    A split counts its lines; the sum over the earlier splits of its file is the number its own lines start after.
    """
    split = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    lines = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("_at"))
    counts = lines.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file", "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file", "_start").orderBy("_at")
    numbered = lines.withColumn("_i", F.row_number().over(inside)).join(before, ["file", "_start"])
    return numbered.select("file", (F.col("_before") + F.col("_i")).alias("line"), "value")


def checked_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is not blank: ``file, line, raw``, the ``event`` and the ``violations`` of the strict contract (empty: none).

    A line that is no JSON object violates ``malformed`` alone.
    """
    lines = numbered_lines(spark, path).filter(F.trim("value") != "").withColumnRenamed("value", "raw")
    schema = T.StructType([*EVENT_SCHEMA, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.withColumn("_e", F.from_json("raw", schema)).select("file", "line", "raw", "_e.*")
    broken = F.col("_corrupt_record").isNotNull() | ~F.ltrim("raw").startswith("{")
    checked = contract_violations(parsed, raw="raw").withColumn(
        "violations", F.when(broken, F.array(F.lit("malformed"))).otherwise(F.col("violations"))
    )
    return checked.select("file", "line", "raw", F.struct(*EVENT_SCHEMA.names).alias("event"), "violations")


def rejected_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines that break the contract: ``file, line, raw, violations``."""
    return checked_event_lines(spark, path).filter(F.size("violations") > 0).select("file", "line", "raw", "violations")


def strict_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events of files without a bad line; otherwise the first one is named by file and number (one job that looks for it)."""
    first = rejected_event_lines(spark, path).orderBy("file", "line").head(1)
    if first:
        raise ValueError(f"invalid event in {first[0].file}, line {first[0].line}: {', '.join(first[0].violations)}")
    return checked_event_lines(spark, path).select("event.*")


def read_event_lines(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Events from JSON lines; blank lines are skipped, ``strict`` fails on the first bad line."""
    reader = spark.read.schema(EVENT_SCHEMA).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(path)
