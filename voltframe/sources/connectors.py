"""Connectors that need an external system; jobs take their DataFrames as arguments instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.schemas import BRONZE_SCHEMA, FORECAST_SCHEMA, TOPIC_PATTERN


# Bronze columns that the broker calls otherwise.
BROKER_NAMES = {"kafka_timestamp": "timestamp", "raw_payload": "value"}


def read_kafka(spark: SparkSession, servers: str, pattern: str = TOPIC_PATTERN, **options: str) -> DataFrame:
    """Stream of all topics of a pattern from their first message; ``options`` override or add to the source's."""
    settings = {"kafka.bootstrap.servers": servers, "subscribePattern": pattern, "startingOffsets": "earliest"} | options
    return spark.readStream.format("kafka").options(**settings).load()


def read_landed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of raw envelopes landed as JSON files, with the Kafka column layout."""
    reader = spark.readStream.schema("topic string, partition int, offset long, timestamp timestamp, key string, value string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def bronze_columns(raw: DataFrame) -> DataFrame:
    """The bronze layout of broker messages: every column by its type, stamped with the time of ingestion."""

    def column(name: str, kind: T.DataType):
        source = F.current_timestamp() if name == "ingested_at" else F.col(BROKER_NAMES.get(name, name))
        return source.cast(kind).alias(name)

    return raw.select(*[column(f.name, f.dataType) for f in BRONZE_SCHEMA])


def write_kafka(messages: DataFrame, servers: str) -> None:
    messages.select("topic", "key", "value").write.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).save()


def read_forecast_table(
    spark: SparkSession, url: str, table: str = "forecasts", *, partition_on: str = "id",
    lower: int | None = None, upper: int | None = None, partitions: int = 16, **options: str
) -> DataFrame:
    """Forecast rows over JDBC, read in parallel ranges of the numeric row id.

    Bounds that are not given are the table's own smallest and largest id.
    """
    if lower is None or upper is None:
        query = f"SELECT min({partition_on}) AS lo, max({partition_on}) AS hi FROM {table}"
        ends = spark.read.format("jdbc").options(url=url, query=query, **options).load().first()
        lower, upper = (given if given is not None else int(end or 0) for given, end in zip((lower, upper), ends))
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=partition_on, lowerBound=str(lower),
        upperBound=str(upper), numPartitions=str(partitions), **options,
    )
    return forecast_columns(reader.load())


def forecast_columns(df: DataFrame) -> DataFrame:
    """Project to the forecast columns; flags stored as JSON text become an array."""
    if dict(df.dtypes)["quality_flags"] == "string":
        df = df.withColumn("quality_flags", F.from_json("quality_flags", "array<string>"))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FORECAST_SCHEMA])
