from __future__ import annotations

import json
from datetime import datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from voltframe.operators import curate
from voltframe.sources import connectors, history, payloads


def rows(spark):
    data = [
        (datetime(2023, 12, 31, 23), "ES", "ES", "Spain", 1, 10.0, "PT60M", "r1"),
        (datetime(2024, 6, 1), "ES", "ES", "Spain", 1, 20.0, None, "r2"),
        (datetime(2024, 6, 1), "ES", "ES", "Spain", 2, 21.0, "PT30M", "r3"),
        (datetime(2024, 6, 1), "DE", "DE", "Germany", 1, 30.0, "1H", "r4"),
        (datetime(2024, 6, 1), "DE", "DE_LU", "Germany", 1, None, None, "r5"),
    ]
    return spark.createDataFrame(
        data, "timestamp_utc timestamp, country_code string, zone_key string, zone_name string, revision_number int, load double, resolution string, record_id string"
    )


@pytest.mark.parametrize("layout", ["hf_staging/data/", "data/processed/", "data/", ""])
def test_dataset_layouts(spark, tmp_path, layout):
    target = f"{tmp_path}/{layout}actual_load"
    rows(spark).write.parquet(target)
    assert history.resolve_dataset(spark, str(tmp_path), "actual_load") == target
    assert history.read_history(spark, str(tmp_path), "demand").count() == 5


def test_filters_reach_the_scan_and_newest_revision_wins(spark, tmp_path):
    rows(spark).write.parquet(f"{tmp_path}/actual_load")
    df = history.read_history(spark, str(tmp_path), "demand")
    got = history.load_raw_table(df, country_code="ES", start_year=2024, end_year=2024)
    assert [(r.load, r.revision_number) for r in got.collect()] == [(21.0, 2)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = history.load_raw_table(df, country_code="ES", start_year=2024)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters" in plan and "EqualTo(country_code,ES)" in plan and "GreaterThanOrEqual(timestamp_utc" in plan
    bounded = history.filter_history(
        df, start_time=F.lit(datetime(2023, 12, 31, 23)), end_time=F.lit(datetime(2023, 12, 31, 23))
    )
    assert bounded.count() == 1
    series = history.load_series(df, country_code="ES", zone="ES").orderBy("valid_time").collect()
    assert [r.value for r in series] == [10.0, 21.0]


def test_several_zones_need_a_choice(spark):
    assert [(r.country_code, r.zones) for r in history.ambiguous_zones(rows(spark)).collect()] == [("DE", 2)]
    history.require_single_zone(rows(spark), "ES")
    with pytest.raises(ValueError, match="multiple bidding zones"):
        history.require_single_zone(rows(spark), "DE")
    assert [r.zone_key for r in history.list_zones(rows(spark)).collect()] == ["DE", "DE_LU", "ES"]


def test_history_as_events(spark):
    got = {r.payload_checksum: r for r in history.load_as_events(rows(spark), "demand").collect()}
    minutes = {k: (r.interval_end - r.interval_start).seconds // 60 for k, r in got.items()}
    assert minutes == {"r1": 60, "r3": 30, "r4": 60, "r5": 15}
    assert got["r5"].quality_status == "missing" and got["r5"].value is None
    assert [r.payload_checksum for r in history.load_as_events(rows(spark), "demand", limit=1).collect()] == ["r1"]


def test_market_document(spark, tmp_path):
    def period(resolution, points):
        return (
            f"<Period><timeInterval><start>2025-01-01T23:00Z</start></timeInterval><resolution>{resolution}</resolution>"
            + "".join(f"<Point>{p}</Point>" for p in points) + "</Period>"
        )

    text = (
        '<?xml version="1.0" encoding="UTF-8"?><Doc xmlns="urn:x"><TimeSeries><MktPSRType><psrType>B16</psrType></MktPSRType>'
        + period("PT15M", ["<position>1</position><quantity>5</quantity>", "<position>3</position><quantity>7</quantity>"])
        + period("P1D", ["<position>1</position><quantity>9</quantity>"])
        + "</TimeSeries><TimeSeries>"
        + period("PT60M", ["<position>2</position><price.amount>62.3</price.amount>", "<position>3</position>"])
        + "</TimeSeries></Doc>"
    )
    (tmp_path / "a.xml").write_text(text)
    docs = payloads.read_documents(spark, str(tmp_path))
    got = payloads.market_points(docs).orderBy("interval_start").collect()
    assert [(r.dimension, r.interval_start.hour, r.interval_start.minute, r.value) for r in got] == [
        ("B16", 23, 0, 5.0), ("B16", 23, 30, 7.0), (None, 0, 0, 62.3),
    ]
    events = payloads.market_events(docs, "price", area="ES", retrieved_at=F.lit(datetime(2025, 1, 2)))
    assert {(r.unit, r.source) for r in events.collect()} == {("EUR/MWh", "entsoe")}


def test_weather_weights_skip_missing_without_renormalising(spark):
    def doc(values):
        hourly = {"time": ["2025-01-01T00:00"]} | dict.fromkeys(
            ("temperature_2m", "wind_speed_10m", "relative_humidity_2m", "shortwave_radiation"), values
        )
        return json.dumps({"hourly": hourly})

    stations = [s for s, *_ in payloads.STATIONS]
    data = [(s, doc([10.0] if s != "madrid" else [None])) for s in stations]
    df = spark.createDataFrame(data, "station string, payload string")
    got = payloads.regional_weather(payloads.station_readings(df)).collect()
    assert len(got) == 4
    assert got[0].value == pytest.approx(7.0) and got[0].weight_sum == pytest.approx(0.7)


def test_event_lines_fail_fast(spark, tmp_path):
    good = '{"schema_version":"1.0","event_id":"a","value":1.5,"interval_start":"2025-01-01T00:00:00Z"}'
    (tmp_path / "ok.jsonl").write_text(good + "\n\n" + good + "\n")
    assert payloads.read_event_lines(spark, str(tmp_path / "ok.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text(good + "\n{broken\n")
    with pytest.raises(Py4JJavaError, match="MALFORMED_RECORD"):
        payloads.read_event_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def test_contract_names_each_rule(spark):
    raw = json.dumps({
        "schema_version": "2.0", "event_id": "a", "source": "s", "event_type": "price", "area": "ES",
        "interval_start": "2025-01-01T01:00:00Z", "interval_end": "2025-01-01T01:00:00Z",
        "published_at": "2025-01-01T01:00:00", "ingested_at": "2025-01-01T01:00:00Z", "value": 1.0, "unit": "MW",
        "revision": 0, "quality_status": "missing", "extra": 1,
    })
    parsed = curate.parse_bronze(spark.createDataFrame([(raw,)], "raw_payload string")).select("raw_payload", "event.*")
    got = curate.contract_violations(parsed, raw="raw_payload").collect()[0].violations
    assert got == ["schema_version", "interval_order", "unit", "missing_with_value", "revision", "unknown_field", "naive_published_at"]


def test_messages_round_trip(spark):
    event = curate.parse_bronze(
        spark.createDataFrame([('{"event_id":"a","source":"s","event_type":"price","area":"ES","value":62.3,"interval_start":"2025-01-01T00:00:00Z"}',)], "raw_payload string")
    ).select("event.*")
    message = curate.to_messages(event)
    assert message.collect()[0].topic == "market.prices.v1" and len(message.collect()[0].key) == 64
    assert curate.from_messages(message).collect() == event.collect()


def test_forecast_projection_parses_flags(spark):
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in connectors.FORECAST_SCHEMA).replace("array<string>", "string")
    now = datetime(2025, 1, 1)
    df = spark.createDataFrame(
        [("f", "demand", "ES", now, now, now, 1.0, 1.0, 1.0, 1.0, "MW", "m", "v", "s", '["a","b"]', False)], columns
    )
    assert connectors.forecast_columns(df).collect()[0].quality_flags == ["a", "b"]


def test_weather_events_are_accepted_by_curation(spark):
    from voltframe.operators import curate
    from voltframe.sources.payloads import weather_events

    regional = spark.sql("SELECT timestamp'2025-01-01 00:00:00' valid_time, 'temperature_2m' dimension, 9.4D value")
    at = F.lit("2025-01-01T00:05:00Z").cast("timestamp")
    events = weather_events(regional, area="ES", retrieved_at=at, checksum=F.lit("c"))
    assert curate.valid_events(events.select(F.struct("*").alias("event"))).count() == 1
    assert events.head()["event_id"] == weather_events(regional, area="ES", retrieved_at=at, checksum=F.lit("c")).head()["event_id"]
