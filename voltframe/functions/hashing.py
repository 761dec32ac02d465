"""Identity hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 4122 URL namespace.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with offset; fractional seconds only when present."""
    whole = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    )


def business_key() -> Column:
    """Identity of a measurement across its revisions."""
    return F.sha2(
        F.concat_ws(
            "|",
            F.col("source"),
            F.col("event_type"),
            F.col("area"),
            iso_utc(F.col("interval_start")),
            F.coalesce("dimension", F.lit("")),
        ),
        256,
    )


def forecast_stable_key() -> Column:
    """Identity of a forecast interval: hash of a compact JSON list."""
    parts = F.array("target", "area", iso_utc(F.col("issue_time")), iso_utc(F.col("valid_from")))
    return F.sha2(F.to_json(parts), 256)


def run_identity(source: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, start, end), 256)


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID in the URL namespace: SHA-1 with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(digest.substr(17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        digest.substr(1, 8),
        digest.substr(9, 4),
        F.concat(F.lit("5"), digest.substr(14, 3)),
        F.concat(variant, digest.substr(18, 3)),
        digest.substr(21, 12),
    )
