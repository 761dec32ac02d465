"""Registry of runnable queries and, where plain SQL can say the same, the SQL to check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Tables = "voltframe.workload.tables.Tables"


def register(
    name: str, sql: str | None = None, digits: int = 6, doubles: str = "", coarse: str = "", coarse_digits: int = 6
):
    """Register a query taking ``Tables``.

    Results are rounded so that summation order cannot show: ``doubles`` names the SQL columns to
    round to ``digits`` places, ``coarse`` those of large magnitude to ``coarse_digits``.
    """
    places = {c: coarse_digits for c in coarse.split()}

    def wrap(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from voltframe.workload.tables import Tables

            return rounded(function(Tables(configure(spark), sf_dir)), digits, places)

        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if sql is not None:
            names = [*doubles.split(), *places]
            replaced = ", ".join(f"round({c}, {places.get(c, digits)}) + 0.0 AS {c}" for c in names)
            ORACLE[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS result" if names else sql
        return function

    return wrap


def rounded(df: DataFrame, digits: int, places: dict[str, int]) -> DataFrame:
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), places.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )
