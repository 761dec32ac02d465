"""As-of joins: for each left row, the newest right row known at that moment.

Both sides are stacked and carried forward in time order, so there is no range join and no pair list.
Rows travel in pieces of equal size whatever the crowding in time (or in calendar buckets, where a
caller knows its series to be regular). The matched right row travels as a struct, which keeps null
values inside a match apart from "no match".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.plans.skew import running, time_bucket


def _null_struct_like(df: DataFrame, columns: Sequence[str]) -> Column:
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.select(*columns).schema)
    return F.lit(None).cast(f"struct<{fields}>")


def asof_rows(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str,
    right_on: str,
    by: Sequence[str] = (),
    tie_break: Sequence[str] = (),
    known: Column | None = None,
    bucket_micros: int | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """All rows of both sides: ``by``, ``_side`` (0 right, 1 left), the structs ``_left`` and ``_right``, and ``_match``, the last
    right row up to this one. With ``known`` (a condition on right columns) also ``_known``: the number of such right rows so far.
    """
    left_columns = [c for c in left.columns if c not in by]
    right_columns = [c for c in right.columns if c not in by]
    clash = set(left_columns) & set(right_columns)
    if clash:
        raise ValueError(f"as-of sides share columns: {sorted(clash)}")
    names = [f"_tie{i}" for i in range(len(tie_break))]
    counts = known is not None
    stacked = right.filter(F.col(right_on).isNotNull()).select(
        *by,
        F.col(right_on).alias("_ts"),
        F.lit(0).alias("_side"),
        *[F.col(c).alias(n) for c, n in zip(tie_break, names, strict=True)],
        *([F.when(known, 1).otherwise(0).cast("long").alias("_one")] if counts else []),
        _null_struct_like(left, left_columns).alias("_left"),
        F.struct(*right_columns).alias("_right"),
    ).unionByName(
        left.select(
            *by,
            F.col(left_on).alias("_ts"),
            F.lit(1).alias("_side"),
            *[F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in zip(tie_break, names, strict=True)],
            *([F.lit(0).cast("long").alias("_one")] if counts else []),
            F.struct(*left_columns).alias("_left"),
            _null_struct_like(right, right_columns).alias("_right"),
        )
    )
    values = {"_match": ("last", F.col("_right"))} | ({"_known": ("sum", F.col("_one"))} if counts else {})
    return running(
        stacked,
        keys=by,
        bucket=None if bucket_micros is None else time_bucket("_ts", bucket_micros),
        order=[F.col("_ts"), F.col("_side"), *[F.col(n) for n in names]],
        values=values,
        pieces=pieces,
    )


def matched(rows: DataFrame, by: Sequence[str], *keep: str) -> DataFrame:
    """Left rows of ``asof_rows`` with the columns of both sides."""
    sides = [F.col(s)[c].alias(c) for s, t in (("_left", "_left"), ("_match", "_right")) for c in rows.schema[t].dataType.names]
    return rows.filter(F.col("_side") == 1).select(*by, *sides, *keep)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_on: str,
    right_on: str,
    by: Sequence[str] = (),
    tie_break: Sequence[str] = (),
    bucket_micros: int | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Left rows plus the columns of the last right row with ``right_on <= left_on`` in the same key (null keys match each other).

    Among right rows at the same instant the one greatest by ``tie_break`` wins. A left row without a time has no match.
    """
    rows = asof_rows(
        left, right, left_on=left_on, right_on=right_on, by=by, tie_break=tie_break, bucket_micros=bucket_micros, pieces=pieces
    )
    return matched(rows, by)
