"""Plan building blocks that keep ordered per-key work parallel inside one hot key.

A plain ``Window.partitionBy(key).orderBy(time)`` puts every row of a key into one task. The
helpers here split a key along its order instead and exchange only small summaries between the
pieces:

``in_pieces``         runs of about equal size in (key, order), by sampled range boundaries
``running``           last value, minimum or sum so far, from per-bucket results plus a bucket summary
``carry_forward``     last non-null value so far; ``lagged``: previous row's value
``with_row_index``    exact 0-based position of a row inside its key
``with_halo_chunks``  copies of the few rows a sliding frame needs from the neighbouring piece
``order_statistics``  exact ranks and quantiles without gathering a group

Bucket summaries hold one row per (key, bucket). With time buckets their number is bounded by the
covered time span, with pieces by the number of keys plus the number of pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from voltframe.session import durable

MICROS_PER_SECOND = 1_000_000
DAY_MICROS = 86_400 * MICROS_PER_SECOND
HOUR_MICROS = 3_600 * MICROS_PER_SECOND


def time_bucket(ts: Column | str, width_micros: int = DAY_MICROS) -> Column:
    """Ordinal of the fixed-width time bucket that holds ``ts`` (floors below the epoch too)."""
    micros = F.unix_micros(ts)
    return ((micros - F.pmod(micros, F.lit(width_micros))) / F.lit(width_micros)).cast("long")


def gather(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring equal keys into one partition for a per-partition task.

    Partitioning by a hash expression is never mistaken for a partitioning the input already has,
    so neither the planner nor adaptive execution drops this exchange.
    """
    return df.repartition(F.xxhash64(*keys))


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[Column], pieces: int | None = None) -> DataFrame:
    """The rows in ``_piece`` runs of about equal size in (keys, order), by range boundaries sampled from the rows themselves.

    However rows crowd in time or on one key, a piece holds its share; rows equal in keys and order are split by their place in the
    input. The result is stored, as boundaries drawn again would differ. ``pieces`` defaults to the session's shuffle partitions.
    """
    count = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(count, *keys, *order, "_place").drop("_place")
    return durable(dealt.withColumn("_piece", F.spark_partition_id()))


def _located(df: DataFrame, keys: Sequence[str], bucket: Column | None, order: Sequence[Column], pieces: int | None = None) -> DataFrame:
    """Add ``_at``: keys and bucket as one struct, so that a null key is a key like any other (structs compare nulls as equal)."""
    if bucket is None:
        df, bucket = in_pieces(df, keys, order, pieces), F.col("_piece")
    located = df.withColumn("_at", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("bucket")))
    return located.drop("_piece")


def _summaries(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*[F.col("_at")[f"k{i}"] for i in range(len(keys))])


# Kind of a running value: inside a bucket, as a summary of a bucket, over earlier summaries, and both together.
RUNNING: dict[str, tuple[Callable, Callable, Callable, Callable]] = {
    "last": (
        lambda v: F.last(v, ignorenulls=True), lambda v, rank: F.max_by(v, F.when(F.col(v).isNotNull(), rank)),
        lambda v: F.last(v, ignorenulls=True), F.coalesce,
    ),
    "min": (F.min, lambda v, rank: F.min(v), F.min, F.least),
    "sum": (F.sum, lambda v, rank: F.sum(v), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def running(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[Column],
    values: Mapping[str, tuple[str, Column]],
    bucket: Column | None = None,
    inclusive: bool = True,
    pieces: int | None = None,
) -> DataFrame:
    """Add running values per key in ``order``: ``values`` maps a name to a kind (last non-null, min, sum) and a column.

    Every (key, bucket) is windowed on its own and one summary row per (key, bucket) carries what came before. ``bucket`` must be
    monotone in ``order``; without one, rows are dealt to pieces of equal size (``in_pieces``), so a crowded hour is split as well.
    """
    staged = _located(df, keys, bucket, order, pieces).withColumns({f"_v_{n}": v for n, (_, v) in values.items()})
    end = Window.currentRow if inclusive else -1
    local = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    earlier = _summaries(keys).orderBy(F.col("_at")["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    summary = staged.groupBy("_at").agg(*[RUNNING[kind][1](f"_v_{n}", rank).alias(f"_s_{n}") for n, (kind, _) in values.items()])
    carried = summary.select("_at", *[RUNNING[kind][2](f"_s_{n}").over(earlier).alias(f"_c_{n}") for n, (kind, _) in values.items()])
    inside = staged.withColumns({f"_l_{n}": RUNNING[kind][0](f"_v_{n}").over(local) for n, (kind, _) in values.items()})
    both = inside.join(carried, "_at", "left").withColumns(
        {n: RUNNING[kind][3](F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, (kind, _) in values.items()}
    )
    return both.drop("_at", *[f"_{x}_{n}" for n in values for x in "vcl"])


def carry_forward(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    bucket: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add ``name``: the last non-null ``value`` up to this row (before it if not ``inclusive``); see ``running``."""
    return running(df, keys=keys, order=order, values={name: ("last", value)}, bucket=bucket, inclusive=inclusive)


def lagged(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    bucket: Column | None = None,
) -> DataFrame:
    """Add the previous row's ``value`` (never null in the input) inside its key."""
    return carry_forward(
        df, keys=keys, bucket=bucket, order=order, value=value, name=name, inclusive=False
    )


def with_row_index(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column | None = None,
    name: str = "row_index",
    total: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Add the exact 0-based position in ``order`` inside ``keys`` and, on request, the key's size.

    Counts per (key, bucket) are combined before the shuffle; their running sum gives each bucket
    its starting position, so no task ever sees a whole key. Buckets and null keys are those of ``running``.
    """
    staged = _located(df, keys, bucket, order, pieces)
    counts = staged.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    whole = _summaries(keys)
    earlier = whole.orderBy(F.col("_at")["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_at",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        *([F.sum("_n").over(whole).alias(total)] if total else []),
    )
    local = Window.partitionBy("_at").orderBy(*order)
    return (
        staged.withColumn("_rn", F.row_number().over(local))
        .join(offsets, "_at")
        .withColumn(name, F.col("_offset") + F.col("_rn") - F.lit(1))
        .drop("_at", "_rn", "_offset")
    )


def grid_position(ts: Column | str, step_micros: int) -> Column:
    """Absolute position of a timestamp on a fixed-step grid; row offsets equal position offsets."""
    return time_bucket(ts, step_micros)


def with_halo_chunks(
    df: DataFrame,
    pos: str,
    *,
    before: int,
    after: int = 0,
    rows_per_chunk: int | None = None,
) -> tuple[DataFrame, str, str]:
    """Copy each row into its own chunk and into the chunks whose frames reach back to it.

    Returns the frame plus the names of the chunk column and of the flag that marks a chunk's own
    rows. Windows partition by (key, chunk); afterwards ``filter(own)`` drops the copies. With the
    default chunk of four halos the copies add a quarter to the rows.
    """
    size = rows_per_chunk or max(4 * (before + after), 1024)

    def chunk_of(column: Column) -> Column:
        return ((column - F.pmod(column, F.lit(size))) / F.lit(size)).cast("long")

    p = F.col(pos)
    first, last = chunk_of(p - F.lit(after)), chunk_of(p + F.lit(before))
    out = df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_chunk") == chunk_of(p)
    )
    return out, "_chunk", "_own"


NAN_BUCKET = 1 << 40
# Distinct values that one task sorts at most, parts a crowded bucket is split into, and salts of the join with its bounds.
SORTED_CELLS, PARTS, SALTS = 1 << 18, 1024, 16


def value_bucket(value: Column, resolution: int = 1024) -> Column:
    """Order-preserving bucket of a double: ``resolution`` buckets per doubling of magnitude; NaN, the greatest value, has its own."""
    magnitude = F.floor(F.log2(F.lit(1.0) + F.abs(value) * F.lit(1e6)) * F.lit(float(resolution)))
    bounded = F.least(magnitude, F.lit(NAN_BUCKET - 1))
    return F.when(F.isnan(value), F.lit(NAN_BUCKET)).when(value < 0, -bounded).otherwise(bounded)


def order_statistics(
    df: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    sorted_cells: int = SORTED_CELLS,
) -> DataFrame:
    """Exact order statistics per key; ``ranks`` maps a name to a 0-based rank given the count.

    Equal values are merged first (that shuffle is keyed by the value, so it cannot pile up). Value buckets are counted and only the
    buckets that hold a wanted rank stay. Where one of them has more than ``sorted_cells`` distinct values, all that stay are split
    into parts of equal width between their least and greatest value and counted again, until each is small enough to sort.
    Fractional ranks interpolate linearly. Nulls do not count, a null key is a key, and NaN is the greatest value.
    """
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("_"))
    # ``_base`` counts the values below the part that a bucket belongs to; it names the part.
    cells = durable(
        df.filter(F.col(value).isNotNull())
        .groupBy(key.alias("_k"), F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .select("_k", "_v", "_c", F.lit(0).cast("long").alias("_base"), value_bucket(F.col("_v")).alias("_vb"), F.lit(None).cast("long").alias("_n"))
    )
    while True:
        targets = durable(_wanted_buckets(cells, list(ranks.values())))
        if targets.filter(F.col("_d") > sorted_cells).isEmpty():
            break
        cells = durable(_inside(cells, targets).withColumn("_vb", _part(F.col("_v"), F.col("_a"), F.col("_b"))).drop("_a", "_b"))
    upto = Window.partitionBy("_k", "_base").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        _inside(cells, targets)
        .withColumn("_end", F.col("_base") + F.sum("_c").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    aggregates, results = [], []
    for name, rank in ranks.items():
        r = rank(F.col("_n")).cast("double")
        for side, at in (("f", F.floor(r)), ("c", F.ceil(r))):
            hit = (at.cast("long") >= F.col("_start")) & (at.cast("long") < F.col("_end"))
            aggregates.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
        aggregates.append(F.max(r - F.floor(r)).alias(f"_w_{name}"))
        low, high, weight = F.col(f"_f_{name}"), F.col(f"_c_{name}"), F.col(f"_w_{name}")
        results.append(F.when(low == high, low).otherwise(low + (high - low) * weight).alias(name))
    grouped = spans.groupBy("_k").agg(*aggregates, F.max("_n").alias("n"))
    return grouped.select(*[F.col("_k")[f"k{i}"].alias(k) for i, k in enumerate(keys)], *results, "n")


def _part(v: Column, least: Column, most: Column) -> Column:
    """Part of a bucket by equal width; the least and the greatest value have parts of their own, so that any two values separate in
    time, also infinite ones. Halves keep the width of a bucket finite where its ends are.
    """
    share = F.nanvl(F.try_divide(v / 2 - least / 2, most / 2 - least / 2), F.lit(0.0))
    inner = F.least(F.floor(share * PARTS), F.lit(PARTS - 1))
    return F.when(v == least, F.lit(-1)).when(v == most, F.lit(PARTS)).otherwise(inner).cast("long")


def _wanted_buckets(cells: DataFrame, ranks: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """Buckets that hold a wanted rank: count below them, distinct values, least and greatest value."""
    part = Window.partitionBy("_k", "_base")
    upto = part.orderBy("_vb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = cells.groupBy("_k", "_base", "_vb").agg(
        F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.max("_n").alias("_n")
    )
    placed = counted.withColumns(
        {"_n": F.coalesce("_n", F.sum("_c").over(part)), "_hi": F.col("_base") + F.sum("_c").over(upto)}
    ).withColumn("_lo", F.col("_hi") - F.col("_c"))
    wanted = [rounding(rank(F.col("_n")).cast("double")).cast("long") for rank in ranks for rounding in (F.floor, F.ceil)]
    holds = F.exists(F.array(*wanted), lambda r: (r >= F.col("_lo")) & (r < F.col("_hi")))
    return placed.filter(holds).select("_k", "_base", "_vb", "_n", "_lo", "_d", "_a", "_b")


def _inside(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells of the wanted buckets, each bucket now a part of its own; salted, as a bucket may hold most of the cells."""
    salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = cells.drop("_n").withColumn("_salt", F.pmod(F.hash("_v"), F.lit(SALTS)))
    joined = dealt.join(salted, ["_k", "_base", "_vb", "_salt"])
    return joined.select("_k", "_v", "_c", F.col("_lo").alias("_base"), "_vb", "_n", "_a", "_b")


def quantile_rank(probability: float) -> Callable[[Column], Column]:
    """Rank of the linearly interpolated quantile, as numpy and ``percentile`` define it."""
    return lambda n: (n - F.lit(1)) * F.lit(float(probability))
