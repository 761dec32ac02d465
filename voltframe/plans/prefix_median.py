"""Exact running medians at chosen rows: a binary search for all wanted prefixes at once.

Values are numbered by rank within their key, and the digits of that rank (``bits`` each, the highest
first) form a tree of value buckets. On every level the rows of a node, in time order, are cut into
pieces of ``rows_per_chunk`` rows and counted by (piece, digit). With the counts before its piece and
inside it, a wanted prefix knows which child holds its order statistic, how long the prefix is there
and which rank remains. Only children that a prefix descends to keep their rows. A row travels a
fixed number of times per level, and the number of levels is the number of digits of the largest
rank; nothing is paired and no task holds more than one piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voltframe.plans.skew import with_row_index
from voltframe.session import durable

ROWS_PER_CHUNK = 4096
BITS = 8


def running_median(
    numbered: DataFrame,
    wanted: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    seq: str = "seq",
    rows_per_chunk: int = ROWS_PER_CHUNK,
    bits: int = BITS,
) -> DataFrame:
    """Median of all values up to each wanted position: ``(keys..., seq, running_median)``.

    ``numbered`` holds every non-null value with its 0-based ``seq`` in its key; ``wanted`` holds
    distinct ``(keys..., seq)``. A null key is a key of its own.
    """
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("_"))
    values = numbered.select(key.alias("_k"), F.col(seq).cast("long").alias("_pos"), F.col(value).cast("double").alias("_v"))
    ranked = durable(with_row_index(values, keys=["_k"], order=[F.col("_v"), F.col("_pos")], name="_rank"))
    top = ranked.agg(F.max("_rank")).first()[0] or 0
    levels = max(1, ceil(top.bit_length() / bits))
    digits = max(1, ceil(top.bit_length() / levels))
    node = ["_k", "_node"]
    rows = ranked.select("_k", F.lit(0).cast("long").alias("_node"), "_pos", "_rank")
    at = F.col(seq).cast("long")
    halves = F.array_distinct(F.array(F.floor(at / 2), F.floor((at + 1) / 2)))
    asks = wanted.select(key.alias("_k"), at.alias("_seq"), F.lit(0).cast("long").alias("_node"), (at + 1).alias("_p"), F.explode(halves).alias("_r"))
    for level in range(levels):
        digit = F.shiftright("_rank", digits * (levels - 1 - level)).bitwiseAND(F.lit((1 << digits) - 1)).cast("int")
        rows = rows.withColumn("_piece", F.floor(F.col("_pos") / rows_per_chunk)).withColumn("_digit", digit)
        asks = asks.withColumn("_piece", F.floor((F.col("_p") - 1) / rows_per_chunk))
        before = durable(_counts_before(rows, asks, node, digits))
        asks = durable(_descend(rows, asks, before, node, rows_per_chunk, digits))
        if level < levels - 1:
            rows = durable(_children(rows, asks, before, node, digits))
        asks = asks.withColumn("_node", F.col("_node") * (1 << digits) + F.col("_digit")).drop("_digit")
    found = asks.join(ranked.select("_k", F.col("_rank").alias("_node"), "_v"), ["_k", "_node"])
    medians = found.groupBy("_k", "_seq").agg(((F.min("_v") + F.max("_v")) / 2.0).alias("running_median"))
    return medians.select(*[F.col("_k")[f"k{i}"].alias(k) for i, k in enumerate(keys)], F.col("_seq").alias(seq), "running_median")


def _counts_before(rows: DataFrame, asks: DataFrame, node: list[str], digits: int) -> DataFrame:
    """Rows of each digit before each piece: for the digits a piece holds, and (``_ask``) for all digits of the pieces asked about."""
    cells = rows.groupBy(*node, "_piece", "_digit").agg(F.count(F.lit(1)).alias("_c")).withColumn("_ask", F.lit(False))
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << digits) - 1))).alias("_digit")
    board = asks.select(*node, "_piece").distinct().select(*node, "_piece", every, F.lit(0).cast("long").alias("_c"), F.lit(True).alias("_ask"))
    earlier = Window.partitionBy(*node, "_digit").orderBy("_piece").rangeBetween(Window.unboundedPreceding, -1)
    return cells.unionByName(board).withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).drop("_c")


def _descend(rows: DataFrame, asks: DataFrame, before: DataFrame, node: list[str], rows_per_chunk: int, digits: int) -> DataFrame:
    """Each prefix with the digit of its child, its length there and the rank that remains."""
    active = asks.select(*node, "_piece").distinct()
    known = before.filter("_ask").select(*node, "_piece", F.lit(-1).cast("long").alias("_pos"), "_digit", "_before")
    held = rows.join(active, [*node, "_piece"], "left_semi").select(*node, "_piece", "_pos", "_digit", F.lit(0).cast("long").alias("_before"))
    left = held.unionByName(known).groupBy(*node, "_piece")
    right = asks.select(*node, "_piece", "_seq", "_p", "_r").groupBy(*node, "_piece")
    longs = [T.StructField(c, T.LongType()) for c in ("_node", "_seq", "_p", "_r")]
    schema = T.StructType([T.StructField("_k", asks.schema["_k"].dataType), *longs, T.StructField("_digit", T.IntegerType())])
    return left.cogroup(right).applyInArrow(_stepping(rows_per_chunk, 1 << digits), schema)


def _stepping(rows_per_chunk: int, width: int):
    def step(piece: pa.Table, asks: pa.Table) -> pa.Table:
        pos, digit, before = (piece[c].to_numpy() for c in ("_pos", "_digit", "_before"))
        base = np.zeros(width, np.int64)
        base[digit[pos < 0]] = before[pos < 0]
        own = digit[pos >= 0][np.argsort(pos[pos >= 0])]
        upto = np.zeros((len(own) + 1, width), np.int32)
        upto[np.arange(1, len(own) + 1), own] = 1
        np.cumsum(upto, axis=0, out=upto)
        p, r, number = (asks[c].to_numpy() for c in ("_p", "_r", "_piece"))
        chosen, length, rank = np.empty(len(p), np.int32), np.empty(len(p), np.int64), np.empty(len(p), np.int64)
        for i in range(0, len(p), rows_per_chunk):
            part = slice(i, i + rows_per_chunk)
            counts = base + upto[p[part] - number[part] * rows_per_chunk]
            sums = counts.cumsum(axis=1)
            child = (sums <= r[part, None]).sum(axis=1)
            line = np.arange(len(child))
            chosen[part], length[part] = child, counts[line, child]
            rank[part] = r[part] - (sums[line, child] - counts[line, child])
        columns = [asks["_k"], asks["_node"], asks["_seq"], pa.array(length), pa.array(rank), pa.array(chosen)]
        return pa.table(columns, names=["_k", "_node", "_seq", "_p", "_r", "_digit"])

    return step


def _children(rows: DataFrame, asks: DataFrame, before: DataFrame, node: list[str], digits: int) -> DataFrame:
    """Rows of the children that a prefix goes to, numbered by their place in time there."""
    chosen = asks.select(*node, "_digit").distinct()
    cells = before.filter("not _ask").drop("_ask").join(chosen, [*node, "_digit"], "left_semi")
    inside = Window.partitionBy(*node, "_piece", "_digit").orderBy("_pos")
    return rows.join(cells, [*node, "_piece", "_digit"]).select(
        "_k",
        (F.col("_node") * (1 << digits) + F.col("_digit")).alias("_node"),
        (F.col("_before") + F.row_number().over(inside) - 1).alias("_pos"),
        "_rank",
    )
