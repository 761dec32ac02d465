"""Exact top-k search by inner product over a vector-approximation file.

Every distinct vector is approximated by one small cell number per component. A search scans the approximations of all vectors in
blocks for bounds of the score, then reads exact vectors in the order of their upper bounds until nothing unread can reach the k-th
score. Queries and approximations meet in a grid of (block, stripe) groups of bounded size; exact vectors are only joined where read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltframe.llm.common import prepare, spread_join, stored

K = 5
EVERY = 50
SCALE = 256
BITS = 6
# Cell edges are quantiles of a sample of about this many vectors (fewer if they are wide); the outer edges are exact.
SAMPLE = 8192
SAMPLE_VALUES = 1 << 22
# Largest groups of the grid, and the vectors from which another block pays off.
BLOCK, STRIPE, SMALL_BLOCK = 1 << 20, 1 << 18, 1 << 13
# Vectors and scores of one matrix product in a task.
CHUNK, SCORES = 1 << 14, 1 << 21
# Vectors a query reads in its first round and at most in one round.
FIRST_READ, MOST_READ = 32, 1 << 15
NO_BOUND = -(1 << 63)
ENTRIES = "array<struct<score: bigint, none: boolean, id: bigint, _c: bigint>>"


def pack(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cell numbers (rows x components) as rows of bytes with ``bits`` bits a component."""
    spread = np.unpackbits(cells.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits :]
    return np.packbits(spread.reshape(len(cells), cells.shape[1] * bits), axis=1)


def unpack(packed: np.ndarray, dim: int, bits: int) -> np.ndarray:
    spread = np.unpackbits(packed, axis=1, count=dim * bits).reshape(len(packed), dim, bits)
    return (spread * (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))).sum(axis=2, dtype=np.uint8)


@dataclass(frozen=True)
class Cells:
    """The cells of every component: the least and the greatest integer in each. ``low`` and ``high`` are (components x cells)."""

    low: np.ndarray
    high: np.ndarray
    bits: int
    number: type

    @classmethod
    def fit(cls, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int) -> Cells:
        """Cells about equally filled by the sample (rows x components); ``least`` and ``most`` are those of all rows."""
        count = 1 << bits
        low = np.zeros((len(least), count), np.int64)
        high = np.zeros_like(low)
        ranked = np.sort(sample, axis=0)
        picks = ranked[(np.arange(1, count) * len(ranked)) // count] if len(ranked) else np.zeros((0, len(least)), np.int64)
        for j in range(len(least)):
            inner = np.unique(picks[:, j])
            edges = np.concatenate(([least[j]], inner[(inner > least[j]) & (inner <= most[j])]))
            low[j], high[j] = most[j], most[j]
            low[j, : len(edges)] = edges
            high[j, : len(edges)] = [*(edges[1:] - 1), most[j]]
        reach = max(1, int(np.abs(np.concatenate((least, most))).max(initial=0)))
        width = reach * reach * max(1, len(least))
        return cls(low, high, bits, np.float32 if width < 1 << 23 else np.float64 if width < 1 << 52 else np.int64)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(vectors.shape, np.uint8)
        for j in range(vectors.shape[1]):
            last = int(np.searchsorted(self.low[j], self.low[j, -1], side="left"))
            out[:, j] = np.searchsorted(self.low[j, : last + 1], vectors[:, j], side="right") - 1
        return out

    def sides(self, cells: np.ndarray) -> np.ndarray:
        """Upper and lower corners of the cells side by side: (rows x 2 components)."""
        at = (np.arange(len(self.low)) * self.low.shape[1])[None, :] + cells
        return np.concatenate((self.high.ravel()[at], self.low.ravel()[at]), axis=1).astype(self.number)

    def queries(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Factors that give the upper and the lower bound of the inner product with a row of ``sides``."""
        plus, minus = np.maximum(vectors, 0).astype(self.number), np.minimum(vectors, 0).astype(self.number)
        return np.concatenate((plus, minus), axis=1), np.concatenate((minus, plus), axis=1)


def scan(cells: Cells, dim: int, keep: int, read: int, first: bool, left: pa.Table, right: pa.Table) -> pa.Table:
    """Bounds of all queries of a stripe (``right``) against one block of approximations (``left``).

    Per query: the ``keep`` greatest lower bounds (first round only), and of the vectors beyond its cursor whose upper bound reaches
    the greatest known k-th lower bound the ``read`` first by descending upper bound and ascending number.
    """
    if not left.num_rows or not right.num_rows:
        return pa.schema([("_q", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("_lows", "_c", "_u"))]).empty_table()
    numbers = left["_c"].to_numpy()
    order = np.argsort(numbers, kind="stable")
    numbers = numbers[order]
    width = (dim * cells.bits + 7) // 8
    packed = np.frombuffer(b"".join(left["_a"].to_pylist()), np.uint8).reshape(-1, width)[order]
    asking = right["_q"].to_numpy()
    vectors = np.frombuffer(b"".join(right["_v"].to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)
    tau, cursor_u, cursor_c = (right[c].to_numpy().copy() for c in ("_tau", "_cu", "_cc"))
    best_low = np.full((len(asking), keep), NO_BOUND, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asking)
    for at in range(0, len(numbers), CHUNK):
        own = numbers[at : at + CHUNK]
        sides = cells.sides(unpack(packed[at : at + CHUNK], dim, cells.bits)).T
        step = max(1, SCORES // len(own))
        for q in range(0, len(asking), step):
            upper, lower = cells.queries(vectors[q : q + step])
            here = slice(q, q + len(upper))
            if first:
                lows = lower @ sides
                take = min(keep, lows.shape[1])
                lows = np.partition(lows, lows.shape[1] - take, axis=1)[:, lows.shape[1] - take :].astype(np.int64)
                best_low[here] = np.sort(np.concatenate((best_low[here], lows), axis=1), axis=1)[:, -keep:]
                tau[here] = np.maximum(tau[here], best_low[here, 0])
            ups = upper @ sides
            near = ups >= tau[here, None]
            for i in np.flatnonzero(near.any(axis=1)):
                cols = np.flatnonzero(near[i])
                u, c = ups[i, cols].astype(np.int64), own[cols]
                ahead = (u < cursor_u[q + i]) | ((u == cursor_u[q + i]) & (c > cursor_c[q + i]))
                u, c = np.concatenate((found[q + i][0], u[ahead])), np.concatenate((found[q + i][1], c[ahead]))
                if len(u) > read:
                    first_ones = np.lexsort((c, -u))[:read]
                    u, c = u[first_ones], c[first_ones]
                found[q + i] = (u, c)
    for i, (u, c) in enumerate(found):
        fit = u >= tau[i]
        found[i] = (u[fit], c[fit])
    ends = np.cumsum([0, *(len(u) for u, _ in found)]).astype(np.int32)
    lows = [row[row > NO_BOUND].tolist() for row in best_low] if first else [[]] * len(asking)
    return pa.table(
        {
            "_q": asking,
            "_lows": pa.array(lows, pa.list_(pa.int64())),
            "_c": pa.ListArray.from_arrays(ends, np.concatenate([c for _, c in found])),
            "_u": pa.ListArray.from_arrays(ends, np.concatenate([u for u, _ in found])),
        }
    )


def _scanning(cells: Cells, dim: int, keep: int, read: int, first: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return scan(cells, dim, keep, read, first, left, right)

    return run


def _as_bytes(rows: DataFrame) -> DataFrame:
    """``_v`` (array of integers) as little-endian bytes, so that tasks read it without one object a number."""

    def turning(batches):
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("_v"))
            flat = v.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            ends = (np.concatenate(([0], np.cumsum(pc.list_value_length(v).to_numpy(zero_copy_only=False)))) * 4).astype(np.int64)
            raw = pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([raw if n == "_v" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    schema = ", ".join(f"{n} {'binary' if n == '_v' else t}" for n, t in rows.dtypes)
    return rows.mapInArrow(turning, schema)


def _approximate(classes: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """The approximation file: number and packed cells of every distinct vector."""

    def packing(batches):
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            packed = pack(cells.of(vectors), cells.bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in packed], pa.binary())], names=["_c", "_a"])

    return classes.select("_c", "_v").mapInArrow(packing, "_c long, _a binary")


def _search(classes: DataFrame, dim: int, n: int, asked: int, k: int, bits: int, first_read: int) -> DataFrame:
    """``_q, _best`` for every asked class of one length: its ``k + 1`` best (score, id, class) entries, read in order of bounds."""
    spark = classes.sparkSession
    ranges = classes.select(F.posexplode("_v").alias("j", "x")).groupBy("j").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("j").collect()
    least, most = (np.array([r[c] for r in ranges], np.int64) for c in ("a", "b"))
    want = min(SAMPLE, max(256, SAMPLE_VALUES // dim))
    share = min(1 << 30, ceil((1 << 30) * want / n))
    sample = classes.filter(F.pmod(F.xxhash64("_v"), F.lit(1 << 30)) < share).select("_v").toArrow()["_v"].combine_chunks()
    sample = sample.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
    cells = Cells.fit(sample, least, most, bits)
    tasks = spark.sparkContext.defaultParallelism
    blocks = max(ceil(n / BLOCK), min(tasks, ceil(n / SMALL_BLOCK)))
    stripes = ceil(asked / STRIPE)

    def dealt(number: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.col(number)), F.lit(parts)).cast("int")

    def everywhere(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    file = stored(_approximate(classes, cells, dim).withColumn("_block", dealt("_c", blocks)))
    questions = stored(_as_bytes(classes.filter("_asks > 0").select(F.col("_c").alias("_q"), "_v")).withColumn("_stripe", dealt("_q", stripes)))
    least_bound, nothing = F.lit(NO_BOUND).cast("long"), F.array().cast(ENTRIES)
    state = questions.select(
        "_q", "_v", "_stripe", least_bound.alias("_tau"), F.lit((1 << 63) - 1).alias("_cu"), least_bound.alias("_cc"),
        nothing.alias("_best"),
    )
    asked_vectors = classes.filter("_asks > 0").select(F.col("_c").alias("_q"), F.col("_v").alias("_w"))
    finished, read, first = [], first_read, True
    while True:
        left = file.withColumn("_stripe", everywhere(stripes)).groupBy("_block", "_stripe")
        right = state.drop("_best").withColumn("_block", everywhere(blocks)).groupBy("_block", "_stripe")
        met = left.cogroup(right).applyInArrow(_scanning(cells, dim, k + 1, read, first), "_q long, _lows array<bigint>, _c array<bigint>, _u array<bigint>")
        merged = met.groupBy("_q").agg(
            F.flatten(F.collect_list("_lows")).alias("_lows"),
            F.flatten(F.collect_list(F.arrays_zip("_u", "_c"))).alias("_near"),
        )
        bound = F.get(F.sort_array("_lows", asc=False), F.lit(k))
        enough = F.size("_lows") > k
        ordered = F.array_sort(
            F.transform(F.filter("_near", lambda x: x["_u"] >= F.col("_bound")), lambda x: F.struct((-x["_u"]).alias("d"), x["_c"].alias("c")))
        )
        merged = (
            merged.withColumn("_bound", F.when(enough, bound).otherwise(least_bound))
            .withColumn("_near", ordered)
            .select("_q", "_bound", (F.size("_near") < read).alias("_all"), F.slice("_near", 1, read).alias("_near"))
        )
        merged = stored(merged)
        reads = merged.select("_q", F.explode("_near").alias("_n")).select("_q", F.col("_n.c").alias("_c"))
        product = F.aggregate(F.zip_with("_v", "_w", lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda s, x: s + x)
        exact = (
            reads.join(classes.select("_c", "_v", "_ids"), "_c")
            .join(asked_vectors, "_q")
            .select("_q", F.transform("_ids", lambda i: F.struct((-product).alias("score"), i.isNull().alias("none"), i.alias("id"), F.col("_c"))).alias("_e"))
            .groupBy("_q")
            .agg(F.flatten(F.collect_list("_e")).alias("_e"))
        )
        best = F.slice(F.array_sort(F.concat("_best", F.coalesce("_e", nothing))), 1, k + 1)
        reached = F.when(F.size("_best") > k, -F.get("_best", F.lit(k))["score"]).otherwise(least_bound)
        last = F.get("_near", F.size("_near") - 1)
        after = (
            state.join(merged, "_q")
            .join(exact, "_q", "left")
            .withColumn("_best", best)
            .withColumn("_tau", F.greatest("_tau", "_bound", reached))
            .withColumn("_done", F.col("_all") | (F.coalesce(-last["d"], least_bound) < F.col("_tau")))
            .select("_q", "_v", "_stripe", "_tau", F.coalesce(-last["d"], "_cu").alias("_cu"), F.coalesce(last["c"], "_cc").alias("_cc"), "_best", "_done")
        )
        after = stored(after)
        finished.append(after.filter("_done").select("_q", "_best"))
        state = after.filter("not _done").drop("_done")
        if state.isEmpty():
            break
        read, first = min(4 * read, MOST_READ), False
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def top_inner_products(
    rows: DataFrame, asks: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, bits: int = BITS,
    first_read: int = FIRST_READ,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest integer inner products of each row that asks with all other rows.

    Components count as ``floor(scale * x)``. ``asks`` is a condition on ``vec_id``; null asks nothing. Ties go to the smaller id, null
    ids last. Vectors that are null, empty, or hold null or non-finite components take no part; vectors of different lengths are not
    compared. Repeated rows (id and vector) count once; rows that share only their id are different rows. Fewer than ``k`` other rows give
    all of them. Scores beyond 64 bits are an error. Equal vectors are searched once, as one class with its ``k + 1`` smallest ids.
    """
    spark = prepare(rows.sparkSession)
    element = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    usable = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_x")).filter((F.size("_x") > 0) & F.forall("_x", element))
    whole = usable.select("vec_id", F.transform("_x", lambda x: F.floor(x.cast("double") * scale)).alias("_v"))
    reach = F.array_max(F.transform("_v", lambda x: F.abs(x.cast("double"))))
    lengths = whole.groupBy(F.size("_v").alias("d")).agg(F.max(reach).alias("m")).collect()
    for r in lengths:
        if r["m"] >= 2**31 or r["m"] ** 2 * r["d"] >= 2**63:
            raise ValueError(f"inner products of vectors of length {r['d']} do not fit 64 bits (greatest component {r['m']:g})")
    entries = whole.select("vec_id", F.col("_v").cast("array<int>").alias("_v")).distinct()
    first_ids = Window.partitionBy("_v").orderBy(F.col("vec_id").asc_nulls_last())
    classes = (
        entries.withColumn("_r", F.row_number().over(first_ids))
        .filter(F.col("_r") <= k + 1)
        .groupBy("_v")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "vec_id"))), lambda e: e["vec_id"]).alias("_ids"))
    )
    asking = entries.filter(asks)
    asked = asking.groupBy("_v").agg(F.count(F.lit(1)).alias("_asks"))
    classes = classes.join(asked, "_v", "left").select("_v", "_ids", F.coalesce("_asks", F.lit(0)).alias("_asks"), F.size("_v").alias("_d"))
    classes = stored(classes.withColumn("_c", F.monotonically_increasing_id()))
    parts = classes.groupBy("_d").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_asks") > 0, 1)).alias("q"), F.sum("_asks").alias("total")).collect()
    out = None
    for p in sorted(parts, key=lambda p: p["_d"]):
        if not p["q"]:
            continue
        own = classes.filter(F.col("_d") == p["_d"])
        found = _search(own, p["_d"], p["n"], p["q"], k, bits, first_read)
        groups = stored(found.join(own.filter("_asks > 0").select(F.col("_c").alias("_q"), "_v", "_asks"), "_q").select("_v", "_asks", "_q", "_best"))
        members = asking.filter(F.size("_v") == p["_d"]).select("vec_id", "_v")
        each = spread_join(members, groups, ["_v"], "_asks", p["total"], F.col("vec_id"))
        others = F.filter("_best", lambda e: ~(e["id"].eqNullSafe(F.col("vec_id")) & (e["_c"] == F.col("_q"))))
        named = each.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("_p", "_e"))
        result = named.select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_e.id").alias("vec_id"), (-F.col("_e.score")).alias("score"))
        out = result if out is None else out.unionByName(result)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors, by integer inner product, of every vector whose id is divisible by 50."""
    return top_inner_products(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
