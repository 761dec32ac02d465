"""SimHash near-duplicates by exact comparison of tiles of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from voltframe.llm.common import documents, spread_join, stored
from voltframe.llm.components import connected

RADIUS = 2
SHINGLE = 3
SEED = 42
PARTS, PART_BITS = 4, 16
TILE = 2048
COMPARE_ROWS = 256


def simhash(text: str | None) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for no words.

    Letters A-Z count as lower case and words are split at ASCII white space; a text of fewer words than a
    shingle is one shingle. A bit is 1 where over half of the shingles' XXH64 (seed 42) have it.
    """
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(joined.__getitem__, map(slice, starts[:n], ends[min(SHINGLE, len(words)) - 1 :]))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((simhash(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["_id", "_fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _fp``: one row per input row, the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_fp", T.LongType())])
    return rows.mapInArrow(_fingerprint_batches, schema)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) among n nodes, thinned to one link from each node to the smallest of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def compare_tiles(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius between two tiles, by exclusive-or and bit counts, thinned to a forest."""
    found = []
    for at in range(0, len(left), COMPARE_ROWS):
        near = np.bitwise_count(left[at : at + COMPARE_ROWS, None] ^ right[None, :]) <= radius
        x, y = np.nonzero(near)
        found.append((x + at, y + len(left)))
    i, j = (np.concatenate(z) for z in zip(*found))
    nodes = np.concatenate([left, right])
    i, j = i[nodes[i] != nodes[j]], j[nodes[i] != nodes[j]]
    if len(i) > len(nodes):
        # A tile met with itself names each node twice; take both names as one node.
        _, same = np.unique(nodes, return_inverse=True)
        values = np.unique(nodes)
        u, v = forest(same[i], same[j], len(values))
        return values[u], values[v]
    return nodes[i], nodes[j]


def _tile_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for a, b in zip(batch.column(0), batch.column(1)):
                left, right = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))
                if len(left) and len(right):
                    u, v = compare_tiles(left, right, radius)
                    if len(u):
                        us.append(u)
                        vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64))], names=["a", "b"]
                )

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``_fp``) that join all pairs within the radius.

    A tile holds the fingerprints with the same four population counts, one per 16-bit part. The counts of two
    fingerprints within the radius differ by no more than the radius in sum, so all other tile pairs are skipped. There are
    at most 17^4 tiles; their sizes are broadcast. A tile above ``tile`` fingerprints is split into blocks, and each pair
    of blocks is compared by itself. Blocks emit a forest of their links, so dense groups stay linear.
    """
    parts = [F.bit_count(F.shiftrightunsigned("_fp", PART_BITS * i).bitwiseAND(F.lit((1 << PART_BITS) - 1))).alias(f"_c{i}") for i in range(PARTS)]
    counts = [f"_c{i}" for i in range(PARTS)]
    placed = prints.select("_fp", *parts)
    sizes = placed.groupBy(*counts).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("_blocks"))
    blocks = (
        placed.join(F.broadcast(sizes), counts)
        .groupBy(*counts, "_blocks", F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int").alias("_block"))
        .agg(F.collect_list("_fp").alias("_fps"))
    )
    blocks = stored(blocks)
    steps = [s for s in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius and s >= (0,) * PARTS]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"s{i}") for i, v in enumerate(s)]) for s in steps])).alias("_s")
    left = blocks.select(*counts, F.col("_block").alias("_own"), F.col("_fps").alias("_left"), step)
    same = F.lit(True)
    for i in range(PARTS):
        same = same & (F.col(f"_s.s{i}") == 0)
    left = left.select("_own", "_left", same.alias("_same"), *[(F.col(f"_c{i}") + F.col(f"_s.s{i}")).alias(f"_c{i}") for i in range(PARTS)])
    met = left.join(F.broadcast(sizes), counts).select(
        *counts, "_left", F.explode(F.sequence(F.when(F.col("_same"), F.col("_own")).otherwise(F.lit(0)), F.col("_blocks") - 1)).alias("_block")
    )
    pairs = met.join(blocks.select(*counts, "_block", "_fps"), [*counts, "_block"]).select("_left", F.col("_fps").alias("_right"))
    return pairs.mapInArrow(_tile_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``id, fingerprint, component_id`` per input row: groups of texts linked by fingerprints within ``radius`` bits.

    Equal fingerprints become one before anything is compared, so groups of copies cost nothing. The component's id is
    the smallest id reachable. Null and empty texts have fingerprint 0 and are linked like others; null ids are
    never smallest (a component of null ids only has a null id). Repeated rows share a component. An empty table gives none.
    """
    prints = stored(fingerprints(docs, id_col, text_col))
    distinct = stored(prints.groupBy("_fp").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    roots = stored(
        connected(near_links(distinct.select("_fp"), radius), "a", "b").select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    )
    lowest = stored(
        roots.join(distinct.select("_fp", "_first"), "_fp")
        .groupBy("_root")
        .agg(F.min("_first").alias("_component"), F.count(F.lit(1)).alias("_members"))
    )
    total = lowest.agg(F.sum("_members")).first()[0] or 0
    named = spread_join(roots, lowest, ["_root"], "_members", total, F.col("_fp")).select("_fp", "_component")
    groups = stored(
        distinct.join(named, "_fp", "left").select("_fp", "_n", F.coalesce("_component", "_first").alias("_component"))
    )
    rows = groups.agg(F.sum("_n")).first()[0] or 0
    joined = spread_join(prints, groups, ["_fp"], "_n", rows, F.col("_id"))
    return joined.select(
        F.col("_id").alias("id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
