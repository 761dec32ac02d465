"""Ranked lexical search: best-first search over document intervals, bounded by range maxima of posting lists.

Documents are dealt to shards. A shard holds a posting list per query term in document order with integer impacts, and sparse tables
that name the greatest impact of any range of a list. The sum of a query's range maxima bounds every document of an interval; the
interval of the greatest bound is split at the document of its greatest impact until no bound can reach the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltframe.llm.common import documents, prepare, stored

K = 10
# Query terms are broadcast up to these bounds; beyond them documents' terms are joined by shuffle.
VOCABULARY_TERMS, VOCABULARY_BYTES = 1 << 18, 1 << 24
# Items of a block; documents and postings of a shard at most, and documents from which another shard pays off.
ITEM_BLOCK, SHARD_DOCS, SHARD_POSTINGS, SMALL_SHARD = 512, 1 << 14, 1 << 21, 1 << 11
# Intervals split at once (after a slow start), cells of one vectorised step, and of all open intervals of a search.
BATCH, CELLS, FRONTIER = 256, 1 << 16, 1 << 22
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in SEPARATORS else b for b in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    """Runs of letters and digits of ASCII and of anything beyond ASCII, only A-Z lower-cased."""
    return raw.translate(FOLD).split() if raw else []


class Shard:
    """Posting lists of one shard, one after another, and sparse tables of the place of the greatest impact."""

    def __init__(self, lengths: np.ndarray, docs: np.ndarray, terms: np.ndarray, counts: np.ndarray, total: int, n_docs: int):
        """``lengths`` of the documents in rank order; a posting is (document, term, count); ``total`` and ``n_docs`` of the corpus."""
        norm = 25 + (75 * lengths * n_docs) // max(1, total)
        order = np.lexsort((docs, terms))
        self.docs, terms, counts = docs[order], terms[order], counts[order].astype(np.int64)
        self.size = max(1, len(lengths))
        self.impact = (1_000_000_000 * counts) // (1000 * counts + 8 * norm[self.docs])
        self.terms, self.starts = np.unique(terms, return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))
        self.keys = np.repeat(np.arange(len(self.terms)), self.ends - self.starts) * self.size + self.docs
        longest = int((self.ends - self.starts).max(initial=1))
        level = np.arange(len(terms), dtype=np.int32)
        levels = [level]
        for k in range(longest.bit_length() - 1):
            ahead = np.concatenate((level[1 << k :], level[len(level) - (1 << k) :] if 1 << k <= len(level) else level))[: len(level)]
            level = np.where(self.impact[level] >= self.impact[ahead], level, ahead)
            levels.append(level)
        self.table = np.stack(levels).ravel() if len(terms) else np.zeros(0, np.int32)
        self.log = np.concatenate(([0, 0], np.floor(np.log2(np.arange(2, longest + 2) + 0.5)).astype(np.int64)))

    def greatest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and impact of the first greatest posting of each range ``[a, b)``; impact 0 where it is empty."""
        some = b > a
        a, b = np.where(some, a, 0), np.where(some, b, 1)
        k = self.log[b - a]
        one, two = self.table[k * len(self.docs) + a], self.table[k * len(self.docs) + b - (1 << k)]
        at = np.where(self.impact[one] >= self.impact[two], one, two)
        return at, np.where(some, self.impact[at], 0)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and scores of the ``k`` best documents with a score above 0; equal scores by ascending rank."""
        place = np.searchsorted(self.terms, terms)
        known = np.flatnonzero((place < len(self.terms)) & (weights > 0))
        known = known[self.terms[place[known]] == terms[known]]
        place, weights = place[known], weights[known]
        best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(place):
            return best
        step = max(1, FRONTIER // len(place))
        for low in range(0, self.size, step):
            best = self._descend(place, weights, k, low, min(self.size, low + step), best)
        return best

    def _descend(self, place, weights, k, low, high, best):
        base = place * self.size
        edges = np.searchsorted(self.keys, np.stack((base + low, base + high)))
        a, b = edges[:1], edges[1:]
        left, right = np.array([low]), np.array([high])
        bounds, cuts = self._bound(a, b, weights)
        batch = 8
        while True:
            ranks, scores = best
            if len(ranks) == k:
                alive = (bounds > scores[-1]) | ((bounds == scores[-1]) & (left < ranks[-1]))
            else:
                alive = bounds > 0
            if not alive.all():
                a, b, left, right, bounds, cuts = (x[alive] for x in (a, b, left, right, bounds, cuts))
            if not len(bounds):
                return best
            take = min(len(bounds), batch, max(1, CELLS // len(place)))
            batch = min(2 * batch, BATCH)
            chosen = np.argpartition(-bounds, take - 1)[:take]
            doc, from_, to = cuts[chosen], a[chosen], b[chosen]
            at = np.clip(np.searchsorted(self.keys, base[None, :] + doc[:, None]), from_, to)
            safe = np.minimum(at, len(self.docs) - 1)
            hit = (at < to) & (self.docs[safe] == doc[:, None])
            score = (np.where(hit, self.impact[safe], 0) * weights).sum(axis=1)
            ranks, scores = np.concatenate((ranks, doc)), np.concatenate((scores, score))
            ranks, scores = ranks[scores > 0], scores[scores > 0]
            top = np.lexsort((ranks, -scores))[:k]
            best = ranks[top], scores[top]
            new_a, new_b = np.concatenate((from_, at + hit)), np.concatenate((at, to))
            new_left, new_right = np.concatenate((left[chosen], doc + 1)), np.concatenate((doc, right[chosen]))
            new_bounds, new_cuts = self._bound(new_a, new_b, weights)
            rest = np.ones(len(bounds), bool)
            rest[chosen] = False
            a, b, left, right, bounds, cuts = (
                np.concatenate((x[rest], y))
                for x, y in ((a, new_a), (b, new_b), (left, new_left), (right, new_right), (bounds, new_bounds), (cuts, new_cuts))
            )

    def _bound(self, a, b, weights):
        """Sum of the weighted range maxima of every interval, and the document of the greatest of them."""
        at, impact = self.greatest(a, b)
        parts = impact * weights
        return parts.sum(axis=1), self.docs[at[np.arange(len(at)), parts.argmax(axis=1)]].astype(np.int64)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int] | None) -> DataFrame:
    """``doc_id, _n, _keys, _counts`` per row of ``doc_id, _raw``: all terms counted, those of the vocabulary (or all) listed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None
    kind = "bigint" if shared else "binary"

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared else None
        for batch in batches:
            lengths, keys, counts = [], [], []
            for raw in batch.column(1).to_pylist():
                words = terms_of(raw)
                lengths.append(len(words))
                tally: dict = {}
                for word in words if known is None else [i for i in map(known.get, words) if i is not None]:
                    tally[word] = tally.get(word, 0) + 1
                keys.append(list(tally))
                counts.append(list(tally.values()))
            key_type = pa.list_(pa.int64() if shared else pa.binary())
            arrays = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(keys, key_type), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "_n", "_keys", "_counts"])

    return docs.select("doc_id", "_raw").mapInArrow(counting, f"doc_id {dict(docs.dtypes)['doc_id']}, _n bigint, _keys array<{kind}>, _counts array<bigint>")


def _searching(k: int, total: int, n_docs: int):
    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        out: dict[str, list] = {"_i": [], "doc_id": [], "score": []}
        if docs.num_rows and items.num_rows:
            docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
            sizes = pc.list_value_length(docs["_keys"]).to_numpy()
            flat = [pc.list_flatten(docs[c]).to_numpy() for c in ("_keys", "_counts")]
            shard = Shard(docs["_n"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), *flat, total, n_docs)
            for item, terms, weights in zip(*(items[c].to_pylist() for c in ("_i", "_keys", "_weights"))):
                ranks, scores = shard.search(np.array(terms, np.int64), np.array(weights, np.int64), k)
                out["_i"] += [item] * len(ranks)
                out["doc_id"] += docs["doc_id"].take(pa.array(ranks)).to_pylist()
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, docs.schema.field("doc_id").type if c == "doc_id" else pa.int64()) for c, v in out.items()})

    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    vocabulary_terms: int = VOCABULARY_TERMS, shard_docs: int = SHARD_DOCS, item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, scores as integers; equal scores by ascending id, null ids last.

    Null and empty texts have no terms: such documents are not counted and such items get no rows, nor do documents of score 0.
    Repeated document rows are documents of their own; item rows equal in id and text are one item, items that share only their id are
    ranked each by itself. Every document is searched for every item, in (item block, shard) groups of bounded size.
    """
    spark = prepare(docs.sparkSession)
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("_raw")).distinct()
    worded = count_terms(asked.withColumnRenamed("item_id", "doc_id"), None).select(F.col("doc_id").alias("item_id"), "_keys", "_counts")
    worded = stored(worded.filter(F.size("_keys") > 0).withColumn("_i", F.monotonically_increasing_id()))
    vocabulary = stored(worded.select(F.explode("_keys").alias("_term")).distinct().withColumn("_t", F.monotonically_increasing_id()))
    terms, size = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_term")), F.lit(0))).first()
    asking = worded.count()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("_raw"))
    if terms <= vocabulary_terms and size <= VOCABULARY_BYTES:
        counted = count_terms(texts, {bytes(r["_term"]): r["_t"] for r in vocabulary.collect()})
        counted = stored(counted.withColumn("_d", F.monotonically_increasing_id()))
    else:
        every = stored(count_terms(texts, None).withColumn("_d", F.monotonically_increasing_id()))
        pairs = every.select("_d", F.explode(F.arrays_zip("_keys", "_counts")).alias("_p")).select("_d", F.col("_p._keys").alias("_term"), F.col("_p._counts").alias("_c"))
        pairs = pairs.join(vocabulary, "_term").groupBy("_d").agg(F.collect_list(F.struct("_t", "_c")).alias("_p"))
        counted = stored(
            every.select("_d", "doc_id", "_n").join(pairs, "_d", "left")
            .select("_d", "doc_id", "_n", F.coalesce("_p", F.expr("cast(array() as array<struct<_t: bigint, _c: bigint>>)")).alias("_p"))
            .select("_d", "doc_id", "_n", F.col("_p._t").alias("_keys"), F.col("_p._c").alias("_counts"))
        )
    n_docs, total, postings = counted.agg(F.count(F.when(F.col("_n") > 0, 1)), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.size("_keys")), F.lit(0))).first()
    found_in = counted.select(F.explode("_keys").alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("_df") + 1)))
    weighted = (
        worded.select("_i", F.explode(F.arrays_zip("_keys", "_counts")).alias("_p"))
        .select("_i", F.col("_p._keys").alias("_term"), F.col("_p._counts").alias("_c"))
        .join(vocabulary, "_term")
        .join(found_in, "_t")
        .groupBy("_i")
        .agg(F.collect_list(F.struct("_t", (F.col("_c") * weight).alias("_w"))).alias("_p"))
    )
    blocks = ceil(max(1, asking) / item_block)
    shards = max(ceil(n_docs / shard_docs), ceil(postings / SHARD_POSTINGS), min(spark.sparkContext.defaultParallelism, ceil(n_docs / SMALL_SHARD)), 1)

    def dealt(number: str, parts: int):
        return F.pmod(F.xxhash64(number), F.lit(parts)).cast("int")

    def everywhere(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = counted.filter(F.size("_keys") > 0).select("doc_id", "_n", "_keys", "_counts", dealt("_d", shards).alias("_shard"))
    left = left.withColumn("_block", everywhere(blocks)).groupBy("_block", "_shard")
    right = weighted.select("_i", F.col("_p._t").alias("_keys"), F.col("_p._w").alias("_weights"), dealt("_i", blocks).alias("_block"))
    right = right.withColumn("_shard", everywhere(shards)).groupBy("_block", "_shard")
    met = left.cogroup(right).applyInArrow(_searching(k, total, n_docs), f"_i bigint, doc_id {dict(texts.dtypes)['doc_id']}, score bigint")
    order = Window.partitionBy("_i").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(worded.select("_i", "item_id"), "_i").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(documents(spark, sf_dir), prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH w AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents WHERE text IS NOT NULL
), d AS (SELECT r, doc_id, len(t) AS n, t FROM w WHERE len(t) > 0
), c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d
), q AS (
    SELECT DISTINCT item_id, text FROM benchmark
), i AS (
    SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM q
), a AS (SELECT item_id, text, t, count(*) AS times FROM i GROUP BY ALL
), p AS (
    SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM a) GROUP BY ALL
), f AS (
    SELECT t, CAST(floor(1000 * ln((2 * c.big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, c.big_n
), s AS (
    SELECT a.item_id, a.text, p.r, p.doc_id,
           CAST(sum(a.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * c.big_n) // c.big_l)))) AS BIGINT) AS score
    FROM a JOIN f USING (t) JOIN p USING (t), c GROUP BY ALL
), k AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
