"""Token counts without a shuffle of pre-tokens: a broadcast table of frequent ones, worker caches for the rest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.llm.common import documents
from voltframe.llm.wordcache import Generations

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
FREQUENT = 65536
FREQUENT_CHARS = 32
PER_TASK = 8192
HELD_WORDS = 1_000_000
CACHE = 150_000


@lru_cache(maxsize=2)
def processor(model_path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, read once per worker. Its pieces must not reach over the seams at which texts are cut."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
        raise ValueError("a piece of this model reaches over a space or a line end")
    if model.encode("a  b\n", out_type=str)[-1] == "b" or model.encode("a") != model.encode("a ")[: len(model.encode("a"))]:
        raise ValueError("this model rewrites white space")
    return model


def pre_tokens(text: str) -> list[str]:
    """Cut a text where no piece can join: before a run of spaces, and before a line end.

    A run of spaces stays with the word after it. A pre-token is what the model must encode to see it as it is in the text:
    the model puts one space mark before every input, so one leading space is left out; a pre-token that begins
    with a line end gets that mark too much. A lone space mark is the pre-token `` ``, with no space left out.
    """
    parts = text.replace("▁", " ").replace("\n", " \n").split(" ")
    if not text:
        return []
    if "" not in parts:
        return parts
    cut, spaces = [], 0
    for part in parts:
        if part == "":
            spaces += 1
        elif part[0] == "\n":
            if spaces:
                cut.append(" " * spaces)
            cut.append(part)
            spaces = 0
        else:
            cut.append(" " * spaces + part)
            spaces = 0
    if spaces:
        cut.append(" " * spaces)
    return cut


def token_lengths(model: sentencepiece.SentencePieceProcessor, words: list[str]) -> list[int]:
    """Tokens of each pre-token in its place in a text."""
    inputs = [w[1:] if w[0] == " " and not w.strip(" ") else w for w in words]
    sizes = [len(ids) for ids in model.encode(inputs, num_threads=1)]
    # Only spaces: one mark comes from the model, also for the empty input that it gives no token.
    return [max(n, 1) if w[0] == " " and not w.strip(" ") else n - (w[0] == "\n") for w, n in zip(words, sizes)]


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens of a task. Rare ones are forgotten when too many are held: that costs hits, never results."""
    held: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(pre_tokens(text or ""))
        if len(held) > HELD_WORDS:
            held = Counter(dict(held.most_common(HELD_WORDS // 4)))
    top = [(w, n) for w, n in held.most_common(PER_TASK) if len(w) <= FREQUENT_CHARS and w.strip(" ") and w[0] != " "]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])


def frequent_table(docs: DataFrame, text_col: str, model_path: str, size: int = FREQUENT) -> tuple[str, bytes]:
    """The ``size`` most frequent pre-tokens of all texts and their token counts, packed.

    Each task sends at most ``PER_TASK`` summed counts, not pre-tokens. The table has at most ``size`` words of at most
    ``FREQUENT_CHARS`` characters, joined by spaces, and one byte of length for each: at most 8.5 MB, mostly below 1 MB.
    """
    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(_local_counts, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()
    words = [r["word"] for r in top]
    sizes = token_lengths(processor(model_path), words) if words else []
    kept = [(w, n) for w, n in zip(words, sizes) if 0 < n < 256]
    return " ".join(w for w, _ in kept), bytes(n for _, n in kept)


_TABLES: dict[int, dict[str, int]] = {}
_CACHES: dict[str, Generations] = {}


def _counting(table, model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if id(table) not in _TABLES:
            _TABLES.clear()
            words, sizes = table.value
            _TABLES[id(table)] = dict(zip(words.split(" "), sizes)) if sizes else {}
        frequent = _TABLES[id(table)]
        cache = _CACHES.setdefault(model_path, Generations(CACHE))
        model = processor(model_path)
        for batch in batches:
            totals = np.zeros(batch.num_rows, dtype=np.int64)
            misses: list[str] = []
            owners: list[int] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = pre_tokens(text or "")
                known = list(map(frequent.get, words))
                rare = [w for w, n in zip(words, known) if n is None]
                if rare:
                    misses += rare
                    owners += [row] * len(rare)
                totals[row] = sum(filter(None, known))
            if misses:
                sizes = cache.fill(misses, lambda ws: token_lengths(model, ws))
                totals += np.bincount(owners, weights=sizes, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals)], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``id, n_bytes, n_tokens`` per input row, as the library counts without begin, end or added tokens.

    Texts are cut where the model cannot merge; each pre-token is looked up in the broadcast table, then in the worker's cache,
    and only then encoded. No pre-token is shuffled. Null counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each.
    """
    model_path = model_path or public_tokenizers.path(MODEL)
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, text_col, model_path))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_counting(table, model_path), schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    counted = token_counts(documents(spark, sf_dir))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
