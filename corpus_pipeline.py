"""A corpus pipeline: language, boilerplate lines, near-duplicates, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.llm import langid, line_dedup, packing, pii, simhash
from voltframe.llm.common import documents, prepare, shared_folder, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Below this mean marginal the words are about evenly spread over the languages.
MIN_SCORE = 0.3


def with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text, its length brought up to date."""
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, stored so that the numbers stay: a stage decides by row, as ids may be null or repeat."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a leading language go; the others keep their text and get the language found."""
    prepare(spark)
    rows = numbered(docs)
    found = langid.identify(rows, langid.fit(docs), id_col="_row")
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    kept = kept.select(F.col("id").alias("_row"), F.col("lang_pred").alias("_lang"))
    return rows.join(kept, "_row").withColumn("lang", F.col("_lang")).select(*COLUMNS)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go, everywhere but at their first place and in documents of nothing else. No document goes."""
    prepare(spark)
    return with_text(line_dedup.drop_boilerplate(docs), "clean_text")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays (null ids last)."""
    prepare(spark)
    rows = numbered(docs)
    groups = simhash.near_duplicates(rows, id_col="_row").withColumnRenamed("id", "_row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(*COLUMNS)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values give way to linked pseudonyms."""
    prepare(spark)
    return with_text(pii.pseudonymise(docs), "masked_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens."""
    prepare(spark)
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("line_dedup", own_lines),
    ("near_dedup", one_of_each),
    ("pii", no_personal_data),
    ("packing", packed),
]

# SQL expresses neither the language model nor the keyed permutation nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is Parquet in the shared folder."""
    docs = documents(spark, sf_dir)
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
