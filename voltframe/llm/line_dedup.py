"""Cross-site boilerplate lines: distinct-site spread by mergeable sketches, exact near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.llm.common import documents, spread_join, stored

MIN_SITES = 5
LOG_REGISTERS = 12
# Three standard errors of a sketch with 2^12 registers (1.04 / 64 each), and one site for small counts.
BAND = 3 * 1.04 / 64


def document_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """Rows ``_k1, _k2`` (document), ``_h1, _h2`` (line), ``_id, _pos, _site`` for every line that is not blank."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        docs.select(
            F.col(id_col).alias("_id"),
            F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("_site"),
            F.xxhash64(F.col(id_col), text).alias("_k1"),
            F.xxhash64(F.lit(7), text).alias("_k2"),
            F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"),
        )
        .filter(F.col("_line").rlike(r"\S"))
        .select("_k1", "_k2", "_id", "_pos", "_site", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(7), "_line").alias("_h2"))
    )


def line_spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least ``min_sites`` distinct sites: ``_h1, _h2, _n, _first`` (stored).

    Sketches of sites merge by aggregation, partial in each task. A line whose estimate is within the error
    band of the threshold gets an exact count, from (line, site) pairs that are made distinct before they meet.
    """
    sketched = lines.groupBy("_h1", "_h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("_site", LOG_REGISTERS)).alias("_sites"),
        F.min(F.struct("_id", "_pos")).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    )
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    wide = stored(sketched.filter(F.col("_sites") >= low))
    near = wide.filter(F.col("_sites") <= high)
    exact = (
        lines.groupBy("_h1", "_h2", "_site")
        .agg(F.count(F.lit(1)).alias("_times"))
        .join(near.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_exact"))
        .filter(F.col("_exact") >= min_sites)
    )
    sure = wide.filter(F.col("_sites") > high)
    columns = ["_h1", "_h2", "_n", "_first"]
    return stored(sure.select(*columns).unionByName(near.join(exact, ["_h1", "_h2"]).select(*columns)))


def drop_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """All columns of ``docs`` plus ``clean_text, n_lines, n_removed``.

    A line that is not blank and stands on at least ``min_sites`` distinct sites is removed everywhere but at its first place (smallest
    id, then position), so no content vanishes from the corpus. Only a document of which all lines but blank ones are such lines is a
    copy rather than a page with boilerplate; it stays whole, for document deduplication to judge. Lines are compared as they are, by
    128 bits of hash. All null and empty sites are one site; null text gives null clean text and no line, an empty text is one empty
    line. Rows that repeat id and text are one document. Empty tables give an empty result.
    """
    lines = document_lines(docs, id_col, text_col, site_col)
    flagged = line_spread(lines, min_sites)
    total = flagged.agg(F.sum("_n")).first()[0] or 0
    hits = spread_join(lines.drop("_site"), flagged, ["_h1", "_h2"], "_n", total, F.col("_k1"))
    removed = (
        hits.filter(F.col("_n").isNotNull())
        .select("_k1", "_k2", "_pos", F.struct("_id", "_pos").eqNullSafe(F.col("_first")).alias("_stays"))
        .distinct()
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.when(~F.col("_stays"), F.col("_pos"))).alias("_removed"), F.count(F.lit(1)).alias("_shared"))
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col("_row")[text_col]
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col(id_col), text).alias("_k1"), F.xxhash64(F.lit(7), text).alias("_k2"))
    parts = F.split(own, "\n", -1)
    rest = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("_removed"), i)), "\n")
    kept_whole = F.col("_shared") == F.size(F.filter(parts, lambda x: x.rlike(r"\S")))
    # Null where no line goes; a null condition counts as false.
    cut = (F.size("_removed") > 0) & ~kept_whole
    found = F.struct(
        F.when(cut, rest).otherwise(own).alias("clean_text"),
        F.when(own.isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.when(cut, F.size("_removed")).otherwise(0).alias("n_removed"),
    )
    # The columns of a row and what was found about it stay apart until the end, whatever names the row has.
    both = rows.join(removed, ["_k1", "_k2"], "left").select("_row", found.alias("_found"))
    names = ("clean_text", "n_lines", "n_removed")
    return both.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in names], *[F.col("_found")[c].alias(c) for c in names])


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its boilerplate lines counted and its remaining text by digest."""
    clean = drop_boilerplate(documents(spark, sf_dir))
    return clean.select("doc_id", "n_lines", "n_removed", F.length("clean_text").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), counted AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')
), spread AS (
  SELECT line, min({{'d': doc_id, 'p': pos}}) AS first FROM counted GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), marked AS (
  SELECT l.*, s.line IS NOT NULL AS common, s.line IS NOT NULL AND {{'d': doc_id, 'p': pos}} <> s.first AS gone
  FROM lines l LEFT JOIN spread s USING (line)
), rest AS (
  SELECT doc_id, count(*) FILTER (common) AS shared, (count(*) FILTER (gone))::INT AS gone,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t
  FROM marked GROUP BY doc_id
), own AS (SELECT doc_id, count(*) AS n FROM counted GROUP BY doc_id
), cut AS (
  SELECT d.doc_id, d.text, r.t, r.gone, coalesce(r.gone > 0 AND r.shared < o.n, false) AS cuts
  FROM documents d LEFT JOIN rest r USING (doc_id) LEFT JOIN own o USING (doc_id)
)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::INT AS n_lines, (CASE WHEN cuts THEN gone ELSE 0 END)::INT AS n_removed,
       length(CASE WHEN cuts THEN t ELSE text END)::INT AS clean_chars, sha256(CASE WHEN cuts THEN t ELSE text END) AS clean_sha256
FROM cut
"""
