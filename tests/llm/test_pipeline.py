"""The registered text queries against their SQL, and the pipeline's stages against the operators."""

from __future__ import annotations

import os

import corpus_pipeline
import duckdb
import pytest
from conftest import ODD_ROWS, SF_DIR

from voltframe.llm import simhash
from voltframe.llm.workload import ORACLE, QUERIES

NATIVE = ("op2_line_spread", "op9_exact_dedup")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(text_spark, texts, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = QUERIES[name](text_spark, SF_DIR)
    got = result.toPandas()
    want = con.execute(ORACLE[name]).fetchdf()[list(got.columns)]
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
    if name in NATIVE:
        assert "Python" not in plan and "Arrow" not in plan
    sort = lambda d: d.sort_values(list(d.columns)).reset_index(drop=True).astype(str)
    assert sort(got).equals(sort(want))


def test_all_operators_are_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_stages_in_turn(text_spark, texts, tmp_path):
    docs = text_spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = set(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()} if k < 4 else None
        stage(text_spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{k}")
        if name == "near_dedup":
            want = {r["id"] for r in simhash.near_duplicates(docs).collect() if r["id"] == r["component_id"]}
        docs = text_spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            after = {r["doc_id"]: r for r in docs.collect()}
            assert docs.columns == list(corpus_pipeline.COLUMNS) and after.keys() == want == (want & before.keys())
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
            if name == "line_dedup":
                assert all(set(r["text"].split("\n")) <= set(before[i]["text"].split("\n")) for i, r in after.items())
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want


def test_run_equals_stages_and_takes_odd_rows(text_spark, odd, tmp_path):
    os.makedirs(f"{tmp_path}/sf", exist_ok=True)
    text_spark.createDataFrame(ODD_ROWS * 3, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/sf/documents.parquet")
    rows = corpus_pipeline.run(text_spark, f"{tmp_path}/sf").collect()
    assert {r["doc_id"] for r in rows} == {1, 6, None, 7}  # no letters: gone; 2 copies 1
    text_spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(text_spark, f"{tmp_path}/empty").count() == 0


def test_pages_with_little_text_beside_shared_lines_lose_these(text_spark):
    head, foot = "A long header that stands on every site there is.", "A long footer that stands on every site there is."
    rows = [(i, f"{head}\nown text {i}\n{foot}", "en", f"s{i}", 0) for i in range(6)] + [(9, f"{head}\n{foot}", "en", "s9", 0)]
    docs = text_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.own_lines(text_spark, docs, SF_DIR).collect()}
    assert got == {0: rows[0][1], 9: rows[6][1], **{i: f"own text {i}" for i in range(1, 6)}}


def test_short_lines_count_by_their_sites_too(text_spark):
    rows = [(i, f"Some text of page {i} that no other page has.\n\nAll rights reserved.", "en", f"s{i}", 0) for i in range(6)]
    docs = text_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.own_lines(text_spark, docs, SF_DIR).collect()}
    assert got == {0: rows[0][1], **{i: f"Some text of page {i} that no other page has.\n" for i in range(1, 6)}}


def test_rows_with_null_or_repeated_ids_are_judged_by_their_text(text_spark):
    text = "Row {} tells of a matter of its own, with words such as {} that stand in no other row of this table at all."
    own = [("alpha", None), ("bravo", None), ("charlie", 7), ("delta", 7), ("echo", 8)]
    rows = [(i, text.format(w, " ".join(f"{w}{k}" for k in range(30))), "en", "s", 0) for w, i in own]
    rows += [(9, "12345 ...", "en", "s", 0), (8, "!!! 999", "en", "s", 0), (5, rows[2][1], "en", "s", 0)]
    docs = text_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.known_language(text_spark, docs, SF_DIR)
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(r[:2]) for r in rows if r[1][0] == "R")
    single = corpus_pipeline.one_of_each(text_spark, kept, SF_DIR).collect()
    assert sorted(str((r.doc_id, r.text)) for r in single) == sorted(str((5 if w == "charlie" else i, rows[k][1])) for k, (w, i) in enumerate(own))
