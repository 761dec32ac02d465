"""Fill-in-middle: the learned index against plain offsets, whole outputs against brute force, odd rows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from conftest import ODD_ROWS
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltframe.llm.fim import FimPlan, RankIndex, fill_in_middle, line_offsets, restored

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def plain_offsets(text):
    out = [0]
    for unit in LINE.findall(text):
        out.append(out[-1] + len(unit))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\né\U0001f600\r", max_size=200))
def test_boundaries_are_those_of_the_pattern(text):
    assert line_offsets(text) == plain_offsets(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=300), st.sampled_from([0.0, 1.0, 16.0, 126.0]))
def test_index_is_exact_within_its_error_bound(steps, error):
    offsets = [0, *np.cumsum(steps, dtype=np.int64).tolist()]
    index = RankIndex.fit(offsets, error)
    assert [index.offset(i) for i in range(len(offsets))] == offsets
    assert np.abs(index.residuals).max() <= error + 1
    assert [index.rank(o) for o in offsets] == list(range(len(offsets)))
    assert all(index.rank(o + s - 1) == i for i, (o, s) in enumerate(zip(offsets, steps)))


def test_even_lines_need_one_segment_and_one_byte_a_line():
    index = RankIndex.fit([80 * i + (i % 7) for i in range(100_000)])
    assert len(index.firsts) == 1 and index.residuals.dtype == np.int8
    ragged = RankIndex.fit(np.cumsum(np.where(np.arange(2000) % 2, 1, 90_000)).tolist())
    assert len(ragged.firsts) <= 1000 and ragged.residuals.dtype == np.int8


def brute(key, text, plan):
    units = LINE.findall(text)
    digest = hashlib.sha256(f"{plan.seed}:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)) or h[2] % 100 >= plan.rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    head, body, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < plan.spm_rate:
        return len(units), "spm", len(head), len(body), plan.suffix + tail + plan.prefix + head + plan.middle + body
    return len(units), "psm", len(head), len(body), plan.prefix + head + plan.suffix + tail + plan.middle + body


TRICKY = ["<P", "S>", "a<P>b", "<S>", "x\n<M>\ny", "<P\n<\n>M>", "\n\n\n", "one line", "end\n", "é\n\U0001f600 中\n\r\nz", "<<\n<P\nS\n>" * 9]


@pytest.mark.parametrize("plan", [FimPlan(), FimPlan(seed="x", rate=60, spm_rate=20, prefix="[[p", suffix="[[s", middle="[[m", error=0.0)])
def test_rows_equal_brute_force_and_come_back(text_spark, texts, plan):
    rows = [*texts.items(), *((10_000 + i, t) for i, t in enumerate(TRICKY)), (None, "no id\nbut text\n"), (10_500, None), (10_501, ""), (10_502, "w\n" * 200_000)]
    df = text_spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_in_middle(df, plan).withColumn("back", restored("output", "form", plan)).collect()
    want = {k: brute("" if k is None else k, t or "", plan) for k, t in rows}
    assert {r["id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got} == want
    assert {r["id"]: r["back"] for r in got} == {k: t or "" for k, t in rows}
    assert {"plain", "spm", "psm"} == {r["form"] for r in got}


def test_sentinels_that_could_not_be_taken_back_are_refused():
    for marks in ("a b a", "ab b c", "xa ay q"):
        p, s, m = marks.split()
        with pytest.raises(ValueError):
            FimPlan(prefix=p, suffix=s, middle=m)
    with pytest.raises(ValueError):
        FimPlan(prefix="")


def test_odd_rows_and_empty_tables(odd, none):
    rows = fill_in_middle(odd.withColumns({"output": F.lit(1), "form": F.lit("x"), "segments": F.lit(0)})).collect()
    assert len(rows) == len(ODD_ROWS) and sorted(r["form"] for r in rows if r["id"] in (3, 4)) == ["plain", "plain"]
    assert fill_in_middle(none).count() == 0
