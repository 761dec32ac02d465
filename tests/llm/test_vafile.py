"""Exact search over approximations: cells and bounds, whole results against brute force, hot vectors, odd rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltframe.llm.vafile import Cells, pack, top_inner_products, unpack

SCHEMA = "vec_id long, embedding array<double>, label int"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(1, 9), st.integers(0, 20), st.randoms(use_true_random=False))
def test_packing_is_a_round_trip(bits, dim, rows, rng):
    cells = np.array([[rng.randrange(1 << bits) for _ in range(dim)] for _ in range(rows)], np.uint8).reshape(rows, dim)
    assert (unpack(pack(cells, bits), dim, bits) == cells).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.sampled_from([3, 200, 1 << 14, 1 << 28]), st.integers(0, 2**32 - 1))
def test_bounds_hold_for_rows_the_sample_has_not_seen(bits, reach, seed):
    rng = np.random.default_rng(seed)
    vectors, queries = rng.integers(-reach, reach + 1, (50, 5)), rng.integers(-reach, reach + 1, (7, 5))
    cells = Cells.fit(vectors[:10], vectors.min(0), vectors.max(0), bits)
    numbers = cells.of(vectors)
    low, high = np.take_along_axis(cells.low.T, numbers, 0), np.take_along_axis(cells.high.T, numbers, 0)
    assert (low <= vectors).all() and (vectors <= high).all()
    upper, lower = cells.queries(queries)
    sides, exact = cells.sides(numbers).T, queries @ vectors.T
    assert ((lower @ sides).astype(np.int64) <= exact).all() and (exact <= (upper @ sides).astype(np.int64)).all()


def brute(rows, k, every, scale=256):
    """Rows of (id, vector): every distinct row that asks against all other distinct rows."""
    clean = {(i, tuple(math.floor(x * scale) for x in v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for i, v in clean:
        if i is None or i % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for j, w in clean if (j, w) != (i, v) and len(w) == len(v)]
        for rank, (score, none, j) in enumerate(sorted(others)[:k], 1):
            out[(i, rank, None if none else j, -score)] += 1
    return out


def found(spark, rows, k=5, every=50, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return Counter(tuple(r) for r in top_inner_products(df, F.col("vec_id") % every == 0, k=k, **more).collect())


@pytest.mark.parametrize(("bits", "first_read"), [(6, 32), (1, 6), (3, 1)])
def test_results_equal_brute_force_whatever_the_cells(text_spark, monkeypatch, bits, first_read):
    monkeypatch.setattr("voltframe.llm.vafile.SMALL_BLOCK", 100)
    rng = np.random.default_rng(bits)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(size=8) * 0.3).tolist()) for i in range(700)]
    assert found(text_spark, rows, bits=bits, first_read=first_read) == brute(rows, 5, 50)


def test_groups_of_equal_vectors_and_ties(text_spark):
    rng = np.random.default_rng(3)
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(400)] + [(400 + i, rng.choice([0.0, 0.5, -0.5], 3).tolist()) for i in range(200)]
    assert found(text_spark, rows, every=10) == brute(rows, 5, 10)
    assert found(text_spark, rows[:3], every=1, k=5) == brute(rows[:3], 5, 1)


def test_odd_rows(text_spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (None, [9.0, 9.0]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]),
        (5, [1.0, -inf]), (6, [-0.001, 0.001]), (7, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (100, [5.0]), (8, [1.0, 2.0]), (150, [0.0, 0.0]),
    ]
    assert found(text_spark, rows) == brute(rows, 5, 50)
    assert found(text_spark, rows, k=1) == brute(rows, 1, 50)
    assert not found(text_spark, [])
    assert not found(text_spark, [(0, [1.0])])
    clash = text_spark.createDataFrame([(0, [1.0], 1, 2, 3.0, 4), (1, [2.0], 1, 2, 3.0, 4)], "vec_id long, embedding array<float>, _v int, _q int, score double, rank int")
    assert [tuple(r) for r in top_inner_products(clash, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]


def test_large_components_and_scores_that_do_not_fit(text_spark):
    rows = [(i, [float((-1) ** i * (i + 1) * 2**14), 3.0 * i]) for i in range(60)]
    assert found(text_spark, rows, every=10) == brute(rows, 5, 10)
    with pytest.raises(ValueError, match="64 bits"):
        found(text_spark, [(0, [1e30]), (1, [1.0])])
