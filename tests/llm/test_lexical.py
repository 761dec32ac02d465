"""Ranked search: range maxima, whole results against brute force over every document, ties, odd rows, the shuffled vocabulary."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

from voltframe.llm import lexical
from voltframe.llm.lexical import Shard, search, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_scores(docs, items):
    """Item position -> {document position: score}, over all documents."""
    counted = [Counter(plain_terms(t)) for _, t in docs]
    lengths = [sum(c.values()) for c in counted]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(w for c in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for w, f in df.items()}
    out = []
    for _, text in items:
        scores = defaultdict(int)
        for w in plain_terms(text):
            for d, c in enumerate(counted):
                if c[w]:
                    m = 100 - 75 + (75 * lengths[d] * n) // total
                    scores[d] += weight[w] * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m))
        out.append(scores)
    return out


def brute(docs, items, k):
    rows = Counter()
    items = list(dict.fromkeys(items))
    for (item, _), scores in zip(items, plain_scores(docs, items)):
        ranked = sorted((-s, docs[d][0] is None, docs[d][0] or 0, d) for d, s in scores.items() if s > 0)
        rows.update((item, r, docs[d][0], -s) for r, (s, _, _, d) in enumerate(ranked[:k], 1))
    return rows


def found(spark, docs, items, k=10, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return Counter(tuple(r) for r in search(df, spark.createDataFrame(items, "item_id long, text string"), k=k, **more).collect())


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_terms_are_those_of_the_pattern(text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


def random_shard(rng, n_docs, n_terms):
    lengths = rng.integers(1, 60, n_docs)
    pairs = np.unique(rng.integers(0, n_docs * n_terms, n_docs * n_terms // 3))
    counts = rng.integers(1, 6, len(pairs))
    return lengths, pairs // n_terms, pairs % n_terms, counts


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(1, 6), st.integers(0, 2**32 - 1))
def test_range_maxima(n_docs, n_terms, seed):
    rng = np.random.default_rng(seed)
    shard = Shard(*random_shard(rng, n_docs, n_terms), 1000, 50)
    for s, e in zip(shard.starts, shard.ends):
        a, b = np.triu_indices(e - s + 1, 0)
        at, top = shard.greatest(a + s, b + s)
        for i, j, x, v in zip(a + s, b + s, at, top):
            assert v == (shard.impact[i:j].max() if j > i else 0)
            assert i == j or x == i + shard.impact[i:j].argmax()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 8), st.integers(1, 12), st.integers(0, 2**32 - 1), st.sampled_from([1, 7, 10**6]))
def test_search_equals_scoring_every_document(n_docs, n_terms, k, seed, frontier):
    rng = np.random.default_rng(seed)
    lengths, docs, terms, counts = random_shard(rng, n_docs, n_terms)
    shard = Shard(lengths, docs, terms, counts, int(lengths.sum()), n_docs)
    wanted, weights = rng.permutation(n_terms + 2)[: rng.integers(1, n_terms + 3)], rng.integers(0, 5, n_terms + 2) * 300
    scores = np.zeros(n_docs, np.int64)
    for t, w in zip(wanted, weights):
        own = shard.terms == t
        if own.any():
            span = slice(int(shard.starts[own][0]), int(shard.ends[own][0]))
            scores[shard.docs[span]] += w * shard.impact[span]
    order = [d for d in np.lexsort((np.arange(n_docs), -scores)) if scores[d] > 0][:k]
    before, lexical.FRONTIER = lexical.FRONTIER, frontier
    try:
        ranks, got = shard.search(wanted, weights[: len(wanted)], k)
    finally:
        lexical.FRONTIER = before
    assert ranks.tolist() == order and got.tolist() == scores[order].tolist()


WORDS = "the of and to a in is it sea Wind stone Äpfel 中文 x1 42 ebb".split()


@pytest.mark.parametrize("more", [{}, {"shard_docs": 40, "item_block": 2}, {"vocabulary_terms": 0, "shard_docs": 100}])
def test_results_equal_brute_force(text_spark, more):
    rng = np.random.default_rng(5)
    pick = lambda n: " ".join(rng.choice(WORDS, n, p=np.arange(len(WORDS), 0, -1) / (len(WORDS) * (len(WORDS) + 1) / 2)))
    docs = [(i, pick(rng.integers(1, 40))) for i in range(250)]
    docs += [(300 + i, docs[7][1]) for i in range(60)] + [(5, docs[9][1]), (5, docs[9][1])]  # copies tie; ids that repeat
    items = [(i, pick(rng.integers(1, 12))) for i in range(9)] + [(20, "sea SEA sea"), (21, "the of"), (22, "unseen"), (22, "ebb"), (22, "ebb")]
    assert found(text_spark, docs, items, **more) == brute(docs, items, 10)


def test_odd_rows(text_spark):
    docs = [(1, None), (2, ""), (3, " .,!\n"), (None, "red fox"), (4, "red fox"), (4, "red fox"), (5, "Red-Fox_red"), (6, "word " * 50_000 + "fox"), (7, "É é fox")]
    items = [(1, "red fox"), (2, None), (3, ""), (4, "..."), (None, "fox"), (1, "é"), (1, "red fox")]
    assert found(text_spark, docs, items) == brute(docs, items, 10)
    assert found(text_spark, docs, items, k=2, vocabulary_terms=0) == brute(docs, items, 2)
    assert not found(text_spark, [], items) and not found(text_spark, docs, []) and not found(text_spark, docs[:3], items)


def test_extra_columns_with_clashing_names(odd, none):
    items = odd.selectExpr("doc_id AS item_id", "text", "1 AS doc_id", "2 AS _keys", "3 AS rank")
    assert search(odd, items).filter("rank = 1").count() >= 5
    assert search(none, items).count() == 0 and search(odd, items.limit(0)).count() == 0


def test_query_on_whole_tables_equals_brute_force(text_spark, texts):
    items = [tuple(r) for r in text_spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    got = Counter(tuple(r) for r in lexical.op12_ranked_search(text_spark, SF_DIR).collect())
    assert got == brute(list(texts.items()), items, 10)
