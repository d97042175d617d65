"""The dual-tree search against all pairs, with blocks so small that every step has several."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siltworks.llm import negatives


def brute(rows, every=10):
    usable = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = min(usable.get(i, (label, v)), (label, v))
    ints = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in usable.items()}
    score = lambda a, b: sum(x * y for x, y in zip(ints[a][1], ints[b][1], strict=False))
    out = []
    for a in (i for i in ints if i % every == 0):
        order = sorted((i for i in ints if i != a), key=lambda i: (-score(a, i), i))
        for p in [i for i in order if ints[i][0] == ints[a][0]][:5]:
            ps = score(a, p)
            hard = [i for i in order if ints[i][0] != ints[a][0] and 30 * ps <= 100 * score(a, i) <= 90 * ps][:10]
            out += [(a, p, k + 1, i, ps, score(a, i)) for k, i in enumerate(hard)]
    return sorted(out)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, block string").repartition(4)
    return sorted(map(tuple, negatives.hard_negatives(table, F.col("id") % 10 == 0).collect()))


@pytest.fixture
def small(monkeypatch):
    for name, n in (("BLOCK_ROWS", 12), ("GROUP_ROWS", 3), ("CHUNK", 3), ("RUN", 2), ("SAMPLE", 60)):
        monkeypatch.setattr(negatives, name, n)


def vectors(rnd, n, dim=6):
    middles = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    return [[m + rnd.gauss(0, 0.6) for m in middles[i % 3]] for i in range(n)]


def test_against_all_pairs(spark, small):
    rnd = random.Random(1)
    rows = [(i, v, (i * 7) % 3) for i, v in enumerate(vectors(rnd, 220))]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_ties_hot_vectors_and_odd_rows(spark, small):
    rnd = random.Random(2)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(rnd, 60))]
    rows += [(100 + i, rows[7][1], i % 2) for i in range(60)]  # half of all rows alike
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [math.nan] * 6, 1), (203, [math.inf] * 6, 0), (204, [0.5] * 6, None), (None, [0.5] * 6, 1), (210, [0.0] * 6, 1), (211, [0.7], 0), (212, [0.7, -0.2, 0.1], 1), (213, [], 1)]
    rows += [(220, [0.4] * 6, 5), (230, [0.4] * 6, 1), (230, [0.4] * 6, 1), (230, [0.1] * 6, 0)]  # a label of its own; a vec_id three times
    assert found(spark, rows) == brute(rows)


def test_scores_beyond_exact_doubles(spark):
    rows = [(i, [1e5 * (i % 13 + 1), 1e-3 * i, 3e4], i % 2) for i in range(30)]  # scores over 2^53
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(10, [1.0], 1)]) == []
    assert found(spark, [(10, [1.0], 1), (11, [1.0], 1)]) == []
    assert found(spark, [(10, [1.0], 1), (11, [1.0], 1), (12, [0.5], 2), (13, [0.95], 2)]) == [(10, 11, 1, 12, 65536, 32768)]


def test_intervals_hold_all_products():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = np.floor(rng.normal(0, 60, (50, 8))), np.floor(rng.normal(20, 60, (70, 8)))
    ta, tb = negatives.Balls(a, 8), negatives.Balls(b, 8)
    low, high = negatives.interval((ta.centre, ta.norm, ta.radius), (tb.centre, tb.norm, tb.radius))
    exact = negatives.scores(a, b)
    for i, (s, e) in enumerate(ta.edges):
        for j, (p, q) in enumerate(tb.edges):
            if e > s and q > p:
                assert low[i, j] <= exact[s:e, p:q].min() and exact[s:e, p:q].max() <= high[i, j]
