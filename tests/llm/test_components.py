"""Star sweeps: results, and no sweep that changes nothing."""

import random

import pytest

from siltworks.llm import components

SHAPES = {  # edges and the most checkpoints they may take
    "none": ([], 1),
    "stars": ([(5, 1), (7, 1), (2, 9), (5, 1), (4, 4)], 1),
    "one chain of three": ([(1, 2), (2, 3)], 2),
    "a long chain": ([(k, k + 1) for k in range(40)], 9),
    "random": ([(random.Random(k).randrange(300), random.Random(k + 999).randrange(300)) for k in range(250)], 9),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_stars(spark, monkeypatch, shape):
    edges, most = SHAPES[shape]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {x: low if r == high else r for x, r in root.items()}
    made, real = [], components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: made.append(1) or real(df))
    got = sorted(map(tuple, components.stars(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == sorted((x, r) for x, r in root.items() if x != r) and len(made) <= most
