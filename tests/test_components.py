import random

import pytest

from foliograph.operators.components import components


def naive(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(i, i + 1) for i in range(12)] if seed == 0 else [(r.randrange(40), r.randrange(40)) for _ in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {g["id"]: g["class"] for g in got} == naive(edges) and len(got) == len(naive(edges))


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
