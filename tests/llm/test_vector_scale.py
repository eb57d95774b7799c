"""Problem 3: what is shuffled for a vector stays bounded as the collection grows, and the exact option is exact."""

import numpy as np
import pytest

from foliograph.llm import vectors

QUERY_BYTES, DATA_BYTES, INPUT_BYTES = 128 + 80, 256 + 80, 1_150


@pytest.mark.parametrize("n", [1_000_000, 3_000_000, 30_000_000])
def test_copies_stay_bounded(n):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(1500, 64))
    make = lambda m: vectors.unit(centres[rng.integers(0, len(centres), m)] + 0.8 * rng.normal(size=(m, 64)))
    cells = make(vectors.cells_for(n))
    q = vectors.Quantiser(cells, np.zeros((0, vectors.WORDS, 64), np.float32))
    x = make(4000)
    near = np.concatenate([q.probes(x[i : i + 500], vectors.PROBES) for i in range(0, len(x), 500)])
    rows = np.bincount(near[:, : vectors.CELLS].ravel(), minlength=len(cells)) + 0.5
    rows = (rows * vectors.CELLS * n / rows.sum()).astype(int)
    group, blocks = vectors.grouping(q, dict(enumerate(rows)))
    goes = [np.unique(group[p]) for p in near]
    query_copies = np.mean([blocks[g].sum() for g in goes])
    asked = np.bincount(np.concatenate(goes), minlength=len(blocks)) * n / len(x)
    parts = np.asarray([vectors.parts_for(int(a), len(blocks), 4000) for a in asked])
    data_copies = (np.bincount(group, rows, len(blocks)) * parts).sum() / n
    assert query_copies * QUERY_BYTES + data_copies * DATA_BYTES < 4 * INPUT_BYTES, (query_copies, data_copies)


def test_rows_scored_grow_slower_than_the_root_up_to_the_most_cells():
    scored = [vectors.CELLS * vectors.PROBES * n / vectors.cells_for(n) for n in (10_000, 100_000, 1_000_000)]
    assert scored[2] / scored[0] < 100**0.5


def test_exact_option(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    got = vectors.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<float>"), "id", "e", dims=16, exact=True).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert {(g.id, g.neighbour) for g in got} == {(i, int(j)) for i in range(600) for j in np.argsort(-s[i], kind="stable")[:5]}


def test_hot_groups_of_the_ranking_give_the_same(spark, monkeypatch):
    from foliograph.llm import ranking

    rng = np.random.default_rng(6)
    rows = [(int(g) if g < 9 else None, int(i), *(float(v) if v > -1.5 else None for v in rng.normal(size=4))) for i, g in enumerate(rng.integers(0, 10, 400) // 3 * 3)]
    df = spark.createDataFrame(rows, "a long, c long, rrf_score double, dense double, sparse double, rerank double")
    read = lambda **kw: sorted((r.a is None, r.a, r.c, round(r.closeness, 9), r.place) for r in ranking.ranked(df, "a", "c", **kw).collect() if r.a is not None)
    plain = [read(), read(top=3)]
    monkeypatch.setattr(ranking, "HOT", 50)
    assert [read(), read(top=3)] == plain
