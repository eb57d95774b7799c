"""Problem 5: the keys meet every pair within the guaranteed distance, hot keys included, and no text is lost to blocks."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import neardup


def signed(rows):
    """Representatives with equal sketches, so that only the keys decide."""
    return [(i, sig, [0] * len(neardup._PACKED)) for i, sig in rows]


@pytest.mark.parametrize("same", [True, False])
def test_keys_meet_every_pair_within_far(spark, monkeypatch, same):
    """Also where a key is hot for all rows: then by the refined keys."""
    monkeypatch.setattr(neardup, "HOT", 8 if same else 256)
    monkeypatch.setattr(neardup, "LOOK", 1)
    r = random.Random(12)
    rows = []
    shared = {k: 5 for k in (0, 10, 20)}  # three symbols of the first chunk that all rows have
    for i in range(60):
        a = [shared[k] if same and k in shared else r.randrange(1 << 30) for k in range(neardup.SYMBOLS)]
        b = a[:]
        for k in r.sample([k for k in range(neardup.SYMBOLS) if not same or k not in shared], neardup.FAR):
            b[k] += 1
        rows += [(2 * i, a), (2 * i + 1, b)]
    reps = spark.createDataFrame(signed(rows), "_rep long, _sig array<int>, _packed array<long>")
    met = {(x.a, x.b) for x in neardup.candidates(reps).collect()}
    assert met >= {(2 * i, 2 * i + 1) for i in range(60)}
    assert len(met) == 60


def test_pigeonhole():
    """Of the keys: any choice of equal symbols that leaves ``FAR`` errors holds a key; of the refined ones likewise."""
    assert neardup.FAR == 29 and len(neardup.kept()) == 100
    r = random.Random(1)
    others, twos = neardup.refined()
    keys = [set(k) for k in neardup.kept()]
    for _ in range(300):
        equal = set(r.sample(range(neardup.SYMBOLS), neardup.SYMBOLS - neardup.FAR))
        hit = [n for n, k in enumerate(keys) if k <= equal]
        assert hit
        for n in hit:
            assert not keys[n] & set(others[n])
            assert any({others[n][i], others[n][j]} <= equal for i, j in twos)


def test_sketches_count_equal_hashes():
    sig = np.random.default_rng(3).integers(0, 1 << 32, (4, neardup.SKETCH)).astype(np.uint32)
    out = neardup.sketches(sig).view(np.uint64)
    for k in range(neardup.SKETCH):
        assert ((out[:, k // 32] >> np.uint64(2 * (k % 32))) & np.uint64(3) == (sig[:, k] & 3)).all()


def test_a_third_of_all_rows_are_copies(spark, monkeypatch):
    """Blocks of copies and of links: no pair is lost, none comes twice."""
    for name, v in (("BLOCK", 7), ("HOT", 8), ("LOOK", 1)):
        monkeypatch.setattr(neardup, name, v)
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = r.sample(words, 40)
    texts = [" ".join(base)] * 40
    texts += [" ".join(base[:k] + ["x%d" % k] + base[k + 1 :]) for k in range(2, 38)]
    texts += [" ".join(r.sample(words, 40)) for _ in range(44)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    near = neardup.NearDuplicates(df, "id", F.col("content"), size=3, least=0.6)
    got = [(x.id_a, x.id_b) for x in near.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert near.members.filter("rep = 0").count() == 40
