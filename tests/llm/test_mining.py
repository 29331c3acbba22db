"""Hard negatives against all pairs in plain Python."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import mining, vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, k=5, low=80, high=100):
    whole = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = (label, [int(np.floor(256 * c)) for c in v])
        whole[i] = min(whole.get(i, x), x)
    out = set()
    for a, (label, y) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, x) in whole.items() if i != a and len(x) == len(y))
        for s, i, _ in [z for z in scored if z[2] == label][:k]:
            fit = [z for z in scored if z[2] != label and low * -s <= -100 * z[0] <= high * -s][:k]
            out |= {(a, i, n, j, -s, -t) for n, (t, j, _) in enumerate(fit, 1)}
    return out


def clustered(n, d, seed, clusters=6, spread=0.02):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, d))
    for i in range(n):
        yield i, (centers[i * 7919 % clusters] + spread * rng.normal(size=d)).tolist(), int(rng.integers(3))


@pytest.mark.parametrize("kind", ["clustered", "random", "ties"])
def test_same_as_all_pairs(spark, kind):
    rng = np.random.default_rng(8)
    if kind == "clustered":
        rows = list(clustered(400, 8, 1))
    elif kind == "random":
        rows = [(i, rng.normal(size=5).tolist(), int(rng.integers(4))) for i in range(300)]
    else:
        rows = [(i, [float(c) for c in rng.integers(0, 2, 3)], int(rng.integers(2))) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for block, together, group in ((8, 4, 5), (128, 64, 2048)):
        got = [tuple(r) for r in mining.mine(spark, df, F.col("vec_id") % 10 == 0, block=block, together=together, group=group).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 10)


def test_defined_cases(spark):
    assert mining.mine(spark, spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).count() == 0
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([3, 4]))], rng.choice([0, 1, None])) for i in range(120)]
    rows += [(200, None, 1), (201, [1.0, None, 2.0], 1), (202, [1.0, float("nan"), 0.0], 0), (203, [float("inf"), 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (204, [], 0), (206, [], 1), (208, [], 1)]
    rows += [(210, [1.0, 1.0, 1.0], 1), (210, [1.0, 1.0, 1.0], 1), (210, [0.5, 1.0, 1.0], 0), (-2, [1.0, 0.5, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", d string, anchor int")
    got = [tuple(r) for r in mining.mine(spark, df, F.col("vec_id") % 2 == 0, block=8, together=2, group=7).collect()]
    assert set(got) == brute(rows, 2) and len(got) == len(set(got))
    nobody = mining.mine(spark, df, F.lit(False))
    assert nobody.count() == 0


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(-(2**20), 2**20)), float(rng.randrange(2**20))], rng.randrange(2)) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in mining.mine(spark, df, F.col("vec_id") % 3 == 0, block=8, together=2, group=7).collect()}
    assert got == brute(rows, 3) and max(abs(r[4]) for r in got) > 2**53


def test_zone_maps_leave_blocks_out(spark):
    """Blocks along the curve hold neighbours, so windows near a cluster's scores need few of them."""
    rows = list(clustered(1200, 16, 3, clusters=12, spread=0.005))
    x = np.floor(256 * np.array([r[1] for r in rows]))
    keys = mining.hilbert_keys(x, float(np.abs(x).mean()))
    order = sorted(range(len(rows)), key=lambda i: (keys[i], i))
    kinds = defaultdict(set)
    for n, i in enumerate(order):
        kinds[n // 20].add(rows[i][0] * 7919 % 12)
    assert sum(map(len, kinds.values())) < 2 * len(kinds)
    lo, hi = (np.array([f(x[order[n : n + 20]], axis=0) for n in range(0, 1200, 20)]) for f in (np.min, np.max))
    zones = pa.table({"lo": list(lo), "hi": list(hi), "kinds": [[0, 1, 2]] * 60})
    y = x[:12]
    best = [float(np.sort(x @ v)[-6]) for v in y]
    asked = pa.table({"y": list(y), "label": [0] * 12, "low": [[int(b * 0.8)] for b in best], "high": [[int(b)] for b in best], "same": [False] * 12})
    need = vectors.needed(zones, asked, 16)
    assert 0 < need.mean() < 0.35
    for j, v in enumerate(y):  # nothing that is asked for lies in a block left out
        inside = {n for n in range(60) if any(best[j] * 0.8 <= s <= best[j] for s in x[order[n * 20 : n * 20 + 20]] @ v)}
        assert inside <= set(np.flatnonzero(need[:, j]))


def test_the_curve_visits_neighbours():
    grid = np.array([(a, b) for a in range(-2, 2) for b in range(-2, 2)], float) + 0.5
    keys = mining.hilbert_keys(grid, 1.0)
    path = grid[sorted(range(16), key=lambda i: keys[i])]
    assert len(set(keys)) == 16 and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
