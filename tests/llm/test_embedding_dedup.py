import numpy as np
from helpers import with_clashes

from cadence.llm import embedding_dedup as e
from cadence.llm.common import local_roots


def brute(rows, threshold):
    """Links and components of (vec_id, vector) rows, ids distinct."""
    unit = [None if (v := e.usable(x)) is None else v / np.linalg.norm(v) for _, x in rows]
    x, y = [], []
    for i, a in enumerate(unit):
        for j in range(i):
            if a is not None and unit[j] is not None and len(a) == len(unit[j]) and float(a @ unit[j]) >= threshold:
                x.append(j), y.append(i)
    n = np.bincount(x, minlength=len(rows)) + np.bincount(y, minlength=len(rows)) if x else np.zeros(len(rows), int)
    root = local_roots(len(rows), np.array(x, int), np.array(y, int))
    ids = [i for i, _ in rows]
    return {i: (int(n[k]), min(ids[m] for m in range(len(rows)) if root[m] == root[k])) for k, (i, _) in enumerate(rows)}


def clustered(seed=0, n=300, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[50:120] = x[50] + 0.12 * rng.standard_normal((70, dim))  # a dense group
    x[200:230] = x[200] + 0.22 * rng.standard_normal((30, dim))  # around the threshold
    x[240:250] = x[240] * np.linspace(1, 3, 10)[:, None]
    return [(int(i), [float(f) for f in v]) for i, v in zip(rng.permutation(n) + 5, x, strict=True)]


def test_recall_and_precision(spark, monkeypatch):
    rows = clustered()
    want = brute(rows, e.THRESHOLD)
    for name, value in {"LEAF": 32, "BUCKET": 64, "BLOCK": 20}.items():  # several buckets, leaves and blocks on a small table
        monkeypatch.setattr(e, name, value)
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    got = {r["vec_id"]: r for r in e.near_copies(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert sum(got[i]["component_id"] == c for i, (_, c) in want.items()) >= 0.97 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]),
            (9, [1e300, 1e300]), (10, [1.0, 1.0, 0.0]), (11, [-1.0, -1.0]), (None, [1.0, 1.0]), (12, [5e-324, 5e-324]), (7, [1.0, 1.0])]
    got = sorted((tuple(r) for r in e.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    same = {7, 8, 9, 12}  # one direction; 7 is there twice
    want = [(i, 4 if i in same else 0, None if i is None else 7 if i in same else i, i is not None and (i not in same or i == 7)) for i, _ in rows]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert e.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_every_row_reaches_a_leaf_and_spills():
    p = np.random.default_rng(0).standard_normal((3000, 8))
    at, name = e.leaves(p, 64, 0.95, leaf=100)
    assert set(at) == set(range(3000)) and 3000 < len(at) < 3000 * 2
    splits = e.grown(p, 4)
    rows, nodes = e.routed(splits, p)
    assert set(rows) == set(range(3000)) and len(set(nodes)) == 16


def test_dense_group_is_not_cut_by_many_levels(spark, monkeypatch):
    """A third of the rows within cosine 0.97 of each other, under 8 levels of the trees' tops, and pairs near its edge."""
    rng = np.random.default_rng(3)
    n, dim = 3000, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:2000] = x[1000] + np.sqrt(1 / 0.97 - 1) * x[1000:2000]
    x[2000:2040] = x[1000] + np.linspace(0.2, 0.7, 40)[:, None] * x[2000:2040]
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= e.THRESHOLD
    want = linked.sum(axis=1) - 1
    for name, value in {"LEAF": 8, "BUCKET": 8, "BLOCK": 256}.items():
        monkeypatch.setattr(e, name, value)
    got = {r["vec_id"]: r for r in e.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()}
    links = np.array([got[i]["n_links"] for i in range(n)])
    assert (links <= want).all() and links.sum() >= 0.999 * want.sum()
    assert len({got[i]["component_id"] for i in range(1000, 2000)}) == 1
