import math

import numpy as np
import pytest
from helpers import DOCS, corpus, edge_rows, with_clashes, words

from cadence.llm import jaccard_join as j
from cadence.llm.common import block_pairs, components, local_roots, shingles


def brute(rows, threshold=0.8):
    """(links, class) of every row with an id."""
    rows = [r for r in rows if r[0] is not None]
    sets = [set(shingles((t or "").encode()).tolist()) for _, t, *_ in rows]
    x, y = [], []
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                x.append(a), y.append(b)
    n = np.bincount(x + y, minlength=len(rows))
    same_id = {}
    for k, r in enumerate(rows):  # rows of one id are one node of the classes
        if r[0] in same_id and sets[k]:
            x.append(k), y.append(same_id[r[0]])
        elif sets[k]:
            same_id[r[0]] = k
    root = local_roots(len(rows), np.array(x, int), np.array(y, int))
    return [(rows[k][0], min(rows[m][0] for m in range(len(rows)) if root[m] == root[k]), int(n[k])) for k in range(len(rows))]


@pytest.mark.parametrize("blocks", [(512, 128), (4, 3)])
def test_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(j, "BLOCK", blocks[0])
    monkeypatch.setattr(j, "SET_BLOCK", blocks[1])
    rng = np.random.default_rng(4)
    rows = corpus()
    base = words(rng, 150).split()
    for k in range(40):  # one large group of near copies, with links and gaps on both sides of the threshold
        w = list(base)
        for at in rng.integers(0, len(w), 1 + k // 8):
            w[at] = f"edit{k}"
        rows.append((1000 + k, " ".join(w), "en", "s", 0))
    df = with_clashes(spark.createDataFrame(rows, DOCS).repartition(6))
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in j.jaccard_join(df).collect())
    assert got == sorted(brute(rows))
    kept = j.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_edges(spark):
    rows = edge_rows()
    out = j.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    assert all((r["class_id"], r["n_links"], r["kept"]) == (None, 0, False) for r in out if r["doc_id"] is None)
    named = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out if r["doc_id"] is not None)
    assert named == sorted(brute(rows))
    kept = sorted((r["doc_id"] for r in j.one_of_each(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert kept == sorted([1, 1, None, None, None, 7, 8, 9], key=repr)  # both texts of id 1
    assert j.jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    assert j.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_least_matches():
    least = j.least_matches(0.8)
    assert all(b > a for a, b in zip(least, least[1:], strict=False))
    rng = np.random.default_rng(0)  # pairs at the threshold all but never drop
    draws = rng.random((20_000, j.HASHES)) < 0.8
    seen = np.cumsum(draws, 1)[:, j.STEP - 1::j.STEP]
    assert (seen < np.array(least)).any(1).mean() < 0.001
    assert math.isclose(sum(math.comb(17, i) * 0.8**i * 0.2**(17 - i) for i in range(18)), 1)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    off = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(15):
            a = rng.integers(0, 2**63, 800).astype(np.uint64)
            b = a.copy()
            b[:int(800 * (1 - share))] = rng.integers(0, 2**63, int(800 * (1 - share)))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            off.append((j.signature(a) == j.signature(b)).mean() - true)
    assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.2


def test_shared_both_ways():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, 500).astype(np.uint64)) for _ in range(40)]
    x, y = np.triu_indices(40, 1)
    want = [len(set(sets[a]) & set(sets[b])) for a, b in zip(x, y, strict=True)]
    assert j.shared(sets, x, y).tolist() == want and j.shared(sets, x[:50], y[:50]).tolist() == want[:50]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (None, 3)] + [(300, k) for k in range(301, 350)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [*range(1, 41), 100]}, 200: 200, 201: 200, **{k: 300 for k in range(300, 350)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_pairs_meet_once(spark):
    df = spark.createDataFrame([(g, 100 * g + i) for g, n in ((1, 1), (2, 2), (3, 25)) for i in range(n)], "g long, m long")
    rows = block_pairs(df, "g", "m", 4).collect()
    met = []
    by = {}
    for r in rows:
        by.setdefault(r["key"], []).append(r)
    for members in by.values():
        for a in members:
            for b in members:
                if a["m"] < b["m"] and (a["same"] or a["side"] != b["side"]):
                    met.append((a["m"], b["m"]))
    assert sorted(met) == sorted((100 * g + a, 100 * g + b) for g, n in ((2, 2), (3, 25)) for a in range(n) for b in range(a + 1, n))
