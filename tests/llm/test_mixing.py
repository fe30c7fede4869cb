import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import DOCS, corpus, edge_rows, with_clashes, words
from pyspark.sql import functions as F

from cadence.llm import mixing as m


def plain_targets(sizes, weights=(1, 2, 3), most=3.0):
    """Shares by weight; the excess over a cap is reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if most * sizes[s] < weight[s] * level}
        if not over:
            return {s: most * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "z", "日", "s1", "s10", "s2"][:rng.randint(1, 10)]
    sizes = {s: rng.choice([0, 1, 5, 100, 10_000]) for s in names}
    got = m.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = plain_targets(sizes)
    for r in got.collect():
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)


def test_settled_keeps_mass_and_expectation():
    rng = random.Random(1)
    for _ in range(300):
        p, q, w, v = rng.random(), rng.random(), rng.randint(1, 500), rng.randint(1, 500)
        up, down = min(w * (1 - p), v * q), min(w * p, v * (1 - q))
        edge = down / (up + down)  # draws below gain, others lose
        gain, lose = m.settled(p, w, q, v, edge * 0.5), m.settled(p, w, q, v, edge + (1 - edge) * 0.5)
        for a, b in (gain, lose):
            assert math.isclose(w * a + v * b, w * p + v * q, rel_tol=1e-9) and (a in (0.0, 1.0) or b in (0.0, 1.0))
            assert 0 <= a <= 1 and 0 <= b <= 1
        assert math.isclose(edge * gain[0] + (1 - edge) * lose[0], p, rel_tol=1e-9, abs_tol=1e-12)


def test_mix_is_near_its_targets_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 8)  # several buckets and levels on a small table
    monkeypatch.setattr(m, "FAN_IN", 3)
    rng = np.random.default_rng(2)
    rows = [(i, words(rng, int(rng.integers(0, 60))), "en", "hot" if i % 3 else f"s{i % 9}", 0) for i in range(600)]
    rows.append((1000, words(rng, 9000), "en", "s3", 0))  # longer than its source's target
    docs = spark.createDataFrame(rows, DOCS)
    a = m.copies(with_clashes(docs.repartition(7))).collect()
    b = m.copies(docs.repartition(2, "lang")).collect()
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == len(rows)
    by = defaultdict(list)
    for r in a:
        by[r["source"]].append(r)
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]][1] if r["doc_id"] < 1000 else rows[-1][1]))
        assert 0 <= r["copies"] <= 3
    want = plain_targets({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert math.isclose(rs[0]["target"], want[s], rel_tol=1e-9)
        assert abs(sum(r["size"] * r["copies"] for r in rs) - want[s]) <= max(60, m.NEAR * want[s])


def test_expectations(spark):
    """Over many seeds each document is taken about as often as its source's share asks."""
    rng = np.random.default_rng(5)
    rows = [(i, words(rng, 10 + i % 7), "en", f"s{i % 3}", 0) for i in range(45)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    runs = [m.copies(docs, seed=k).select("doc_id", (F.col("copies") - F.col("target") / F.col("source_size")).alias("off")).collect() for k in range(6)]
    assert abs(np.mean([r["off"] for run in runs for r in run])) < 0.05


def test_edges_and_rows(spark):
    docs = with_clashes(spark.createDataFrame(edge_rows(), DOCS))
    got = m.copies(docs).collect()
    assert sum(r["times"] for r in got) == len(edge_rows())
    assert all(r["copies"] <= 3 for r in got)
    mixed = m.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] * r["times"] for r in got)
    empty = spark.createDataFrame([], DOCS)
    assert m.copies(empty).count() == 0 and m.mix(empty).count() == 0
    whole = spark.createDataFrame(corpus(), DOCS)
    n = {(r["doc_id"], r["source"]): r["copies"] for r in m.copies(whole).collect()}
    out = m.mix(whole).groupBy("doc_id", "source").count().collect()
    assert {(r["doc_id"], r["source"]): r["count"] for r in out} == {k: c for k, c in n.items() if c}
