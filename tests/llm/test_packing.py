import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import DOCS, corpus, edge_rows, with_clashes

from cadence.llm import packing as p
from cadence.llm.tokens import default_path, encoder


def best_fit_decreasing(lengths, size):
    """Number of sequences of the plain greedy, one piece at a time."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((size if fit is None else fit) - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 20, 64, 128])
    lengths = [rng.randint(1, size) if rng.random() < 0.7 else rng.randint(1, max(1, size // 4)) for _ in range(rng.choice([1, 5, 60, 800]))]
    made = p.plan(Counter(lengths), size)
    used = Counter()
    for sequence, times in made:
        assert sum(sequence) <= size and times > 0
        for x in sequence:
            used[x] += times
    assert used == Counter(lengths)
    n = sum(t for _, t in made)
    assert -(-sum(lengths) // size) <= n <= best_fit_decreasing(lengths, size)


@pytest.mark.parametrize("seed", range(8))
def test_index_of_sums(seed):
    rng = random.Random(seed)
    size = 24
    have = [0, *(rng.choice([0, 0, 1, 2, 3]) for _ in range(size))]
    sums = p.Sums(have)
    while any(have[1:size]):
        length = rng.choice([x for x in range(1, size) if have[x]])
        parts = rng.choice([1, 2, 3])
        others = have.copy()
        others[length] -= 1
        pool = [x for x in range(1, size) for _ in range(min(3, others[x]))]
        possible = any(sum(c) == size - length for k in range(1, parts + 1) for c in combinations(pool, k))
        rest = sums.fill(length, size - length, parts)
        assert (rest is not None) == possible
        for x in (length, *(rest or ())):
            have[x] -= 1
        assert rest is None or sum(rest) == size - length and len(rest) <= parts and min(have) >= 0


@pytest.mark.parametrize("sf, most", [("sf0.001", 193), ("sf0.01", 964)])
def test_no_worse_than_best_fit_alone(sf, most):
    enc, lengths = encoder(default_path()), Counter()
    for text in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(enc.ids(text or "")) + 1
        lengths.update([n % 1024 or 1024] + [1024] * (-(-n // 1024) - 1))
    assert sum(times for _, times in p.plan(lengths)) <= most


def test_exact_complements_first():
    made = p.plan({7: 3, 1: 3, 5: 1, 2: 2, 4: 2, 3: 1}, 8)
    assert ((7, 1), 3) in made and sum(t for _, t in made) == 6


def check(rows, got, size):
    enc = encoder(default_path()).slow
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    n_tokens = 0
    texts = defaultdict(list)
    for i, text, *_ in rows:
        ids = np.array([*enc.encode(text or "", add_special_tokens=False).ids, p.END], "<u4")
        n_tokens += len(ids)
        first = len(ids) % size or size
        texts[i].append([(k, s, len(ids[s:e]), zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(
            [(0, first), *((s, s + size) for s in range(first, len(ids), size))])])
    for i, wanted in texts.items():
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == sorted(x for w in wanted for x in w)
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    assert len(at) <= -(-n_tokens // size) * 1.1 + 2


@pytest.mark.parametrize("size", [1024, 64])
def test_against_the_tokenizers_library(spark, size):
    rows = corpus()
    got = p.pack(with_clashes(spark.createDataFrame(rows, DOCS).repartition(5)), size=size).collect()
    check(rows, got, size)
    again = p.pack(spark.createDataFrame(rows, DOCS).coalesce(1), size=size).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_edges(spark):
    check(edge_rows(), p.pack(spark.createDataFrame(edge_rows(), DOCS)).collect(), 1024)
    assert p.pack(spark.createDataFrame([], DOCS)).count() == 0
