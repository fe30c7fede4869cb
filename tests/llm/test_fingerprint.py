import hashlib

import numpy as np
import pytest
from helpers import DOCS, corpus, edge_rows, with_clashes, words

from cadence.llm import fingerprint as f
from cadence.llm.common import shingles


def jaccard(a, b):
    x, y = set(shingles(a.encode()).tolist()), set(shingles(b.encode()).tolist())
    return len(x & y) / max(1, len(x | y))


@pytest.mark.parametrize("n", [5, 40, 300, 3000])
def test_likeness_estimates_jaccard(n):
    rng = np.random.default_rng(n)
    errors = []
    for share in (0.05, 0.2, 0.5):
        for _ in range(8):
            w = words(rng, n).split()
            v = list(w)
            v[:int(n * share)] = words(rng, int(n * share)).split()
            a, b = " ".join(w), " ".join(v)
            errors.append(f.likeness(f.fingerprint(a.encode()), f.fingerprint(b.encode())) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.2


def test_equal_and_empty():
    a = f.fingerprint(b"one")
    assert f.likeness(a, f.fingerprint(b"one")) == 1.0 and f.likeness(b"", b"") == 1.0 and f.likeness(a, b"") == 0.0
    assert len(a) == f.BINS * f.BITS // 8 and f.fingerprint(b"  \n") == b""


@pytest.mark.parametrize("range_rows", [500, 3])
def test_against_plain_loop(spark, monkeypatch, range_rows):
    monkeypatch.setattr(f, "RANGE_ROWS", range_rows)
    rows = corpus()
    df = with_clashes(spark.createDataFrame(rows, DOCS).repartition(4))
    got = {r["doc_id"]: r for r in f.fingerprints(df).collect()}
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        new = text[:len(text) - cut] + following[:cut]
        r = got[i]
        fp = f.fingerprint(text.encode())
        assert (r["n_chars"], r["fingerprint"]) == (len(text), f.as_text(fp))
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["edited_fingerprint"] == f.as_text(f.fingerprint(new.encode()))
        assert r["near_next"] == f.likeness(fp, f.fingerprint(following.encode()))


def test_edges(spark):
    got = f.fingerprints(spark.createDataFrame(edge_rows(), DOCS)).collect()
    assert len(got) == len(edge_rows())
    assert all(r["near_next"] == 1.0 for r in got if r["doc_id"] is None)  # its own next document
    first = [r for r in got if r["doc_id"] == 1]
    assert len({r["fingerprint"] for r in first}) == 2 and max(r["near_next"] for r in first) == 1.0
    assert f.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    one = f.fingerprints(spark.createDataFrame([(5, "a b c d e f g h", "en", "s", 15)], DOCS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
