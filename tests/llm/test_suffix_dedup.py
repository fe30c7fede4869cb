import hashlib
import random

import numpy as np
import pytest
from helpers import DOCS, corpus, edge_rows, with_clashes, words
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import suffix_dedup as m


def brute(texts, length):
    """Maximal runs of bytes covered by a string that starts twice or more."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        cover = np.r_[0, (np.cumsum(hit)[:-1] > 0).astype(int), 0]
        out.append(list(zip(np.flatnonzero(np.diff(cover) == 1).tolist(), np.flatnonzero(np.diff(cover) == -1).tolist(), strict=True)))
    return out


def wanted(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    out = []
    for r, t, spans in zip(rows, texts, brute(texts, length), strict=True):
        left = b"".join(t[i:j] for i, j in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(t)], strict=True))
        out.append((r[0], len(t), sum(e - s for s, e in spans), len(spans), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def answer(df):
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]),
                    hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=120), st.sampled_from([1, 2, 5, 8, 13, 16, 40]))
def test_longest_factors(values, depth):
    text = np.array(values, np.uint8)
    starts = np.arange(max(0, len(text) - depth + 1))
    got = m.longest_factors(text, starts, depth)

    def match(i, j):
        k = 0
        while k < depth and text[i + k] == text[j + k]:
            k += 1
        return k
    assert got[0].tolist() == [max((match(i, j) for j in range(i)), default=0) for i in starts]
    assert got[1].tolist() == [max((match(i, j) for j in range(i + 1, len(starts))), default=0) for i in starts]


@given(st.lists(st.integers(0, 9), max_size=60))
def test_nearest_smaller(values):
    got = m.nearest_smaller(np.array(values, np.int64)).tolist() if values else []
    assert got == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_anchors_belong_to_their_strings(monkeypatch, chunk):
    """Equal strings have equal anchors at equal distance, in any text."""
    monkeypatch.setattr(m, "CHUNK", chunk)
    rng = random.Random(3)
    shared = bytes(rng.randrange(97, 100) for _ in range(500))
    seen = {}
    for text in (shared, b"x" * 77 + shared, bytes(rng.randrange(256) for _ in range(300)) + shared + b"yy", b"aaaa" * 200):
        key, first, last = m.anchors(text)
        assert first[0] == 0 and last[-1] == len(text) - m.LENGTH and (first[1:] == last[:-1] + 1).all()
        for k, i, j in zip(key, first, last, strict=True):
            for s in range(i, j + 1):
                assert seen.setdefault(text[s:s + m.LENGTH], k) == k
    assert len(m.anchors(b"a" * 199)[0]) == 0


def passages(seed):
    """Texts that share passages of many lengths, also with themselves, at shifted places."""
    rng = np.random.default_rng(seed)
    common = [words(rng, int(k), 400) for k in (30, 45, 60, 120)] + ["la " * 150, "日本語テキスト" * 20]
    rows = []
    for i in range(60):
        parts = [words(rng, int(rng.integers(0, 40)), 4000)]
        for c in rng.choice(len(common), int(rng.integers(0, 3))):
            text = common[c]
            lo = int(rng.integers(0, 40))
            parts += [text[lo:lo + int(rng.integers(100, 500))], words(rng, int(rng.integers(0, 9)), 50)]
        rows.append((i * 2, " ".join(parts), "en", "s", 0))
    return rows


@pytest.mark.parametrize("rows", [corpus(), edge_rows(), passages(1), passages(2), []])
@pytest.mark.parametrize("group", [2048, 1])
def test_against_brute_force(spark, rows, group):
    """Both ways of comparing contexts give the same; the second deals every string."""
    got = m.without_repeats(with_clashes(spark.createDataFrame(rows, DOCS)), group=group)
    assert answer(got) == wanted(rows, 200)


def test_other_lengths(spark):
    rows = passages(4)
    got = m.without_repeats(spark.createDataFrame(rows, DOCS), length=50, gram=20)
    assert answer(got) == wanted(rows, 50)


def test_exact_edges(spark):
    """199 equal bytes stay, 200 go; copies within a text go too; cuts fall inside characters."""
    a, b = "".join(chr(97 + i * i % 23) for i in range(199)), "".join(chr(65 + i * i % 19) for i in range(200))
    rows = [(1, "1" + a + "2", None, None, None), (2, "3" + a + "4", None, None, None), (3, "5" + b + "6", None, None, None),
            (4, "7" + b + "8" + b + "9", None, None, None), (5, "é" * 100, None, None, None), (6, "a" + "é" * 101, None, None, None),
            (7, "z" * 201, None, None, None)]
    got = answer(m.without_repeats(spark.createDataFrame(rows, DOCS)))
    assert got == wanted(rows, 200)
    assert [(g[0], g[2]) for g in got] == [(1, 0), (2, 0), (3, 200), (4, 400), (5, 200), (6, 202), (7, 201)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in m.query(spark, sf).collect()), key=repr)
    assert got == wanted(rows, 200) and sum(g[2] for g in got) > 0
