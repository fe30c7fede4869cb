import random

import pytest
from helpers import DOCS, corpus, edge_rows, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import token_counts as c
from cadence.llm.tokens import default_path, encoder

EDITS = "doc_id long, seq long, start long, removed long, inserted string"
PARTS = ["a", "b", "'", "re", "ll", " ", "  ", "\n", "\t", "9", "12", "!", "é", "ß", " the", " don't", "日本", "😀", "　", "\x85", "_", "\x1f", "²", "<|endoftext|>", "<|endoftext|>"[:5], "<|endoftext|>"[5:]]


def total(text):
    return len(encoder(default_path()).slow.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_edits_against_encoding_anew(monkeypatch, leaf):
    monkeypatch.setattr(c, "LEAF", leaf)
    enc = encoder(default_path())
    counts, rng = c.PieceCounts(enc), random.Random(leaf)
    for _ in range(600):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))
        tree = c.SegmentTree(text, enc, counts)
        for _ in range(4):
            start, removed = rng.randrange(len(text) + 3), rng.choice([0, 0, 1, 2, 5, 30])
            new = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 0, 1, 2, 9])))
            tree.edit(start, removed, new)
            text = text[:start] + new + text[start + removed:] if start < len(text) else text + new
            assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, len(text), total(text))
            assert [p for leaf_ in tree.leaves for p in leaf_] == enc.split(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library(text):
    enc = encoder(default_path())
    assert enc.ids(text).tolist() == enc.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 9000, " " * 9000, "é!" * 5000, "<|endoftext|> x <|endoftext|>", "x\n" * 4000])
def test_long_runs_and_special_tokens(text):
    enc = encoder(default_path())
    assert enc.ids(text).tolist() == enc.slow.encode(text, add_special_tokens=False).ids


def test_special_tokens_made_and_broken_by_edits():
    enc = encoder(default_path())
    text = "hello <|endoftext|> world"
    tree = c.SegmentTree(text, enc, c.PieceCounts(enc))
    assert tree.n_tokens == total(text) == 4
    for start, removed, new in [(8, 1, ""), (8, 0, "e"), (18, 1, ""), (18, 0, ">"), (6, 0, "<|endof"), (13, 0, "text|>"), (0, 3, "<|endoftext|>")]:
        tree.edit(start, removed, new)
        text = text[:start] + new + text[start + removed:]
        assert (tree.text(), tree.n_tokens) == (text, total(text))


def test_edits_touch_little():
    enc = encoder(default_path())
    tree = c.SegmentTree("some words and more words " * 5000, enc, c.PieceCounts(enc))
    for k in range(50):
        tree.edit(1000 * k, 3, "xyz")
    assert tree.encoded < 50 * 12 and tree.n_tokens == total(tree.text())


def test_query_against_plain_counts(spark):
    rows = corpus()
    docs = with_clashes(spark.createDataFrame(rows, DOCS).repartition(4))
    got = {r["doc_id"]: r for r in c.count_tokens(docs, c.query_edits(docs)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        text = text or ""
        n, r = len(text), got[i]
        new = text[:n // 3] + text[n // 3 + n // 12:]
        middle = text[max(0, n // 2 - 1):max(0, n // 2 - 1) + 24] if n // 2 else text[:23]
        new = middle + new
        at = min(2 * n // 3, len(new))
        new = new[:at] + f" revised {i}" + new[at + 8:]
        assert (r["n_chars"], r["n_tokens"], r["n_edits"]) == (n, total(text), 3)
        assert (r["edited_chars"], r["edited_tokens"]) == (len(new), total(new))


def test_edges(spark):
    docs = spark.createDataFrame(edge_rows(), DOCS)
    edits = spark.createDataFrame([(1, 2, 0, 1, "zz"), (1, 1, 999, 5, "end"), (1, None, None, None, None), (None, 1, 0, 5, "x"), (77, 1, 0, 0, "y")], EDITS)
    got = c.count_tokens(docs, edits).collect()
    assert len(got) == len(edge_rows())
    want = []
    for i, text, *_ in edge_rows():
        text = text or ""
        new = "zz" + (text + "end")[1:] if i == 1 else text
        want.append((i, len(text), total(text), 3 if i == 1 else 0, len(new), total(new)))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert c.count_tokens(docs).count() == len(edge_rows())
    empty = spark.createDataFrame([], DOCS)
    assert c.count_tokens(empty, c.query_edits(empty)).count() == 0
