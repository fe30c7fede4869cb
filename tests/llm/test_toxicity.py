import zlib

import numpy as np
from helpers import DOCS, edge_rows, with_clashes, words

from cadence.llm import toxicity as t

LABELS = "doc_id long, quality int, toxic int"


def abusive_corpus(n=900, seed=3):
    """Made-up texts; toxic ones hold inflected forms of three stems."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, int(rng.integers(20, 120)), 3000).split()
        toxic = int(rng.random() < 0.15)
        if toxic:
            for at in rng.integers(0, len(w), 4):
                w[at] = ["grumbo", "fetzel", "idiot"][int(rng.integers(3))] + ["", "a", "ish", "en"][int(rng.integers(4))]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = abusive_corpus()
    docs, y = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r for r in t.score(with_clashes(docs), y).collect()}
    truth = {i: v for i, _, v in labels}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i in got if got[i]["held_out"]]
    hit = [got[i]["predicted"] for i in held if truth[i]]
    clean = [got[i]["predicted"] for i in held if not truth[i]]
    assert np.mean(hit) >= 0.95 and np.mean(clean) <= 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= t.TOXIC) for r in got.values())


def test_held_out_labels_change_nothing(spark):
    rows, labels = abusive_corpus(300)
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, q, 1 - v if zlib.crc32(str(i).encode()) % 3 == 1 else v) for i, q, v in labels]
    a, b = (sorted(map(tuple, t.score(docs, spark.createDataFrame(y, LABELS)).collect())) for y in (labels, turned))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame(edge_rows() + [(20, "you idiot, you worthless moron", "en", "s", 1)], DOCS)
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None, 0), (1, 0, 1), (None, 0, 1), (7, 0, None), (8, 1, 5)], LABELS)
    for y in (none, odd):
        got = t.score(docs, y).collect()
        assert len(got) == docs.count()
        assert [r["predicted"] for r in got if r["doc_id"] == 20] == [1]
        assert not any(r["predicted"] for r in got if r["doc_id"] != 20)
        assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert t.score(spark.createDataFrame([], DOCS), none).count() == 0
    kept = t.without_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1


def test_lexicons_of_a_thousand_entries(spark):
    rng = np.random.default_rng(5)
    insults = [f"zq{i:04d}" for i in range(1000)]
    rows, sample = [], []
    for i in range(1200):
        w = words(rng, 60, 3000).split()
        if i % 4 == 0:
            w += [insults[int(k)] for k in rng.choice(1000, 60, replace=False)]
        rows.append((i, " ".join(w), "en", "s", 0))
        sample.append((i, int(i % 4 == 0)))
    found = t.learned_lexicons(spark.createDataFrame(rows, DOCS), spark.createDataFrame(sample, "doc_id long, toxic int"))
    assert len({e for k, e in found if k == 0} & set(insults)) >= 990
    assert len({e for k, e in found if k == 0} - set(insults)) <= 5


def test_toxic_texts_made_from_clean_ones_and_from_each_other(spark):
    rng = np.random.default_rng(6)
    rows, sample = [], []
    for i in range(60):  # a clean text, and two toxic ones made from it
        base = words(rng, 80, 3000)
        for k, text in enumerate((base, f"{base} grumbo{i % 2}", f"{base} and {'fetzel' if i % 3 else 'plumk'}")):
            rows.append((3 * i + k, text, "en", "s", 0))
            sample.append((3 * i + k, int(k > 0)))
    found = t.learned_lexicons(spark.createDataFrame(rows, DOCS), spark.createDataFrame(sample, "doc_id long, toxic int"))
    assert {e for k, e in found if k == 0} - {"and"} == {"grumbo0", "grumbo1", "fetzel", "plumk"}


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    n, share = 100_000, 0.1
    y = rng.random(n) < share
    rates = [(0.8, 0.02), (0.6, 0.01), (0.4, 0.05), (0.5, 0.02), (0.7, 0.03)]
    v = np.array([np.where(y, rng.random(n) < p1, rng.random(n) < p0) for p1, p0 in rates] + [rng.random(n) < 0.2]).T.astype(float)
    v = np.column_stack([v, np.where(rng.random(n) < 0.9, v[:, 0], rng.random(n) < 0.1)])  # a copy of the first
    label = np.where(rng.random(n) < 0.02, y, -1).astype(float)
    patterns, count = np.unique(np.column_stack([v, label]), axis=0, return_counts=True)
    found, pairs, discount, posterior = t.label_model(patterns[:, :-1], patterns[:, -1], count, share)
    assert (0, 6) in pairs and discount[6] < 0.75 and discount[1] > 0.8
    for (p1, p0), (q1, q0) in zip(rates, found, strict=False):
        assert abs(p1 - q1) < 0.08 and abs(p0 - q0) < 0.02
    assert abs(found[5][0] - found[5][1]) < 0.03  # a voter that knows nothing
    truth = {tuple(p): [] for p in v.tolist()}
    for row, toxic in zip(v.tolist(), y, strict=True):
        truth[tuple(row)].append(toxic)
    error = sum(abs(q - np.mean(truth[tuple(p[:-1])])) * c for p, q, c in zip(patterns.tolist(), posterior, count, strict=True)) / n
    assert error < 0.06


def test_words():
    assert t.words_of("You, IDIOT! idiot's 'x' a-b été") == {"you": 1, "idiot": 2, "s": 1, "x": 1, "a": 1, "b": 1, "été": 1}
    assert t.entries_of(t.words_of("grumbos and " + "x " * 150)) >= {(0, "grumbos")}  # one word in 150 makes no stem
    assert (5, "grumb") in t.entries_of(t.words_of("grumbos grumboes and " + "x " * 150))
