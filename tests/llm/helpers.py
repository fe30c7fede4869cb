"""Small tables for the operators of cadence.llm."""

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; extra columns may have them.
CLASHES = ["key", "n", "size", "rep", "root", "u", "v", "part", "guest", "bucket", "copies", "sig", "side", "same", "token", "address",
           "rule", "verdict", "leaf", "node", "tree", "unit", "dim", "links", "to", "kind", "seq", "start", "score", "hits", "row",
           "length", "rank", "low", "high", "first", "offset", "times", "whole", "extra", "p", "dice", "target", "source_size", "keeper",
           "sha", "payload", "toxic", "embedding_", "host", "path", "won", "a", "b", "i", "j", "d", "t", "w", "_n", "_nb", "_own", "_other"]


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def with_clashes(df):
    """``df`` with a column of every name in CLASHES that it doesn't have."""
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})


def corpus(seed=1, n=60):
    """Documents with copies, near copies, empty, null, short and one very long text."""
    rng = np.random.default_rng(seed)
    texts = [words(rng, int(k)) for k in rng.integers(20, 200, n)]
    for i in range(0, 20, 2):  # near copies of various likeness
        w = texts[i].split()
        for at in rng.integers(0, len(w), 1 + i // 4):
            w[at] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[1], "", None, "   ", "one", "one two three four", "one two three four", words(rng, 30_000), "Ünï ß 日本 😀 text\u00a0here"]
    return [(i * 3, t, "en", f"s{i % 4}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]


def edge_rows():
    """Nulls in any column, ties and repeated rows."""
    return [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (1, "other words here that differ", None, None, None),
            (None, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (None, None, None, None, None), (7, None, "de", "t", 0), (8, "", "de", None, 0),
            (9, "x" * 50_000, "en", "s", 50_000)]
