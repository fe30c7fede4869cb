import hashlib
import zlib

import pytest
from helpers import DOCS, corpus, edge_rows, with_clashes

from cadence.llm import merkle as m


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(r, n_chars):
    i, text, lang, source, _ = r
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)])


def climbed(nodes):
    """Root of a list of digests, and the siblings of each: (left, right) a level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, x in enumerate(at):
            paths[k].append((nodes[x - 1] if x % 2 else "", nodes[x + 1] if x % 2 == 0 and x + 1 < len(nodes) else ""))
        nodes = [H(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [x // 2 for x in at]
    return nodes[0], paths


def brute(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    built = {}
    for name in names:
        own = sorted(trees[name], key=lambda r: (first(r[0]), leaf(r, r[4])))
        built[name] = own, *climbed([leaf(r, r[4]) for r in own])
    root, tops = climbed([built[n][1] for n in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        own, subroot, paths = built[name]
        for r, path in zip(own, paths, strict=True):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, r[4] + 1 if hit else r[4])
            for a, b in path + top:
                h = H(a, h, b)
            out.append((r[0], leaf(r, r[4]), subroot, root, H(*[a or b for a, b in path + top]), h, h == root))
    return out


def many(n, lang):
    return [(i * 2 + 1, f"text {i}", lang, "s", i) for i in range(n)]


@pytest.mark.parametrize("digit, rows", [
    (5, corpus() + edge_rows()), (1, many(23, "en") + many(1, None) + many(4, "de") + many(2, "")), (2, many(70, None)),
    (1, [(i, "t", f"lang {i}", None, None) for i in range(19)]), (5, many(1, "x")), (5, many(1030, "x") + many(1024, "ü"))])
def test_against_plain_trees(spark, tmp_path, monkeypatch, digit, rows):
    """Blocks of four leaves make up to four layers; the trees' names are layered alike."""
    monkeypatch.setattr(m, "DIGIT", digit)
    monkeypatch.setattr(m, "BLOCK", 2 * digit)
    with_clashes(spark.createDataFrame(rows, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in m.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert m.query(spark, str(tmp_path)).collect() == []
