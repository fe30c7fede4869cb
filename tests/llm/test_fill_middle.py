import hashlib
import re

import pytest
from helpers import DOCS, corpus, edge_rows, with_clashes

from cadence.llm import fill_middle as m

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc_id, text, rate=50, spm=80, marks=m.MARKS):
    """(n, form, output, prefix, middle) by a loop over the units."""
    text = text or ""
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    u = UNIT.findall(text)
    assert "".join(u) == text
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    p, s, k = marks
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return n, "spm", s + z + p + x + k + y, len(x), len(y)
    return n, "psm", p + x + s + z + k + y, len(x), len(y)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


ODD = ["\t\n lead and trail \x0b\x0c\r", "<P> inside", "a<S", "S>b <", "<<P", " nbsp wide \u0085", "😀 😀\n😀", "$1 \\ {2} (x", " ", "x"]


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 50), (100, 0), (0, 80)])
def test_against_a_loop(spark, rate, spm):
    rows = corpus() + edge_rows() + [(5000 + 20 * i + k, t, None, None, None) for i in range(12) for k, t in enumerate(ODD)]
    got = m.fill_in_middle(with_clashes(spark.createDataFrame(rows, DOCS)), rate, spm).collect()
    key = lambda r: repr(r)
    want = [(r[0], r[1] or "", *plain(r[0], r[1], rate, spm)[:3]) for r in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_query_digests(spark, tmp_path):
    rows = corpus() + edge_rows() + [(7000 + k, t, "en", "s", 1) for k, t in enumerate(ODD)]
    with_clashes(spark.createDataFrame(rows, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in m.query(spark, str(tmp_path)).collect()]
    want = []
    for i, t, *_ in rows:
        n, form, output, x, y = plain(i, t)
        want.append((i, n, form, x, y, sha(output), sha(t or "")))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_other_marks(spark):
    marks = ("[$1]", "{s\\}", "#m#")
    rows = [(i, f"one {i} two $1 three\n{i}", "en", "s", 1) for i in range(40)]
    got = m.fill_in_middle(spark.createDataFrame(rows, DOCS), 100, 50, marks=marks)
    assert {r["form"] for r in got.collect()} == {"psm", "spm"}
    for r in got.collect():
        assert r["output"] == plain(r["doc_id"], r["text"], 100, 50, marks)[2]
    with pytest.raises(ValueError):
        m.fill_in_middle(got, marks=("a", "a", "b"))


def test_very_long_text_and_empty_table(spark):
    """A million units match without recursion; an empty table stays empty."""
    text = "a\n" * 1_000_000
    got = m.fill_in_middle(spark.createDataFrame([(i, text, "en", "s", 1) for i in range(3)], DOCS), 100).collect()
    for r in got:
        assert r["output"] == plain(r["doc_id"], text, 100)[2]
    assert m.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []
