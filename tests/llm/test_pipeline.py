import numpy as np
from helpers import DOCS, corpus, edge_rows, with_clashes, words
from test_jaccard_join import brute
from test_packing import check

import corpus_pipeline as c

LABELS = "doc_id long, quality int, toxic int"


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage on what its predecessor kept, with nulls and repeated rows in."""
    rng = np.random.default_rng(9)
    rows = [r for r in corpus() if len(r[1] or "") < 20_000] + [(900 + k, words(rng, 40) + (" idiot moron " if k % 4 == 0 else ""), "en", "s1", 0) for k in range(24)]
    spark.createDataFrame([(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    clean = c.toxicity(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    want = [r for r in rows if "idiot" not in (r[1] or "")]
    assert sorted((tuple(r) for r in clean.collect()), key=repr) == sorted(want, key=repr)
    one = c.near_duplicates(spark, clean, str(tmp_path))
    left = {k for _, k, _ in brute(want)}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(left) and one.columns == docs.columns
    mixed = c.mixing(spark, one, str(tmp_path))
    taken = [tuple(r) for r in mixed.collect()]
    assert mixed.columns == docs.columns and {r[0] for r in taken} <= left
    size = lambda t: len((t or "").encode().split())
    total = sum(size(r[1]) for r in want if r[0] in left)
    assert abs(sum(size(r[1]) for r in taken) - total) <= 0.1 * total
    packed = c.packing(spark, spark.createDataFrame(taken, DOCS), str(tmp_path)).collect()
    check(taken, packed, 1024)


def test_another_text_of_an_id_stays(spark, tmp_path):
    """The id of a near copy that goes may name a text of its own, which stays; likewise texts of one id."""
    a, b = (words(np.random.default_rng(i), 60) for i in (1, 2))
    rows = [(1, a, "en", "s", 1), (2, a + " more", "en", "s", 2), (2, b, "en", "s", 3), (3, "", "en", "s", 0), (3, "", "en", "s", 0),
            (3, None, "en", "s", 0), (4, b + "  ", "en", "s", 4), (5, b, "de", "t", 5), (6, a[::-1], "en", "s", 6), (6, a[::-1] + "\n", "fr", "s", 6),
            (None, a, "en", "s", 1), (None, a, "en", "s", 1), (2, b, "en", "r", 9)]
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    out = c.near_duplicates(spark, docs, str(tmp_path))
    got = sorted(((r["doc_id"], r["text"], r["source"]) for r in out.collect()), key=repr)
    assert out.columns == docs.columns
    one = [g for g in got if g[0] == 6]
    assert len(one) == 1 and one[0][1].strip() == a[::-1].strip()
    assert [g for g in got if g[0] != 6] == sorted([(1, a, "s"), (2, b, "r"), (3, "", "s"), (3, None, "s"), (None, a, "s"), (None, a, "s")], key=repr)


def test_run(spark, tmp_path):
    for name, rows in (("a", edge_rows()), ("b", [])):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = c.run(spark, f"{tmp_path}/{name}")
        assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert (out.count() > 0) == bool(rows)


def test_registered():
    import __spark_entry__ as e
    names = list(e.queries())
    assert [n for n in names if n.startswith("op") and n[2].isdigit()] == [
        "op1_url_filter", "op2_embedding_dedup", "op3_fingerprints", "op4_html_text", "op5_toxicity", "op6_mixing", "op7_warc",
        "op8_packing", "op9_token_counts", "op10_jaccard_join", "op11_fill_in_middle", "op12_suffix_dedup", "op13_merkle_manifest"] and "pipeline" in names
    assert 4 <= len(c.STAGES) <= 5
    assert {k for k in e.oracle_sql() if k in names and k.startswith("op") and k[2].isdigit()} == {
        "op1_url_filter", "op7_warc", "op11_fill_in_middle", "op13_merkle_manifest"}
    assert all(isinstance(v, str) for v in e.oracle_sql().values())
