import io
import zlib

import duckdb
import pytest
from helpers import with_clashes

from cadence.llm import warc as w

PAGES = "page_id long, url string, html string"


def rows():
    return [(1, "http://a/x", "<p>one"), (2, "http://a/é\r\nX: y", "<p>one"), (9, None, "<p>one"), (3, "u", "zwei ü 日"), (4, "u", None), (5, "u", ""),
            (6, "u", "x" * 300_000), (None, "u", "<p>one"), (None, "u", "only without id"), (None, "u", "only without id"), (9, None, "<p>one"),
            (7, "u", "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n")]


def written(spark, tmp_path, data=None, **kwargs):
    folder = f"file://{tmp_path}/archives"
    df = with_clashes(spark.createDataFrame(rows() if data is None else data, PAGES).repartition(3))
    return w.write_archives(df, folder, **kwargs), folder


def test_round_trip(spark, tmp_path):
    archives, folder = written(spark, tmp_path, archive_bytes=500)  # several archives a task
    got = w.read_archives(archives, folder).collect()
    assert len(got) == len(rows()) and all(r["digest_ok"] for r in got) and archives.count() > 3
    keeper = {"<p>one": 9, "": 5}
    want = []
    for i, _, html in rows():
        raw = (html or "").encode()
        k = keeper.get(html or "")
        revisit = k is not None and i != k
        want.append((i, None if revisit else raw, len(raw), w.sha1_base32(raw), "revisit" if revisit else "response", k if revisit else None))
    have = [(r["page_id"], None if r["payload"] is None else bytes(r["payload"]), *(r[c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_small_payloads_are_all_responses(spark, tmp_path):
    archives, folder = written(spark, tmp_path, least=7)
    got = w.read_archives(archives, folder).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_sql_agrees(spark, tmp_path):
    data = [r for r in rows() if r[0] is not None][:-2]
    archives, folder = written(spark, tmp_path, data)
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")) for r in w.read_archives(archives, folder).collect()]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", data)
    assert sorted(con.sql(w.SQL).fetchall(), key=repr) == sorted(got, key=repr)


def test_empty_table(spark, tmp_path):
    archives, folder = written(spark, tmp_path, [])
    assert archives.count() == 0 and w.read_archives(archives, folder).count() == 0


def test_members_are_plain_gzip(spark, tmp_path):
    import gzip
    archives, _ = written(spark, tmp_path)
    for r in archives.collect():
        raw = gzip.open(r["path"]).read()
        assert raw.count(b"WARC-Type: re") == r["n_records"] and raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_damage_is_noticed():
    good = w.record(1, "u", b"payload", None, False)
    assert [b for _, b in w.records(io.BytesIO(good * 3))][2].endswith(b"payload")
    with pytest.raises(w.Damaged):
        list(w.records(io.BytesIO(good + good[:-9])))
    with pytest.raises(w.Damaged):
        list(w.records(io.BytesIO(good + b"garbage")))
    short = w.member({"WARC-Type": "response", "Content-Length": "3"}, b"four")
    with pytest.raises(w.Damaged):
        list(w.records(io.BytesIO(short)))
    raw = zlib.decompress(good, wbits=31).replace(b"payload", b"pAyload")
    z = zlib.compressobj(wbits=31)
    (head, block), = w.records(io.BytesIO(z.compress(raw) + z.flush()))
    assert w._row(head, block)[-1] is False
    for length in ("many", "-1", "", "\u0663"):
        odd = w.member({"WARC-Type": "response", "Content-Length": length}, b"x")
        with pytest.raises(w.Damaged):
            list(w.records(io.BytesIO(odd)))


def test_records_of_other_writers():
    """Digests are optional, may be of other kinds, and some write them in small letters."""
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    stated = {"none": {}, "md5": {"WARC-Block-Digest": "md5:00"}, "small": {"WARC-Payload-Digest": "sha1:" + w.sha1_base32(b"body").lower()},
              "wrong": {"WARC-Payload-Digest": "sha1:" + w.sha1_base32(b"other")}}
    for kind, ok in (("none", None), ("md5", None), ("small", True), ("wrong", False)):
        raw = w.member({"WARC-Type": "response", "Content-Length": str(len(block)), **stated[kind]}, block)
        (head, got), = w.records(io.BytesIO(raw))
        assert w._row(head, got) == (None, None, b"body", 4, w.sha1_base32(b"body"), "response", None, ok)
    raw = w.member({"WARC-Type": "revisit", "Content-Length": "0"}, b"")
    (head, got), = w.records(io.BytesIO(raw))
    assert w._row(head, got) == (None, None, None, None, None, "revisit", None, None)
