import base64
import gzip
import hashlib
import json
import zlib
from collections import Counter

import pytest

from driftline.llm import queries, warc

from .oracle import frame_rows, rows_of

SCHEMA = "page_id long, url string, html string"


def slow(rows, min_bytes=0):
    """(page_id, bytes, digest, role, refers_to) of each row."""
    groups, out = {}, []
    for i, (k, u, h) in enumerate(rows):
        groups.setdefault((h or "").encode(), []).append((k is None, k or 0, u or "", i))
    lead = {p: min(g) for p, g in groups.items()}
    for i, (k, _, h) in enumerate(rows):
        p = (h or "").encode()
        first = lead[p]
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        response = len(p) < min_bytes or first[3] == i
        out.append((k, len(p), digest, "response" if response else "revisit", None if response or first[0] else first[1]))
    return Counter(out)


ROWS = [
    (3, "http://a/3", "<p>same é</p>"), (1, "http://a/1", "<p>same é</p>"), (2, None, "<p>same é</p>"), (7, "http://b\r\nX: y", None), (6, "u", ""),
    (9, "http://c", "<p>alone</p>"), (1, "http://a/1", "<p>same é</p>"), (None, "n", "<p>same é</p>"), (None, "m", "keyless"), (None, "n", "keyless"),
    (20, "twice", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (20, "twice", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (30, "long", "x y " * 1_000_000),
]


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_round_trip(spark, tmp_path, monkeypatch, min_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    frame = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA + ", record_type string").repartition(3)
    index, folder = warc.archive_pages(frame, min_bytes, str(tmp_path / "w"))
    got = Counter(map(tuple, warc.digests(index, folder).collect()))
    assert got == slow(ROWS, min_bytes)
    full = warc.read_records(index, folder).filter("record_type = 'response'").collect()
    assert Counter(bytes(r.payload).decode() for r in full) == Counter(
        {h or "": 1 if len((h or "").encode()) >= min_bytes else sum((x or "") == (h or "") for *_, x in ROWS) for *_, h in ROWS}
    )


def test_files_are_members_with_a_sidecar_index(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    index, folder = warc.archive_pages(frame, folder=str(tmp_path / "w"))
    rows = index.collect()
    assert len(rows) == len(ROWS)
    for name in {r.archive for r in rows}:
        whole = (tmp_path / "w" / "whole" / name).read_bytes()
        data = (tmp_path / "w" / "members" / name).read_bytes()
        engine = zlib.decompressobj(31)
        assert engine.decompress(whole) == gzip.decompress(data) and engine.eof and not engine.unused_data
        lines = [json.loads(x) for x in (tmp_path / "w" / "members" / f"{name}.idx").read_text().splitlines()]
        mine = sorted((r.offset, r.size) for r in rows if r.archive == name)
        assert [(x["offset"], x["size"]) for x in lines] == mine
        assert [a + n for a, n in mine] == [*[a for a, _ in mine[1:]], len(data)]
        for a, n in mine:
            assert gzip.decompress(data[a : a + n]).startswith(b"WARC/1.1\r\n")
    assert not [p for p in (tmp_path / "w").rglob("*") if p.suffix not in (".gz", ".idx", "") and not p.name.endswith(".crc")]


def test_streams_in_small_pieces():
    raw = b"".join(warc.record("response", str(i), "u", b"p" * i, "D", None, "d") for i in range(40))
    one = gzip.compress(raw)
    two = gzip.compress(raw[:1000]) + b"\0" * 5 + gzip.compress(raw[1000:])
    for data in (one, two):
        for n in (1, 7, len(data)):
            chunks = (data[i : i + n] for i in range(0, len(data), n))
            assert [len(b) - len(warc.HTTP_HEAD) for _, _, b in warc.split_records(warc.inflate(chunks))] == list(range(40))
    with pytest.raises(EOFError):
        list(warc.split_records(warc.inflate(iter([one[:-20]]))))


def test_empty_table(spark, tmp_path):
    index, folder = warc.archive_pages(spark.createDataFrame([], SCHEMA), folder=str(tmp_path / "w"))
    assert warc.digests(index, folder).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    frame = queries.op2_warc_members(spark, d)
    assert Counter(tuple(r) for r in frame.collect()) == slow(rows)
    assert frame_rows(frame) == rows_of(queries.ORACLE_SQL["op2_warc_members"], d)
