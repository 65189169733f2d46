import gzip
import hashlib

import pytest

from saltmarsh.llm.common import Scratch
from saltmarsh.llm.warc import assemble, captured_payloads, read_records, write_captures

BIG, MARK = "x" * 200, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nfoo" * 9
ROWS = [
    (1, "http://a/b", None), (2, "http://a/ü\r\nX: y", ""), (3, None, BIG), (4, "http://c?x=1", BIG), (4, "http://c?x=1", BIG),
    (5, "u", "short"), (6, "u", "short"), (7, "u", MARK), (8, "u", MARK), (9, "u", "\r\n\r\n"), (None, "n", BIG), (None, "n", "zz" * 90),
    (10, "é", "é€" * 100), (11, "q", "\r\n" * 70), (3, None, BIG), (12, "t", "x\r\n\r\n" * 50), (13, "t", "WARC/1.1\r\n" * 20),
    (14, "t", "\r\nWARC/1.1\r\n" * 20), (15, "t", "\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r"),
]


def expected(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        revisit = len(payload) >= 100 and bool(same) and page != min(same)
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response",
                    min(same) if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string")


def test_archives_read_back(pages):
    assert sorted(map(tuple, captured_payloads(pages).collect()), key=str) == expected(ROWS)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, captured_payloads(pages).collect()), key=str) == expected(rows)


def test_records_and_transactions(spark, pages):
    folder = f"{Scratch(spark, 'warc-test').folder}/archive"
    write_captures(pages.where("page_id in (1, 5, 7)"), folder)
    records = read_records(spark, folder)
    assert records.count() == 9 and records.where("not complete").count() == 0
    rows = {r.response.target_uri + str(r.metadata.block.decode()): r for r in assemble(records).collect()}
    assert len(rows) == 3
    one = rows["http://a/bpage-id: 1\r\n"]
    assert one.request.block == b"GET /b HTTP/1.1\r\nHost: a\r\n\r\n" and one.response.payload == b""
    assert rows["upage-id: 7\r\n"].response.payload == MARK.encode()


def test_a_capture_without_its_request_stays(spark, pages):
    folder = f"{Scratch(spark, 'warc-test').folder}/archive"
    write_captures(pages.where("page_id in (1, 5)"), folder)
    rows = assemble(read_records(spark, folder).where("type <> 'request'")).collect()
    assert len(rows) == 2 and all(r.request is None and r.metadata is not None for r in rows)


def test_extra_columns_and_empty_table(spark, pages):
    more = pages.selectExpr("*", "1 as digest", "2 as value", "'x' as body")
    assert sorted(map(tuple, captured_payloads(more).collect()), key=str) == expected(ROWS)
    assert captured_payloads(pages.limit(0)).count() == 0


def test_one_payload_with_a_third_of_all_pages(spark):
    rows = [(i, f"http://h/{i}", "same " * 40 if i % 3 == 0 else f"page {i} " * 20) for i in range(300)]
    got = captured_payloads(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def foreign(version, kind, name, block, more="", stated=None):
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}Content-Length: {len(block) if stated is None else stated}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("version", ["1.0", "1.1"])
@pytest.mark.parametrize("gzipped", ["members", "one", None])
def test_foreign_archives_by_stated_length(spark, tmp_path, version, gzipped):
    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n"
    inside = foreign("1.0", "response", "inner", b"not a record of this archive")
    blocks = [b"software: x\r\n", http + b"body \xff\xfe", http + inside * 3, http + b"a\r\n\r\nWARC/1.0\r\nb\r\n\r\nWARC/1.", b"", http + b"last"]
    records = [foreign(version, "warcinfo" if i == 0 else "response", f"r{i}", b) for i, b in enumerate(blocks)]
    for copy in ("a", "b"):
        if gzipped is None:
            (tmp_path / f"{copy}.warc").write_bytes(b"".join(records))
        else:
            parts = records if gzipped == "members" else [b"".join(records)]
            (tmp_path / f"{copy}.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = read_records(spark, str(tmp_path)).collect()
    assert len(got) == 12 and all(r.complete for r in got)
    for i, block in enumerate(blocks):
        for r in (r for r in got if r.record_id == f"<r{i}>"):
            assert bytes(r.block) == block
            assert r.payload is None if i == 0 else bytes(r.payload) == block.partition(b"\r\n\r\n")[2]


def test_an_archive_cut_off(spark, tmp_path):
    records = [foreign("1.0", "metadata", "a", b"one"), foreign("1.0", "metadata", "b", b"two", stated=4000), foreign("1.1", "metadata", "c", b"three")]
    (tmp_path / "x.warc").write_bytes(b"".join(records)[:-2])
    got = {r.record_id: (bytes(r.block), r.complete) for r in read_records(spark, str(tmp_path)).collect()}
    assert got["<a>"] == (b"one", True) and got["<b>"] == (b"two", False) and got["<c>"][0] == b"three"
