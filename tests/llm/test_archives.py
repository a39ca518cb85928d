import base64
import gzip
import hashlib
import uuid

import pytest

from findmill.llm import arc_convert as W

SF = "/root/testdata/sf0.001"


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    payloads = {i: (html or "").encode() for i, html in rows}
    last = {}
    for i, payload in payloads.items():
        last[payload] = max(i, last.get(payload, i))
    return {
        i: (
            len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
            *(("response", None) if last[p] == i else ("revisit", last[p])),
        )
        for i, p in payloads.items()
    }


def as_dict(df) -> dict[int, tuple]:
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    found = W.op4_warc(spark, SF)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert as_dict(found) == brute(pages)


def test_odd_payloads(spark):
    rows = [
        (1, None), (2, ""), (3, "same"), (4, "same"), (5, "a\r\n\r\nb\n"), (6, "WARC/1.1\r\n\r\n"), (7, "é\x00\n\n"),
        (8, "HTTP/1.1 200 OK\r\n\r\n"), (9, "x" * 300_000), (10, "x" * 300_000), (11, "\n"),
    ]
    df = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i} a\nb", h, 0) for i, h in rows], "page_id long, url string, html string, record int")
    assert as_dict(W.convert_pages(df)) == brute(rows)
    assert W.convert_pages(df.limit(0)).count() == 0


def test_repeated_rows_are_records_of_their_own(spark):
    df = spark.createDataFrame([(1, "u", "p"), (1, "u", "p")], "page_id long, url string, html string")
    assert sorted(r.record_type for r in W.convert_pages(df).collect()) == ["response", "revisit"]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_of_both_versions(version):
    http = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody\n\n"
    data = W.arc_start(version, b"a.arc", b"20010203040506")
    data += W.arc_header(version, b"http://h/a b", b"20010203040506", b"text/html", len(http)) + http + b"\n"
    data += b"dns:h 0.0.0.0 20010203040507 text/dns" + (b" 200 - - 0 -" if version == 2 else b"") + b" 5\nh A 1\n"
    records = list(W.parse_arc(data))
    assert [r[2] for r in records[1:]] == [http, b"h A 1"]
    assert records[1][1]["URL"] == b"http://h/a%20b"
    assert records[1][1]["Archive-date"] == b"20010203040506"
    assert ("Result-code" in records[1][1]) == (version == 2)
    made = list(W.parse_warc(W.convert_arc("p", data, {})))
    assert [f["warc-type"] for f, _ in made] == ["warcinfo", "response", "resource"]
    assert made[1][0]["warc-date"] == "2001-02-03T04:05:06Z"
    assert made[1][1] == http
    assert made[1][0]["warc-payload-digest"] == "sha1:" + W.digest_of(b"body\n\n")
    assert made[1][0]["warc-block-digest"] == "sha1:" + W.digest_of(http)
    uuid.UUID(made[1][0]["warc-record-id"].removeprefix("<urn:uuid:").removesuffix(">"))
    assert len({f["warc-record-id"] for f, _ in made}) == 3


def test_urls_with_spaces_count_fields_from_the_right():
    data = W.arc_start(1, b"a", b"2001") + b"http://h/a b c 1.2.3.4 20010101000000 text/html 2\nhi\n"
    (_, _, _), (_, header, block) = W.parse_arc(data)
    assert (header["URL"], header["IP-address"], block) == (b"http://h/a%20b%20c", b"1.2.3.4", b"hi")


def test_cut_archives_are_errors():
    data = W.arc_start(1, b"a", b"2001") + b"http://h/ 0.0.0.0 2001 text/html 20\nhi\n"
    with pytest.raises(ValueError, match="declares 20 bytes"):
        list(W.parse_arc(data))
    with pytest.raises(ValueError):
        list(W.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nhi"))


def test_files_are_archives_that_others_can_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 3}") for i in range(30)], "page_id long, url string, html string")
    arc, warc = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    W.write_arc(pages, arc, "page_id", "url", "html", archive_bytes=20)
    W.arc_to_warc(W.archives(spark, arc), warc)
    files = sorted((tmp_path / "warc").glob("*.gz"))
    assert len(files) > 3
    for f in files:
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    again = [r for r in W.read_warc(W.archives(spark, warc)).collect() if r.type == "revisit"]
    assert len(again) == 27
    targets = {r.record for r in W.read_warc(W.archives(spark, warc)).collect() if r.type == "response"}
    assert {r.refers_record for r in again} == targets


def test_rows_without_payload_fill_archives_too(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://h/", None) for i in range(80)], "page_id long, url string, html string").coalesce(1)
    W.write_arc(pages, f"file://{tmp_path}/arc", "page_id", "url", "html", archive_bytes=2000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "arc").glob("*.gz")]
    assert len(sizes) > 3 and max(sizes) < 2600
