import base64
import gzip
import hashlib

from sluice.llm import warc

SCHEMA = "page_id long, url string, html string"
V1 = b"filedesc://x 0.0.0.0 20000101000000 text/plain 70\n1 0 org\nURL IP-address Archive-date Content-type Archive-length\n\n" + b"." * 4 + b"\n"


def arc(version, records):
    about = f"{version} 0 org\n{' '.join(warc.ARC_FIELDS[version])}\n\n".encode()
    out = f"filedesc://x 0.0.0.0 20000101000000 text/plain {'200 - - 0 x ' if version == 2 else ''}{len(about)}\n".encode() + about + b"\n"
    for url, date, body in records:
        out += warc.arc_line(version, url, date, "text/html", len(body)).encode() + b"\n" + body + b"\n"
    return out


def test_both_versions_plain_and_zipped():
    records = [("http://a/1", "19991231235959", b"HTTP/1.0 200 OK\n\nhi\nhttp://b 0.0.0.0 20000101000000 text/html 3\n"), ("http://b/?q=1", "20000101", b""), ("dns:c", "200001011200", b"\x00\xff\n\n")]
    for version in (1, 2):
        data = arc(version, records)
        half = len(data) // 2
        for form in (data, gzip.compress(data), gzip.compress(data[:half]) + gzip.compress(data[half:])):
            got = list(warc.read_arc(form))
            assert [(r["url"], r["date"], r["block"]) for r in got] == records
            assert len({r["offset"] for r in got}) == 3
    assert warc.iso_date("19991231235959") == "1999-12-31T23:59:59Z"
    assert warc.iso_date("200013") == "2000-01-01T00:00:00Z"


def test_damage():
    data = arc(1, [("http://a/1", "19991231235959", b"x" * 50)])
    assert [len(r["block"]) for r in warc.read_arc(data[:-20])] == [31]
    assert [r["block"] for r in warc.read_arc(b"garbage line\n\n" + data)] == [b"x" * 50]
    assert list(warc.read_arc(b"")) == []


def test_latin1_survives_conversion(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256))
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(arc(2, [("http://a/1", "20200101000000", body), ("http://a/2", "20200101000000", body)])))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    found = [r for p in (tmp_path / "warc").glob("part*") for r in warc.read_warc(p.read_bytes())]
    kinds = sorted(f["warc-type"] for f, _ in found)
    assert kinds.count("response") == 1 and kinds.count("revisit") == 1
    (response,) = [(f, b) for f, b in found if f["warc-type"] == "response"]
    (revisit,) = [f for f, b in found if f["warc-type"] == "revisit"]
    assert response[1] == body and response[0]["warc-payload-digest"] == "sha1:" + warc.digest(bytes(range(256)))
    assert revisit["warc-refers-to"] == response[0]["warc-record-id"] and response[0]["warc-date"] == "2020-01-01T00:00:00Z"


def test_round_trip(spark, tmp_path):
    long = "<p>é WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20_000
    rows = [(k, f"http://h/ {k}\n", h) for k, h in enumerate(["a", None, "", "a", "b\r\n\r\n", long, "a", long, "\n", "c"])] + [(3, None, "a"), (None, None, "zz"), (9, "u", "c")]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as digest").write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.op2_warc(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    for h, ids in groups.items():
        d = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        got = [r for r in out if r.payload_digest == d]
        assert sorted(map(str, (r.page_id for r in got))) == sorted(map(str, ids))
        assert {r.payload_bytes for r in got} == {len(h.encode())}
        top = max((i for i in ids if i is not None), default=None)
        assert [(r.page_id, r.refers_to) for r in got if r.record_type == "response"] == [(top, None)]
        assert all(r.refers_to == top for r in got if r.record_type == "revisit")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op2_warc(spark, str(tmp_path)).count() == 0
