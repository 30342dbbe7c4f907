"""Operator 12: archives written and read back, and transactions of foreign archives."""

import base64
import gzip
import hashlib
import os

import pytest

from ecospark.llm import warc

SCHEMA = "page_id long, url string, html string, type string, ref string, rows long"
LONG = "".join(f"<p>line {i}</p>\r\n\r\nWARC/1.1\r\n" for i in range(60_000))


def pages():
    body = "<html>é 日本\r\n\r\nx\n</html>"
    rows = [(5, "http://a.org/x?y=1", body), (3, "https://b.org", body), (9, None, body), (None, "http://n.org", body), (None, None, None),
            (4, "", ""), (2, "bad url\r\nInjected: 1", None), (7, "http://l.org/", LONG), (8, "http://l.org/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
            (6, "u", "unique\n"), (6, "u", "unique\n"), (6, "v", "other"), (1, "http://ü.org/ü", "unique"), (None, "z", "null id only"), (None, "z", "null id only")]
    return [(*r, "t", "r", 1) for r in rows]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def want(rows, at_least=0):
    by = {}
    for r in rows:
        by.setdefault(r[2] or "", []).append(r[0])
    out = []
    for text, ids in by.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = k and len(text.encode()) >= at_least
            out.append((i, len(text.encode()), sha(text), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def result(spark, df, path, at_least=0):
    warc.write_archives(df, path, at_least=at_least, per_file=10)
    out = warc.page_rows(warc.captures(warc.read_archives(spark, path), keep=()))
    return sorted((tuple(r)[:1] + tuple(r)[2:] for r in out.collect()), key=str), out


@pytest.mark.parametrize("at_least", [0, 7])
def test_round_trip(spark, tmp_dir, at_least):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, out = result(spark, df, f"{tmp_dir}/a", at_least)
    assert got == want(rows, at_least)
    assert sorted((str(r["page_id"]), str(r["url"])) for r in out.collect()) == sorted((str(r[0]), str(r[1])) for r in rows)


def test_captures_hold_request_response_and_metadata(spark, tmp_dir):
    rows = pages()
    path = f"{tmp_dir}/a"
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path)
    found = warc.captures(warc.read_archives(spark, path)).collect()
    assert len(found) == len(rows) and len({r["capture_id"] for r in found}) == len(rows)
    bodies = sorted(bytes(r["response"]["payload"]) for r in found if r["response"]["type"] == "response")
    assert bodies == sorted({(r[2] or "").encode() for r in rows})
    for r in found:
        assert r["request"]["http_head"].startswith("GET ") and "\nInjected" not in r["request"]["http_head"]
        assert r["metadata"]["fields"]["page"].startswith("{") and "200 OK" in r["response"]["http_head"]
        assert r["response"]["type"] == "revisit" or r["response"]["declared_digest"] == r["response"]["payload_digest"]
    named = {r["capture_id"]: r for r in found}
    for r in found:
        if r["response"]["type"] == "revisit":
            assert named[r["response"]["refers_to"]]["response"]["payload_digest"] == r["response"]["declared_digest"]


def record(kind, id, block, *more, content="application/http"):
    head = [f"WARC/1.0\r\nWARC-Type: {kind}", f"WARC-Record-ID: {id}", *more, f"content-type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_dir):
    """A member per record, folded and repeated headers, links in either direction, records without partners."""
    records = [
        record("request", "<q1>", b"GET /1 HTTP/1.1\r\n\r\n"), record("response", "<r1>", b"HTTP/1.1 200\r\n\r\n\xff\xfe\x00binary", "WARC-Concurrent-To: <q1>", "WARC-Target-URI: u:1\r\n  folded"),
        record("metadata", "<m1>", b"a: 1\r\na: 2\r\n", "WARC-Concurrent-To: <q1>", content="application/warc-fields"),
        record("response", "<r2>", b"HTTP/1.1 404 no body"), record("metadata", "<m9>", b"x: y", "WARC-Concurrent-To: <r2>", "WARC-Concurrent-To: <gone>", content="application/warc-fields"),
        record("metadata", "<m3>", b"x: z", "WARC-Concurrent-To: <r2>", content="application/warc-fields"),
        record("request", "<q5>", b"GET /orphan", "WARC-Concurrent-To: <gone>"), record("resource", "<s1>", b"", content="text/plain"), record("revisit", "<v1>", b"", "WARC-Refers-To: <gone>")]
    os.makedirs(f"{tmp_dir}/w")
    with open(f"{tmp_dir}/w/x.warc.gz", "wb") as f:
        for r in records:
            f.write(gzip.compress(r))
    open(f"{tmp_dir}/w/empty.warc.gz", "wb").write(gzip.compress(b""))
    all_ = warc.read_archives(spark, f"{tmp_dir}/w")
    assert sorted(r["record_id"] for r in all_.collect()) == sorted(["<q1>", "<r1>", "<m1>", "<r2>", "<m9>", "<m3>", "<q5>", "<s1>", "<v1>"])
    got = {r["capture_id"]: r for r in warc.captures(all_).collect()}
    assert set(got) == {"<r1>", "<r2>", "<v1>"}
    assert got["<r1>"]["request"]["record_id"] == "<q1>" and got["<r1>"]["metadata"]["fields"] == {"a": "1"} and got["<r1>"]["target_uri"] == "u:1 folded"
    assert bytes(got["<r1>"]["response"]["payload"]) == b"\xff\xfe\x00binary" and got["<r2>"]["response"]["payload_bytes"] == 0
    assert got["<r2>"]["request"] is None and got["<r2>"]["metadata"]["record_id"] == "<m3>"
    lost = {r["record_type"]: r for r in warc.page_rows(warc.captures(all_, keep=())).collect() if r["record_type"] == "revisit"}
    assert lost["revisit"]["payload_bytes"] is None and lost["revisit"]["refers_to"] is None


def test_parser_across_chunks_and_bad_files():
    data = record("response", "<a>", b"HTTP/1.1 200\r\n\r\n" + b"x" * 50) + record("resource", "<b>", b"", content="t") + record("resource", "<c>", b"\r\n\r\nWARC/1.0", content="t")
    for step in (1, 3, 7, 64, 10_000):
        chunks = [("f", data[i : i + step]) for i in range(0, len(data), step)] + [("g", data)]
        got = [(f, warc.parse_record(f, h, b)["record_id"], len(b)) for f, h, b in warc.split_records(iter(chunks))]
        assert got == [(f, i, n) for f in "fg" for i, n in (("<a>", 66), ("<b>", 0), ("<c>", 12))]
    for bad in (data[:-30], b"no archive at all\r\n\r\n", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.split_records(iter([("f", bad)])))


def test_empty_table(spark, tmp_dir):
    got, out = result(spark, spark.createDataFrame([], SCHEMA), f"{tmp_dir}/a")
    assert got == [] and out.columns == ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
