"""Operator 12: WARC archives and their transactions.

Writing: every page becomes three records of one capture, a request, a response (or a revisit) and a metadata record, the
first and the last pointing at the middle one through ``WARC-Concurrent-To``. Records are text rows that end in the
format's own ``CRLF CRLF``, so Spark's text sink writes the archives (gzip, WARC 1.1) on any file system, commits them per
task and redoes lost ones. Of the pages with one payload, the one with the smallest id is the response and the others
revisit it (``WARC-Refers-To``); the decision is one aggregate over digests, folded per task.

Reading: archives are scanned as lines (gzip files aren't split, so a task sees a file in order, streamed), and a parser
puts records together by ``Content-Length`` in bounded memory, whatever the payload holds. Transaction assembly then joins
request, response and metadata records through the concurrent-to identifiers, in either direction and also from metadata
to request to response, and emits one nested row per capture.

Rows: a null or missing payload is empty; a null url is left out of the headers; the exact id and url travel as JSON in
the metadata record. A null id comes last in the order of ids. Repeated rows are captures of their own; of rows with one
id and one payload any may be the response, which doesn't show in the result. A very long payload is one record, held
whole by one task. Extra columns are ignored. An empty table gives archives without records and no rows.

Archives are gzip files of one member each; the reader takes any member layout and refuses files that Spark splits.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ecospark.llm.tables import column, lookup, stored

END = "\r\n\r\n"
#: bytes of records in an Arrow batch of the parser
BATCH_BYTES = 8_000_000

RECORD = ("file string, record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
          "declared_digest string, http_head string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string")


# ---------------------------------------------------------------- writing


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of ``data``: five hexadecimal digits at a time are four base-32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    # fixed values: the digits of base 32 and the alphabet of RFC 4648
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decide(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0) -> DataFrame:
    """(row, id, url, payload, digest, first): the pages as a written table with a row number; ``first`` is the row of the
    response that this one revisits, null for responses. Payloads under ``at_least`` bytes are always responses."""
    body = F.coalesce(column(pages, payload, "string").cast("binary"), F.lit(b""))
    rows = stored(pages.select(column(pages, id, "long").alias("id"), column(pages, url, "string").alias("url"), body.alias("payload"))
                  .select(F.monotonically_increasing_id().alias("row"), "id", "url", "payload", base32_sha1(F.col("payload")).alias("digest"),
                          F.unhex(F.sha2("payload", 256)).alias("same")))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    firsts = rows.filter(F.octet_length("payload") >= at_least).groupBy("same").agg(F.min(order)["row"].alias("first"), F.count(F.lit(1)).alias("rows"))
    out = lookup(rows, stored(firsts.filter("rows > 1")), "same", "rows")
    later = (F.octet_length("payload") >= at_least) & (F.col("first") != F.col("row"))
    return out.select("row", "id", "url", "payload", "digest", F.when(later, F.col("first")).alias("first"))


def _record(kind: Column | str, record_id: Column, date: str, block: Column, content_type: str, *headers: Column) -> Column:
    """One record without its closing CRLFs; headers that are null are left out."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), line("WARC-Type", kind), line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(date)),
                       *headers, line("Content-Type", F.lit(content_type)), line("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(END), block.cast("string"))


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0,
                   per_file: int = 300_000) -> None:
    """Write the pages as WARC archives (gzip) under ``path``, three records a page, ``per_file`` records in a file at most."""
    rows = decide(pages, id, url, payload, at_least)
    run, date = uuid.uuid4().hex, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def name(kind: str, row: Column) -> Column:
        h = F.md5(F.concat_ws("-", F.lit(run), F.lit(kind), row.cast("string")))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))

    row, first = F.col("row"), F.col("first")
    response, revisit = name("response", row), first.isNotNull()
    safe = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    to = F.concat(F.lit("WARC-Target-URI: "), safe)
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response)
    host = F.regexp_extract(F.coalesce(safe, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    ask = F.concat(F.lit("GET "), F.coalesce(safe, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                      F.octet_length("payload").cast("string"), F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    records = F.array(
        _record("request", name("request", row), date, ask, "application/http;msgtype=request", to, concurrent),
        _record(F.when(revisit, "revisit").otherwise("response"), response, date, answer, "application/http;msgtype=response", to,
                F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
                F.concat(F.lit("WARC-Refers-To: "), name("response", first)),
                F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _record("metadata", name("metadata", row), date, F.concat(F.lit("page: "), F.to_json(F.struct("id", "url")), F.lit("\r\n")),
                "application/warc-fields", to, concurrent))
    info = _record("warcinfo", name("warcinfo", row), date, F.lit("format: WARC File Format 1.1\r\nsoftware: ecospark\r\n"), "application/warc-fields")
    begins = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # a task's first row opens its file
    lines = rows.select(F.explode(F.when(begins, F.concat(F.array(info), records)).otherwise(records)).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


# ---------------------------------------------------------------- reading


def _headers(head: bytes) -> list[tuple[str, str]]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:  # a folded line goes on
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def parse_record(file: str, head: bytes, block: bytes) -> dict:
    """A record as a row of ``RECORD``."""
    pairs = _headers(head)
    get = dict(reversed(pairs)).get  # the first of repeated headers
    kind = (get("content-type") or "").lower()
    http = kind.startswith("application/http")
    cut = block.find(b"\r\n\r\n") if http else -1
    body = block[cut + 4 :] if cut >= 0 else b"" if http else block
    fields = _headers(block) if kind.startswith("application/warc-fields") else None
    digest = get("warc-payload-digest")
    return {
        "file": file, "record_id": get("warc-record-id"), "type": get("warc-type"), "target_uri": get("warc-target-uri"), "date": get("warc-date"),
        "concurrent_to": [v for n, v in pairs if n == "warc-concurrent-to"], "refers_to": get("warc-refers-to"),
        "declared_digest": digest.rpartition(":")[2] if digest else None,
        "http_head": (block[:cut] if cut >= 0 else block).decode("utf-8", "replace") if http else None,
        "fields": list(dict(reversed(fields)).items()) if fields is not None else None, "payload": body, "payload_bytes": len(body),
        "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode()}


def split_records(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes, bytes]]:
    """(file, header, block) of the records in (file, bytes) chunks that come in order; what is held is one record and a chunk."""
    file, held, have, need = "", [], 0, 1
    for at, chunk in chunks:
        if at != file:
            if b"".join(held).strip():
                raise ValueError(f"truncated record at the end of {file}")
            file, held, have, need = at, [], 0, 1
        held.append(chunk)
        have += len(chunk)
        if have < need:
            continue
        data, pos, need = b"".join(held), 0, 0
        while not need:
            while data[pos : pos + 1] in (b"\r", b"\n"):
                pos += 1
            end = data.find(b"\r\n\r\n", pos)
            if data[pos : pos + 5] != b"WARC/"[: len(data) - pos]:
                raise ValueError(f"no WARC record in {file} after {data[max(0, pos - 20) : pos]!r}")
            if end < 0:
                need = len(data) - pos + 1
                break
            head = data[pos:end]
            size = next((int(v) for n, v in _headers(head) if n == "content-length"), None)
            if size is None:
                raise ValueError(f"record without Content-Length in {file}: {head[:200]!r}")
            if end + 4 + size > len(data):
                need = end + 4 + size - pos
                break
            yield file, head, data[end + 4 : end + 4 + size]
            pos = end + 4 + size
        held, have = [data[pos:]], len(data) - pos
    if b"".join(held).strip():
        raise ValueError(f"truncated record at the end of {file}")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        files, starts, lines = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        if any(starts):
            raise ValueError("an archive was split; WARC files must be gzip-compressed to be read in order")
        runs = pa.compute.run_end_encode(files)
        begin = 0
        for end, file in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            yield file, b"\n".join(lines[begin:end]) + b"\n"
            begin = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the gzip-compressed WARC archives under ``path``, one row of ``RECORD`` each."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file, head, block in split_records(_chunks(batches)):
            rows.append(parse_record(file, head, block))
            size += len(block) + 500
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return lines.mapInArrow(records, RECORD)


# ---------------------------------------------------------------- transactions


def captures(records: DataFrame, keep: tuple[str, ...] = ("payload",)) -> DataFrame:
    """One nested row per response or revisit record: (capture_id, target_uri, date, response, request, metadata).

    A request or metadata record belongs to the capture that its concurrent-to names or whose concurrent-to names it; a
    metadata record may also name the request. Of several candidates the one with the smallest record id is taken; a
    capture without one has null there. ``keep`` lists heavy columns of the response to carry along (``payload``).
    ``records`` is read once per kind and link, so it should be a written table where archives are large."""
    side = lambda kind: records.filter(F.col("type") == kind)
    answers = records.filter(F.col("type").isin("response", "revisit"))
    named = answers.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("member"))
    ids = answers.select(F.col("record_id").alias("target"), F.col("record_id").alias("capture_id")).distinct()
    light = ["record_id", "http_head", "fields"]

    def members(kind: str, targets: DataFrame) -> DataFrame:
        """The first record of a kind per capture."""
        all_ = side(kind)
        out = all_.select(F.explode("concurrent_to").alias("target"), F.struct(*light).alias("x")).join(targets, "target").select("capture_id", "x")
        back = all_.select(F.col("record_id").alias("member"), F.struct(*light).alias("x")).join(named, "member").select("capture_id", "x")
        one = out.unionByName(back).groupBy("capture_id").agg(F.min_by("x", F.col("x.record_id")).alias("x"))  # folded per task
        return one

    requests = members("request", ids)
    through = requests.select(F.col("x.record_id").alias("target"), "capture_id")
    metadata = members("metadata", ids.unionByName(through))
    response = F.struct("record_id", "type", "refers_to", "declared_digest", "http_head", "payload_bytes", "payload_digest", *keep).alias("response")
    out = answers.select(F.col("record_id").alias("capture_id"), "target_uri", "date", response)
    out = out.join(requests.select("capture_id", F.struct("x.record_id", "x.http_head").alias("request")), "capture_id", "left")
    return out.join(metadata.select("capture_id", F.struct("x.record_id", "x.fields").alias("metadata")), "capture_id", "left")


def page_rows(found: DataFrame) -> DataFrame:
    """Per capture of :func:`captures`: page_id, url, payload_bytes, payload_digest (of the full payload, a revisit's through the
    response it refers to), record_type, refers_to (that response's page_id)."""
    page = F.from_json(F.element_at(F.col("metadata.fields"), F.lit("page")), "id long, url string")
    slim = stored(found.select("capture_id", page.alias("page"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("ref"),
                               F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("own_digest")))
    used = slim.filter("record_type = 'revisit' AND ref IS NOT NULL").groupBy("ref").agg(F.count(F.lit(1)).alias("rows"))
    whole = slim.filter("record_type = 'response'").select(F.col("capture_id").alias("ref"), F.col("page.id").alias("to"), F.col("own_bytes").alias("full_bytes"),
                                                            F.col("own_digest").alias("full_digest"))
    out = lookup(slim, stored(used.join(whole, "ref")), "ref", "rows")
    own = F.col("record_type") == "response"
    return out.select(F.col("page.id").alias("page_id"), F.col("page.url").alias("url"), F.when(own, F.col("own_bytes")).otherwise(F.col("full_bytes")).alias("payload_bytes"),
                      F.when(own, F.col("own_digest")).otherwise(F.col("full_digest")).alias("payload_digest"), "record_type",
                      F.when(~own, F.col("to")).alias("refers_to"))
