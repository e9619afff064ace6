"""WARC archives: writing captures, reading records, assembling transactions.

Each page becomes three records: a request, a response (or a revisit of the response that has
the same payload) and a metadata record; request and metadata name the capture's record in
WARC-Concurrent-To.  Archives are written by Spark as gzipped text with the record
terminator CR LF CR LF between rows, which is exactly the WARC layout, so any file system
Spark knows will do and every task writes its own file.

Reading streams each archive through one task with a buffer of one record, by Content-Length.
Transactions are assembled by grouping on the capture's record id: one nested row a capture,
with digest and length of the payload that was really read; a revisit takes them from the
response it refers to.

Defined cases: null html is an empty payload, null urls an empty target; of equal payloads of
``min_bytes`` or more the row with the largest page_id (null ids count as smallest, among equal
ids any one row) is the response; repeated rows are captures of their own; other columns are
ignored; an empty table writes and reads nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import durable, stage_root
from tidemark.llm.tables import picked, table

END = b"\r\n\r\n"
PAGE = "row long, page_id long, url string, html string"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, page_id long, target_uri string, "
    "payload_digest string, payload_bytes long, status string, method string, payload string"
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row: int, digest_: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row}/{digest_}/{kind}')}>"


def digests(batches):
    for batch in batches:
        out = [((x or "").encode()) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row", "page_id", "url", "html")), pa.array([digest(x) for x in out], pa.string()), pa.array([len(x) for x in out], pa.int64())],
            ["row", "page_id", "url", "html", "digest", "n_bytes"],
        )


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines) + block.decode()


def uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def records(batches):
    """The text of the three records of each capture."""
    names = ("row", "page_id", "url", "html", "digest", "n_bytes", "first_row", "first_digest")
    for batch in batches:
        out = []
        for row, page, url, html, dig, n, first, first_digest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            rid = record_id(row, dig, "capture")
            target = [("WARC-Target-URI", uri(url))]
            about = [("WARC-Concurrent-To", rid), *target]
            host = re.sub(r"^[a-z]+://|[/?#].*$", "", uri(url), flags=re.I)
            ask = f"GET {uri(url)} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
            sums = [("WARC-Payload-Digest", f"sha1:{dig}")]
            out.append(_record("request", record_id(row, dig, "request"), [*about, ("Content-Type", "application/http; msgtype=request")], ask))
            kind = [("Content-Type", "application/http; msgtype=response")]
            if first is None or first == row:
                out.append(_record("response", rid, [*target, *sums, *kind], http + (html or "").encode()))
            else:
                to = [("WARC-Refers-To", record_id(first, first_digest, "capture")), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                out.append(_record("revisit", rid, [*target, *sums, *to, *kind], http))
            note = f"page-id: {'' if page is None else page}\r\nfetched-bytes: {n}\r\n".encode()
            out.append(_record("metadata", record_id(row, dig, "metadata"), [*about, ("Content-Type", "application/warc-fields")], note))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write an archive file for each task below ``path``."""
    rows = picked(pages, page_id="long", url="string", html="string").withColumn("row", F.monotonically_increasing_id())
    schema = PAGE + ", digest string, n_bytes long"
    hashed = rows.select("row", "page_id", "url", "html").mapInArrow(digests, schema)
    # the narrow table is written, so that both sides of the join see the same rows
    narrow = durable(hashed.select("row", "page_id", "digest", "n_bytes"), "digests")
    first = (
        narrow.where(F.col("n_bytes") >= min_bytes).groupBy("digest")
        .agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("k"))
        .where("k > 1").select("digest", F.col("first.row").alias("first_row"))
    )
    # rows of payloads that occur once need no partner; the html itself is never shuffled by digest
    partner = narrow.where(F.col("n_bytes") >= min_bytes).join(first, "digest").select("row", "first_row", F.col("digest").alias("first_digest"))
    full = hashed.join(partner, "row", "left")
    lines = full.select("row", "page_id", "url", "html", "digest", "n_bytes", "first_row", "first_digest").mapInArrow(records, "value string")
    lines.write.option("compression", "gzip").option("lineSep", END.decode()).text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record; ``stream`` gives the bytes between terminators."""
    held = b""
    head: dict[str, str] | None = None
    need = 0
    parts: list[bytes] = []
    have = 0

    for piece in stream:
        parts.append(piece + END)
        have += len(piece) + len(END)
        while True:
            if head is None:
                # a block that ends in CR LF shifts where the reader saw the terminator
                held = b"".join(parts).lstrip(b"\r\n")
                parts, have = [held], len(held)
                at = held.find(END)
                if at < 0:
                    break
                fields = _HEADER.findall(held[:at])
                head = {k.decode().lower(): v.decode() for k, v in fields}
                need = at + len(END) + int(head["content-length"])
            if have < need + len(END):
                break
            held = b"".join(parts)
            start = held.find(END) + len(END)
            yield head, held[start:need]
            held, head = held[need + len(END) :], None
            parts, have = [held], len(held)


def _parsed(with_payload: bool):
    def run(batches):
        def pieces():
            for batch in batches:
                for x in batch.column("value"):
                    yield x.as_buffer().to_pybytes() if x.is_valid else b""

        rows: list[tuple] = []
        weight = 0

        def flush():
            cols = list(zip(*rows, strict=True)) or [()] * 11
            kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

        for head, block in parse(pieces()):
            kind = head["warc-type"]
            page = dig = n = status = method = payload = None
            if kind == "metadata":
                value = dict(_HEADER.findall(block)).get(b"page-id", b"")
                page = int(value) if value else None
            elif kind == "request":
                method = block.split(b" ", 1)[0].decode()
            elif kind == "response":
                http, _, body = block.partition(END)
                status, dig, n = http.split(b" ", 2)[1].decode(), digest(body), len(body)
                if f"sha1:{dig}" != head["warc-payload-digest"]:
                    raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                payload = body.decode() if with_payload else None
            rows.append((head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), page, head.get("warc-target-uri"), dig, n, status, method, payload))
            weight += len(block)
            if weight > 1 << 22 or len(rows) >= 5000:
                yield flush()
                rows, weight = [], 0
        yield flush()

    return run


def read_warc(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record.  Gzipped files are not split, so a task sees whole records in order."""
    raw = spark.read.option("lineSep", END.decode()).text(path)
    return raw.select(F.col("value").cast("binary").alias("value")).mapInArrow(_parsed(with_payload), RECORD)


def transactions(records_: DataFrame) -> DataFrame:
    """One row a capture: record_id, nested request, response and metadata, and its original."""
    records_ = durable(records_, "records")
    part = lambda kind, *fields: F.max(F.when(F.col("type").isin(*kind), F.struct(*fields)))
    joined = records_.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(
        part(("request",), "record_id", "method", "target_uri").alias("request"),
        part(("response", "revisit"), "record_id", "type", "refers_to", "status", "target_uri", "payload_digest", "payload_bytes", "payload").alias("response"),
        part(("metadata",), "record_id", "page_id").alias("metadata"),
    )
    # captures that others refer to: one row each
    captures = durable(joined, "captures")
    wanted = captures.where("response.refers_to is not null").select(F.col("response.refers_to").alias("to")).distinct()
    original = captures.join(wanted, F.col("capture") == F.col("to")).select("to", F.struct("metadata.page_id", "response.payload_digest", "response.payload_bytes").alias("original"))
    return captures.join(original, F.col("response.refers_to") == F.col("to"), "left").drop("to")


def op4_warc(spark, sf_dir):
    path = f"{stage_root(spark)}/tidemark/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    whole = transactions(read_warc(spark, path))
    return whole.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "original.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("original.page_id").alias("refers_to"),
    )


QUERIES = {"op4_warc": op4_warc}

ORACLES = {
    "op4_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
s as (select page_id, strlen(h) as n, sha1(h) as x from p),
d as (select page_id, n, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      cast((cast('0x' || substr(x, cast(i // 4 * 5 + 1 as bigint), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as bigint) + 1, 1)), '') as digest from s),
m as (select digest, max(page_id) as top from d group by digest)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from d join m using (digest)""",
}
