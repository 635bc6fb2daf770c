"""WARC archives: write pages as records, and read records back from their segments.

Writing: a page whose payload (its html in UTF-8) equals that of others and has at least `least` bytes is a
response only if its page_id is the group's largest; the others are revisits of that. Only digests and ids of
equal payloads are grouped. A response's block is an HTTP message with its payload in chunks; a block of over
`segment` bytes goes on in continuation records. Spark's text writer puts records, which end in two line
breaks, into gzip files of at most `per_file` records, so that a file is committed or not there at all. Records are at most
a segment long, so files are bounded in bytes too. Each row has a number of its own in its record's name, and a
revisit names the record of the response that it refers to.

Reading: records are cut by Content-Length. Those of one segment are decoded at once; others are grouped by
their origin's identifier, ordered by segment number, and their length is held against the stated total. Then
the chunks are joined and the payload's digest is verified. Whatever doesn't fit raises.

Defined results: a null html is empty; rows that repeat a page_id are records of their own, of which all with
the largest page_id of equal payloads are responses; a null page_id is below all others. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

LEAST, SEGMENT, CHUNK, PER_FILE, BATCH = 1000, 32768, 4096, 4000, 1 << 23
FOUND = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
PARTS = "origin string, number int, total long, fields map<string,string>, block binary"


def _chunked(payload: bytes, size: int) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunk(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


def _line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def records(name: str, page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT, chunk: int = CHUNK) -> list[bytes]:
    """A page's records, without the two line breaks after each. refers_to is the name of the response, which starts with its page_id."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{f'Content-Length: {len(payload)}' if revisit else 'Transfer-Encoding: chunked'}\r\n\r\n".encode()
    block = http if revisit else http + _chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for k, part in enumerate(parts):
        f = {"WARC-Type": ("revisit" if revisit else "response") if k == 0 else "continuation", "WARC-Record-ID": f"<urn:page:{name}{f':{k + 1}' if k else ''}>", "WARC-Date": "1970-01-01T00:00:00Z"}
        if k == 0:
            f |= {"WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response"}
            if url is not None:
                f["WARC-Target-URI"] = _line(url)
            if page_id is not None:
                f["Page-ID"] = str(page_id)
            if revisit:
                f |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        if len(parts) > 1:
            f["WARC-Segment-Number"] = str(k + 1)
            if k:
                f["WARC-Segment-Origin-ID"] = f"<urn:page:{name}>"
            if k == len(parts) - 1:
                f["WARC-Segment-Total-Length"] = str(len(block))
        f["Content-Length"] = str(len(part))
        out.append(("WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in f.items()) + "\r\n").encode() + part)
    return out


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # rows are numbered once and written, so that a response is called the same wherever it is named
    digested = materialize(rows.select("*", F.when(F.octet_length("payload") >= least, F.sha1("payload")).alias("digest"), F.monotonically_increasing_id().alias("number")), "numbered")
    equal = digested.where("digest is not null").groupBy("digest").agg(F.max(F.struct("page_id", "number")).alias("kept"), F.count("*").alias("rows")).where("rows > 1").select("digest", "kept")
    equal = materialize(equal, "equal")
    other = F.col("kept.page_id").isNotNull() & ~F.col("kept.page_id").eqNullSafe(F.col("page_id"))
    kept = F.when(other, F.concat_ws(":", "kept.page_id", "kept.number"))
    dealt = digested.join(equal, "digest", "left").select("page_id", "number", "url", "payload", kept.alias("refers_to"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            out, size = [], 0
            for k in range(whole.num_rows):
                page_id, number, url, payload, refers_to = (column[k].as_py() for column in whole.columns)
                out += records(f"{page_id}:{number}", page_id, url, payload, refers_to, segment)
                size += len(payload)
                if size > BATCH or k == whole.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0

    written = dealt.mapInArrow(made, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def unzipped(data: bytes) -> bytes:
    """The content of an archive, of as many gzip members as it has."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data
    return b"".join([*out, data])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = data[head + 4 : head + 4 + size]
        if len(block) != size or data[head + 4 + size : head + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield fields, block
        at = head + 8 + size


def decoded(fields: dict[str, str], block: bytes) -> tuple:
    """A row of FOUND from a whole record."""
    head, body = block.split(b"\r\n\r\n", 1)
    http = {a.lower(): b for a, b in (x.split(": ", 1) for x in head.decode().split("\r\n")[1:])}
    digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
    page_id, url = fields.get("Page-ID"), fields.get("WARC-Target-URI")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    own = (None if page_id is None else int(page_id), url, fields["WARC-Type"])
    if fields["WARC-Type"] == "revisit":
        return (*own, int(fields["WARC-Refers-To"][len("<urn:page:") : -1].split(":")[0]), None, int(http["content-length"]), digest)
    payload = dechunk(body) if http.get("transfer-encoding") == "chunked" else body
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {page_id} and its digest differ")
    return (*own, None, payload, len(payload), digest)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The FOUND rows of all archives in a folder."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = unzipped(content.as_py())
                rows = []
                for fields, block in parse(data):
                    number = int(fields.get("WARC-Segment-Number", 0))
                    total = fields.get("WARC-Segment-Total-Length")
                    rows.append((fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), number, total and int(total), list(fields.items()), block))
                    if len(rows) >= 1000:
                        yield _parts(rows)
                        rows = []
                yield _parts(rows)

    def _parts(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["origin", "number", "total", "fields", "block"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield _found([decoded(dict(f), b) for f, b in zip(part.column("fields").to_pylist(), part.column("block").to_pylist(), strict=True)])

    segments = files.mapInArrow(parts, PARTS)
    single = segments.where("number = 0").select("fields", "block")
    grouped = segments.where("number > 0").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "block", "total"))).alias("s"), F.first(F.when(F.col("number") == 1, F.col("fields")), True).alias("fields"))
    sizes = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    in_order = F.forall(F.transform("s", lambda x, i: x["number"] == i + 1), lambda ok: ok)
    fits = in_order & (F.element_at("s", -1)["total"] == sizes) & F.col("fields").isNotNull()
    joined = F.aggregate("s", F.lit(b"").cast("binary"), lambda b, x: F.concat(b, x["block"]))
    segmented = grouped.select("fields", F.when(fits, joined).otherwise(F.raise_error(F.concat(F.lit("segments don't make up "), "origin")).cast("binary")).alias("block"))
    return single.unionByName(segmented).mapInArrow(whole, FOUND)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/penstroke/{uuid.uuid4().hex}/archives"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS kept FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND kept <> page_id THEN kept END AS refers_to
FROM k
"""
