"""Operator 5 - WARC archives: writing, reading, and reassembly of segments.

Writing: a page becomes a response record whose HTTP body is in chunked
transfer framing, or a revisit record if a page with the same long payload is
the response. A block longer than ``segment`` bytes is cut: the first part is
the record itself, the others are continuation records that name it as their
origin. Spark's text sink writes the files (a record is ended by two line
breaks, as the format wants).

Reading: files are parsed where they are read; whole records are decoded at
once, and only segments are shuffled, grouped by origin, ordered by number,
checked against the total length and joined.

Scale: payloads move once to meet the size of their group, in a join that Spark can
split if one payload is very common. Memory: one archive file of at most
``records`` records, whose blocks have at most ``segment`` bytes each (64 MiB
together), or the longest single page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "page_id long, record_id string, type string, origin string, number int, total long, digest string, refers_to long, block binary"


def record_id(name: str, number: int) -> str:
    """The id of a segment of the page that is written under ``name``."""
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{name}/{number}'.encode()).hexdigest())}>"


def response_name(digest: str) -> str:
    """The name of the only response of a payload, which its revisits know too."""
    return f"payload/{digest}"


def sha1_header(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, i = [], 0
    while True:
        end = body.index(CRLF, i)
        size = int(body[i:end].split(b";")[0], 16)
        i = end + 2
        if size == 0:
            return b"".join(out)
        if body[i + size : i + size + 2] != CRLF:
            raise ValueError("chunk without its end")
        out.append(body[i : i + size])
        i += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int, chunk: int, sole: bool = False) -> list[bytes]:
    """The records of one page, under ids that no other written page has.

    Page ids can be null or repeated, so they are told in a header of their own.
    ``sole``: one page alone is the response of this payload, here or by reference.
    """
    name = response_name(digest) if sole and refers_to is None else uuid.uuid4().hex
    common: list[tuple[str, object]] = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Page-ID", page)]
    target = ("WARC-Target-URI", (url or f"urn:page:{page}").replace("\r", "%0D").replace("\n", "%0A"))
    http = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1_header(digest))]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        extra = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response_name(digest), 1) if sole else None), ("WARC-Refers-To-Page", refers_to)]
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(name, 1)), *common, target, *http, *extra], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", record_id(name, 1)), *common, target, *http, first], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        total = len(block) if number == len(parts) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(name, number)), *common, target]
        out.append(record([*fields, ("WARC-Segment-Origin-ID", record_id(name, 1)), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], part))
    return out


def parse(content: bytes):
    """The records of an archive file: (fields, block)."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    i, n = 0, len(content)
    while i < n:
        end = content.index(CRLF + CRLF, i)
        lines = content[i:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, content[end + 4 : end + 4 + size]
        i = end + 4 + size + 4


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP message."""
    head, _, body = block.partition(CRLF + CRLF)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def write_pages(pages: DataFrame, path: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, segment: int = 32_768, chunk: int = 4096, records: int = 2000) -> None:
    """Write the archives. Of equal payloads of at least ``least`` bytes the largest page id is the response.

    Where several rows have that id, all are responses; the others name the id
    and the digest, but none of the equal records.
    """
    base = pages.select(F.col(page_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    per_page = base.where(F.octet_length("payload") >= least).groupBy("digest", "page").agg(F.count("*").alias("n"))
    groups = per_page.groupBy("digest").agg(F.max("page").alias("last"), F.max(F.struct("page", "n")).alias("top"), F.sum("n").alias("n")).where("n > 1 and last is not null")
    refers_to = F.when((F.col("last") != F.col("page")) | F.col("page").isNull(), F.col("last"))
    told = base.join(groups.select("digest", "last", (F.col("top.n") == 1).alias("sole")), "digest", "left").select("page", "url", "payload", "digest", refers_to.alias("refers_to"), F.coalesce("sole", F.lit(False)).alias("sole"))

    def write(batches):
        for batch in batches:
            out: list[bytes] = []
            for *row, sole in zip(*(batch[c].to_pylist() for c in ("page", "url", "payload", "digest", "refers_to", "sole")), strict=True):
                out += page_records(*row, segment=segment, chunk=chunk, sole=sole)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    text = told.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def read_records(spark, path: str) -> DataFrame:
    """Every record of the archives in a folder."""

    def read(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for f, block in parse(content.as_buffer().to_pybytes()):
                    number, total, page = f.get("WARC-Segment-Number"), f.get("WARC-Segment-Total-Length"), f.get("WARC-Page-ID")
                    digest, refers = f.get("WARC-Payload-Digest"), f.get("WARC-Refers-To-Page")
                    rows.append(
                        {
                            "page_id": None if page in (None, "None") else int(page),
                            "record_id": f["WARC-Record-ID"],
                            "type": f["WARC-Type"],
                            "origin": f.get("WARC-Segment-Origin-ID") or (f["WARC-Record-ID"] if number else None),
                            "number": int(number) if number else None,
                            "total": int(total) if total else None,
                            "digest": base64.b32decode(digest[5:]).hex() if digest else None,
                            "refers_to": int(refers) if refers else None,
                            "block": block,
                        }
                    )
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=PARSED_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, PARSED)


PARSED_ARROW = pa.schema(
    [("page_id", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())]
)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin, ordered by number, and checked against the total length.

    A group whose numbers have a gap, or whose length is not the total, is
    returned with ``complete`` false and a null block.
    """
    whole = records.where("origin is null").select("page_id", "type", "digest", "refers_to", "block", F.lit(True).alias("complete"))
    groups = (
        records.where("origin is not null")
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
            F.max("total").alias("total"),
            F.max("number").alias("last"),
            F.count("*").alias("n"),
            F.min(F.when(F.col("number") == 1, F.struct("page_id", "type", "digest", "refers_to"))).alias("head"),
        )
        .withColumn("block", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.block))"))
    )
    sound = (F.col("n") == F.col("last")) & (F.octet_length("block") == F.col("total")) & F.col("head").isNotNull()
    joined = groups.select("head.*", F.when(sound, F.col("block")).alias("block"), F.coalesce(sound, F.lit(False)).alias("complete"))
    return whole.unionByName(joined)


def payloads(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, complete) of reassembled records."""

    def decode(batches):
        for batch in batches:
            size, digest = [], []
            for kind, known, block in zip(*(batch[c].to_pylist() for c in ("type", "digest", "block")), strict=True):
                if block is None:
                    size.append(None)
                    digest.append(None)
                elif kind == "revisit":
                    head = dict(x.split(": ", 1) for x in block.decode().split("\r\n")[1:] if x)
                    size.append(int(head["Content-Length"]))
                    digest.append(known)
                else:
                    body = payload_of(block)
                    size.append(len(body))
                    digest.append(hashlib.sha1(body).hexdigest())
                    if known and known != digest[-1]:
                        raise ValueError("payload does not have the digest of its record")
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(size, pa.int64()), pa.array(digest, pa.string()), batch["type"], batch["refers_to"], batch["complete"]], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"])

    return records.mapInArrow(decode, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean")


def warc_round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write pages as archives (to a new shared folder unless ``path`` is given) and read them back.

    A row for each page. Null html is empty; a null url becomes a name made
    from the id; pages with a null id revisit like others but are never the
    response of a group, unless no id is known; equal ids keep one row each;
    other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path, **options)
    return payloads(reassemble(read_records(spark, path)))


def oracle(least: int = 1000) -> str:
    """DuckDB SQL for ``warc_round_trip`` over pages, without any archive."""
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM p),
k AS (SELECT *, n >= {least} AND page_id <> top AS again FROM g)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to, true AS complete FROM k"""
