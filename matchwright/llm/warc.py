"""Operator 4: WARC archives by way of a chunked record table.

A payload is never one row of the archive: it is cut by the JVM into chunks of at most `CHUNK` bytes, rows of (record,
chunk number), which alone go to Python.  Each chunk is written as a WARC record of its own, the first as `response`,
later ones as `continuation` with a segment number, as the WARC standard provides for.  Every record is a gzip member, so
an archive can be read from any record on, and an empty gzip member follows each, which is the line separator of Spark's
own text writer and reader: the archives are written wherever Spark can write, are valid gzip as they stand, and are split
between tasks when they are read.  (A record cannot hold that separator: UTF-8 has no 0x8B after 0x1F.)  Reading deals
the chunks by record, sorts them by number, and carries an incremental SHA-1 from row to row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, in_batches, stored, table

CHUNK = 1 << 20
END = b"\r\n\r\n"
#: An empty gzip member.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
DATE = "2024-01-01T00:00:00Z"
#: Bytes of rows that a worker gathers before it hands them on.
HOLD = 4 << 20


def base32_sha1(binary: Column) -> Column:
    """Upper-case base 32 of the SHA-1: five hex digits make four characters."""
    digits = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_warc(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record per row of `pages`.

    Of equal payloads of at least `least` bytes, the row with the smallest id is a response and the others revisits of
    it, without a block; a null payload is empty; a payload of any size is cut into chunks before Python sees it; null ids and URLs are written as `null`, and payloads that only
    rows without an id hold are all responses; repeated rows make repeated records; other columns are not written.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("string").alias("name"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload").cast("bigint")})
    firsts = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    rows = rows.join(stored(firsts, "warc-copies"), ["digest", "size"], "left")
    rows = rows.withColumn("refers_to", F.when(~F.coalesce(F.col("id") == F.col("first"), F.lit(False)), F.col("first").cast("string")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "name", "url", "digest", "refers_to", "payload", F.when(F.col("refers_to").isNull(), F.col("size")).otherwise(0).alias("size"))
    rows = rows.withColumn("chunks", F.greatest(F.ceil(F.col("size") / chunk), F.lit(1))).withColumn("k", F.explode(F.expr("sequence(1L, chunks)")))
    data = F.when(F.col("size") > 0, F.expr(f"substring(payload, cast((k - 1) * {chunk} + 1 as int), {chunk})")).otherwise(F.lit(b""))
    rows = rows.select("row", "name", "url", "digest", "refers_to", "size", "chunks", "k", data.alias("data"))

    def run(batches):
        clean = lambda s: "null" if s is None else "".join(c if c >= " " else "?" for c in s)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row, name, url, digest, refers, size, chunks, k = (batch.column(c)[i].as_py() for c in range(8))
                kind = "revisit" if refers is not None else "response" if k == 1 else "continuation"
                head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{clean(name)}{f':{k}' if k > 1 else ''}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {clean(url)}\r\nX-Page-ID: {clean(name)}\r\nX-Row: {row}\r\n"
                block = b""
                if k == 1:
                    head += f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\n"
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                if refers is not None:
                    head += f"WARC-Refers-To: <urn:page:{clean(refers)}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                if chunks > 1:
                    head += f"WARC-Segment-Number: {k}\r\n"
                    if k > 1:
                        head += f"WARC-Segment-Origin-ID: <urn:page:{clean(name)}>\r\n"
                    if k == chunks:
                        head += f"WARC-Segment-Total-Length: {size}\r\n"
                block += batch.column(8)[i].as_py()
                out.append(member(head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + END))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # bytes go through the text writer as they are: a cast of binary to string does not look at them
    records = in_batches(rows, run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def record_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives: (row, page, kind, refers, chunk, total, size, digest, data).

    A record that is whole in one chunk has its digest and no data; the chunks of others have data.  A header without an
    end and a block that is shorter than its Content-Length raise; an empty archive has no rows.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path).select(F.col("value").cast("binary").alias("value"))

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for value in batch.column(0):
                if not len(value.as_buffer()):
                    continue
                raw = zlib.decompress(value.as_buffer(), 31)
                at = raw.find(END)
                if at < 0:
                    raise ValueError(f"record without the end of a header: {raw[:200]!r}")
                fields = dict(x.split(": ", 1) for x in raw[:at].decode().split("\r\n") if ": " in x)
                length = int(fields["Content-Length"])
                block = memoryview(raw)[at + 4 : at + 4 + length]
                if len(block) < length:
                    raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut off")
                kind, chunk = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 0))
                if kind != "continuation":
                    block = block[raw.find(END, at + 4) - at :]
                data, digest = None, None
                if kind == "revisit":
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                elif chunk == 0:
                    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                else:
                    data = block.tobytes()
                refers = fields.get("WARC-Refers-To")
                name = fields["X-Page-ID"]
                out.append((fields["X-Row"], None if name == "null" else name, kind, refers and refers[len("<urn:page:") : -1], chunk, int(fields.get("WARC-Segment-Total-Length", -1)), len(block), digest, data))
                size += length
                if size > HOLD:
                    yield rows_of(out)
                    out, size = [], 0
            yield rows_of(out)

    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["row", "page", "kind", "refers", "chunk", "total", "size", "digest", "data"]

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 9, kinds, strict=True)], names)

    return in_batches(lines, run, "row string, page string, kind string, refers string, chunk long, total long, size long, digest string, data binary")


def assembled(chunks: DataFrame) -> DataFrame:
    """One row per record (row, page, kind, refers, payload_bytes, payload_digest); only one chunk of a record is held at a time."""

    def run(batches):
        now, sha, size, total = None, None, 0, -1

        def record():
            if total != size or sha is None:
                raise ValueError(f"record {now[0]} misses chunks")
            return (*now, size, base64.b32encode(sha.digest()).decode())

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row, page, kind, refers, chunk, whole, length, digest = (batch.column(k)[i].as_py() for k in range(8))
                if chunk <= 1 and now is not None:
                    out.append(record())
                    now = None
                if digest is not None:
                    out.append((row, page, kind, refers, length, digest))
                    continue
                if chunk == 1:
                    now, sha, size, total, last = (row, page, kind, refers), hashlib.sha1(), 0, -1, 0
                if now is None or row != now[0] or chunk != last + 1:
                    raise ValueError(f"record {row} misses chunks")
                sha.update(batch.column(8)[i].as_buffer())
                size, last, total = size + length, chunk, max(total, whole)
            yield rows_of(out)
        if now is not None:
            yield rows_of([record()])

    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], ["row", "page", "kind", "refers", "payload_bytes", "payload_digest"])

    dealt = chunks.repartition("row").sortWithinPartitions("row", "chunk")
    return in_batches(dealt, run, "row string, page string, kind string, refers string, payload_bytes long, payload_digest string")


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; a revisit has the size of the response it refers to.

    Ids written as `null` come back null; records of repeated rows come back as often as they were written; a revisit
    whose response is not in the archives has no size; an empty archive has no rows.
    """
    records = stored(assembled(record_chunks(spark, path)), "warc-records")
    sizes = records.where("kind = 'response' and page is not null").groupBy("page", "payload_digest").agg(F.min("payload_bytes").alias("full_bytes")).withColumnRenamed("page", "refers")
    whole = records.where("kind = 'response'").withColumn("full_bytes", F.col("payload_bytes"))
    revisits = records.where("kind = 'revisit'").join(sizes, ["refers", "payload_digest"], "left")
    return whole.unionByName(revisits).select(F.col("page").cast(id_type).alias("page_id"), F.col("full_bytes").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), F.col("refers").cast(id_type).alias("refers_to"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` written as WARC archives in the shared folder and read back."""
    path = fresh(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


_DIGITS = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {a}, 5))::int >> {s}) & 31) + 1, 1)".format(a=5 * i + 1, s=s) for i in range(8) for s in (15, 10, 5, 0)
)
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, strlen(html)::bigint AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""
