"""WARC archives, index first.

Every task writes one archive of gzip members, a member a record, and returns an index row
per record: file, offset, length, URL, digest. Reading starts from the index: the selected
rows are dealt by stretches of their file, sorted by offset, and neighbouring byte ranges
are read at once. Files have attempt-unique names and only those that the committed index
names are ever read, so a lost executor leaves at most an unread file behind.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, scratch_path

#: Ranges that lie closer than this are read at once, up to ``READ_BYTES``.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20
#: Index rows of one stretch of an archive that a task reads in order.
STRETCH_BYTES = 32 << 20
_DATE = "1970-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 9562


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that Spark wrote as a URI, through Arrow."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def _clean(value: object) -> str:
    """Header values stay on their line."""
    return re.sub(r"[\r\n]+", " ", "" if value is None else str(value))


def encode_record(kind: str, page_id: object, url: object, payload: bytes, payload_digest: str, refers_to: object) -> bytes:
    block = b"" if kind == "revisit" else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Original-Length: {len(payload)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def decode_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one gzip member."""
    raw = zlib.decompress(member, wbits=31)
    head, _, body = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, body[:int(headers["content-length"])]


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, html, payload_digest, record_type, refers_to): which record each page becomes.

    Of pages with equal payloads of at least ``least`` bytes the largest page id is the
    response and the others revisit it; smaller payloads are all responses. A null html is
    empty. Rows that repeat the largest id are all responses; a null id is below all others
    (a group of null ids only is all responses).
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    largest = p.groupBy("sha1").agg(F.max("page_id").alias("largest"))
    revisits = (F.octet_length("html") >= least) & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return p.join(largest, "sha1").select(
        "page_id", "url", "html", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("largest")).alias("refers_to"),
    )


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write the planned records below ``folder``; returns the index (committed as a table).

    Index columns: file, offset, length, page_id, url, payload_digest, record_type, refers_to,
    payload_bytes.
    """
    kind = records.schema["page_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, out, at, path = None, None, 0, ""
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    where, local = _filesystem(path)
                    where.create_dir(local.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(local, compression=None)
                offsets, lengths, digests, sizes = [], [], [], []
                rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "record_type", "refers_to")))
                for page_id, url, html, record_type, refers_to in rows:
                    payload = html.encode()
                    named = digest(payload)
                    member = encode_record(record_type, page_id, url, payload, named, refers_to)
                    out.write(member)
                    offsets.append(at)
                    lengths.append(len(member))
                    digests.append(named)
                    sizes.append(len(payload))
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * batch.num_rows, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch.column("page_id"), batch.column("url"),
                     pa.array(digests, pa.string()), batch.column("record_type"), batch.column("refers_to"), pa.array(sizes, pa.int64())],
                    names=["file", "offset", "length", "page_id", "url", "payload_digest", "record_type", "refers_to", "payload_bytes"],
                )
        finally:
            if out is not None:
                out.close()

    schema = T.StructType([
        T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("page_id", kind),
        T.StructField("url", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", kind), T.StructField("payload_bytes", T.LongType()),
    ])
    return materialise(records.mapInArrow(run, schema), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """(start, end, indexes) of reads that cover sorted (offset, length) ranges."""
    reads: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        if reads and offset - reads[-1][1] <= gap and max(offset + length, reads[-1][1]) - reads[-1][0] <= most:
            start, end, own = reads[-1]
            own.append(i)
            reads[-1] = (start, max(end, offset + length), own)
        else:
            reads.append((offset, offset + length, [i]))
    return reads


def read(selected: DataFrame) -> DataFrame:
    """The records that the index rows ``selected`` name, read back from the archives.

    Adds to every index row: headers (map), payload (binary, empty for a revisit) and
    sha1_base32, the digest of the payload as read (null for a revisit).
    """
    columns = selected.columns
    dealt = selected.withColumn("stretch_", F.floor(F.col("offset") / STRETCH_BYTES)).repartition("file", "stretch_").sortWithinPartitions("file", "offset").drop("stretch_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            start = 0
            while start < batch.num_rows:
                end = start
                while end < batch.num_rows and files[end] == files[start]:
                    end += 1
                where, local = _filesystem(files[start])
                with where.open_input_file(local) as source:
                    for at, to, own in coalesced(list(zip(offsets[start:end], lengths[start:end]))):
                        block = source.read_at(to - at, at)
                        found = [decode_record(block[offsets[start + i] - at:offsets[start + i] - at + lengths[start + i]]) for i in own]
                        part = batch.slice(start + own[0], len(own))
                        yield pa.RecordBatch.from_arrays(
                            [*part.columns, pa.array([list(h.items()) for h, _ in found], pa.map_(pa.string(), pa.string())), pa.array([p for _, p in found], pa.binary()),
                             pa.array([None if h["warc-type"] == "revisit" else digest(p) for h, p in found], pa.string())],
                            names=[*columns, "headers", "payload", "sha1_base32"],
                        )
                start = end

    schema = T.StructType([*selected.schema.fields, T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()), T.StructField("sha1_base32", T.StringType())])
    return dealt.mapInArrow(run, schema)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: all pages written as WARC, indexed, and read back record by record.

    Every digest comes from the record: recomputed over a response's payload, from the
    header of a revisit; a revisit's length is that of the response it names.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write(plan_records(pages), scratch_path(spark, "warc"))
    records = read(index.select("file", "offset", "length", "page_id", "url", "refers_to"))
    header = lambda name: F.try_element_at("headers", F.lit(name))
    return records.select(
        "page_id",
        F.when(header("warc-type") == "revisit", header("warc-original-length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.coalesce("sha1_base32", F.regexp_replace(header("warc-payload-digest"), "^sha1:", "")).alias("payload_digest"),
        header("warc-type").alias("record_type"), "refers_to",
    )


#: DuckDB has no SHA-1 in base32 of its own: the digits are cut from the hexadecimal form.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS x FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    (CAST('0x' || substr(x, CAST(1 + (i // 8) * 10 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g
"""
