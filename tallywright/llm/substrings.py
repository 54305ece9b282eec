"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

Every window of ``window`` words is hashed and counted: the hashes are dealt to buckets,
and a window is repeated if a document with a smaller id has its hash too. The windows
travel packed, eight bytes each beside a few bytes for every document and bucket; as rows
of their own they would take the shuffle half as much space again and the sorter more.

A bucket is chosen by a second hash that is independent of the first, so two windows are
taken for equal on 64 bits and the logarithm of the number of buckets, which grows with
the input. Where one task's chunk holds a window in several documents, only the document
with the smallest id goes on to the bucket: the others are repeats already. So a window
that a third of all documents hold comes to one entry a chunk.

Repeats return as bits, packed per bucket and part of the documents (a row for each document
and bucket would grow with the product of both) and then unpacked to a row a document; the
last pass finds the windows again, merges repeated ones into maximal removal intervals and
keeps the words outside.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NONSPACE, Words, mix, text_chunks

WINDOW = 13
#: Text bytes whose windows share a bucket, and text bytes that a task packs at once.
BUCKET_BYTES = 16 << 20
CHUNK_BYTES = 2 << 20
_NULL_ID = np.iinfo(np.int64).max
_U = np.uint64


def _windows(words: Words, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, bucket) of every window of the chunk, in order."""
    hashed = words.hashes()
    starts, first = words.gram_hashes(hashed, window)
    _, second = words.gram_hashes(words.hashes(seed=1), window)
    return starts, first, (second % _U(buckets)).astype(np.int64)


def _beaten(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash with a smaller id."""
    out = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        order = np.argsort(hashes)
        ordered = hashes[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        own = ids[order]
        out[order] = own > np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(own))))
    return out


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as longs; a null counts as the largest."""
    return np.array([_NULL_ID if v is None else v for v in column.to_pylist()], dtype=np.int64)


def _pack(ids, tags, counts, bits, hashes) -> bytes:
    head = np.array([len(ids), len(bits)], dtype=np.int64)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, ids, tags, counts, np.packbits(bits), hashes))


def _unpack(raw: bytes):
    n, windows = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for kind, size in ((np.int64, n), (np.uint32, n), (np.uint32, n), (np.uint8, (windows + 7) // 8)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    ids, tags, counts, bits = out
    return ids, tags, counts, np.unpackbits(bits, count=windows).astype(bool), np.frombuffer(raw, _U, offset=at)


def _packed(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, cells): windows of many documents by bucket; local repeats are bits without hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text", CHUNK_BYTES):
            words = Words(texts, NONSPACE, lower=False)
            starts, hashes, bucket = _windows(words, window, buckets)
            if not len(starts):
                continue
            ids = _ids(batch.column("id"))
            tags = np.array([zlib.crc32(t) for t in texts], dtype=np.uint32)
            doc = np.searchsorted(words.first, starts, side="right") - 1
            repeat = _beaten(hashes, ids[doc])
            order = np.argsort(bucket, kind="stable")
            used, heads = np.unique(bucket[order], return_index=True)
            rows: list[bytes] = []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
                own = order[a:b]
                which, counts = np.unique(doc[own], return_counts=True)
                rows.append(_pack(ids[which], tags[which], counts.astype(np.uint32), repeat[own], hashes[own][~repeat[own]]))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "cells"])

    return docs.mapInArrow(run, "bucket int, cells binary")


def _part(ids: np.ndarray, tags: np.ndarray, parts: int) -> np.ndarray:
    """The part of the documents that a document's repeats return by."""
    return (mix(ids.view(_U) ^ mix(tags.astype(_U))) % _U(parts)).astype(np.int64)


def _repeats(group: pa.Table, parts: int) -> pa.Table:
    """One bucket: (part, cells), the bits of all documents of a part with a repeated window in it."""
    cells = [_unpack(raw) for raw in group.column("cells").to_pylist()]
    ids, tags, counts = (np.concatenate([c[i] for c in cells]) for i in range(3))
    repeat, hashes = (np.concatenate([c[i] for c in cells]) for i in (3, 4))
    owner = np.repeat(np.arange(len(ids), dtype=np.uint32), counts)
    sent = np.flatnonzero(~repeat)
    repeat[sent[_beaten(hashes, ids[owner[sent]])]] = True
    del owner, sent, hashes, cells
    edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    some = np.flatnonzero(np.add.reduceat(repeat.astype(np.int64), edges[:-1].astype(np.int64)))
    part = _part(ids[some], tags[some], parts)
    some = some[np.argsort(part, kind="stable")]
    part.sort()
    bucket, rows = group.column("bucket")[0].as_py(), []
    used, heads = np.unique(part, return_index=True)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(some)]):
        own = some[a:b]
        bits = [np.packbits(repeat[edges[i]:edges[i + 1]]) for i in own]
        head = np.array([len(own), bucket], dtype=np.int64)
        lengths = np.array([len(x) for x in bits], dtype=np.uint32)
        rows.append(b"".join(np.ascontiguousarray(x).tobytes() for x in (head, ids[own], tags[own], lengths, *bits)))
    return pa.table({"part": pa.array(used, pa.int32()), "cells": pa.array(rows, pa.binary())})


def _by_document(group: pa.Table) -> pa.Table:
    """One part: (id, tag, found), a row for every document with all its buckets' bits."""
    ids, tags, buckets, lengths, bits = [], [], [], [], []
    for raw in group.column("cells").to_pylist():
        n, bucket = np.frombuffer(raw, np.int64, 2).tolist()
        ids.append(np.frombuffer(raw, np.int64, n, 16))
        tags.append(np.frombuffer(raw, np.uint32, n, 16 + 8 * n))
        lengths.append(np.frombuffer(raw, np.uint32, n, 16 + 12 * n))
        buckets.append(np.full(n, bucket, dtype=np.int32))
        bits.append(raw[16 + 16 * n:])
    ids, tags, buckets, lengths = (np.concatenate(x) for x in (ids, tags, buckets, lengths))
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
    bits = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(bits))])
    order = np.lexsort((buckets, tags, ids))
    ids, tags = ids[order], tags[order]
    heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]))
    found = pa.StructArray.from_arrays([pa.array(buckets[order]), bits.take(pa.array(order)).cast(pa.binary())], names=["bucket", "bits"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(ids)).astype(np.int32)), found)
    return pa.table({"id": pa.array(ids[heads]), "tag": pa.array(tags[heads].astype(np.int64)), "found": lists})


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) for every row of ``docs``.

    A word goes if a window that covers it also starts in a document with a smaller id;
    ``spans`` are the maximal removed word ranges, ``kept`` the other words joined by blanks.
    Ids are integers. Null and empty texts have no words; texts shorter than a window keep
    all; rows with equal ids never remove from one another; a null id counts as larger than
    every other; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / BUCKET_BYTES))
    # as many partitions as buckets: what a task reads does not grow with the input
    packed = _packed(source, window, buckets).repartition(buckets, "bucket")
    repeats = packed.groupBy("bucket").applyInArrow(lambda group: _repeats(group, buckets), "part int, cells binary")
    by_doc = repeats.repartition(buckets, "part").groupBy("part").applyInArrow(_by_document, "id long, tag long, found array<struct<bucket:int,bits:binary>>")

    # rows that share an id are told apart by a checksum of their text
    keyed = source.select(F.col("id").alias("id_"), "text", F.coalesce("id", F.lit(int(_NULL_ID))).alias("key"), F.crc32(F.encode("text", "utf-8")).alias("sum"))
    joined = keyed.join(by_doc, (F.col("key") == F.col("id")) & (F.col("sum") == F.col("tag")), "left").select("id_", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text", CHUNK_BYTES):
            words = Words(texts, NONSPACE, lower=False)
            starts, _, bucket = _windows(words, window, buckets)
            edges = np.searchsorted(starts, words.first)
            cover = np.zeros(len(words.starts) + 1, dtype=np.int64)
            for i, found in enumerate(batch.column("found").to_pylist()):
                if not found:
                    continue
                own = bucket[edges[i]:edges[i + 1]]
                order = np.argsort(own, kind="stable")
                dealt = own[order]
                for cell in found:
                    at = order[np.searchsorted(dealt, cell["bucket"]):np.searchsorted(dealt, cell["bucket"], side="right")]
                    hit = starts[edges[i] + at[np.unpackbits(np.frombuffer(cell["bits"], np.uint8), count=len(at)).astype(bool)]]
                    cover[hit] += 1
                    cover[hit + window] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            raw = words.buffer.tobytes()
            n_removed, spans, kept = [], [], []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                own = gone[a:b]
                change = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                n_removed.append(int(own.sum()))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(change[::2], change[1::2])])
                stay = np.flatnonzero(~own) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist())]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id_"), pa.array(words.counts().astype(np.int64)), pa.array(n_removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
                names=["id", "n_words", "n_removed", "spans", "kept"],
            )

    schema = "id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """Contract query: words removed from every document, and a digest of those kept."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same with windows spelled out, for DuckDB.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
m AS (SELECT s, min(doc_id) AS lo FROM g GROUP BY s),
h AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM g JOIN m USING (s) WHERE g.doc_id > m.lo) GROUP BY r),
x AS (SELECT d.r, d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS k, w, gone FROM d LEFT JOIN h USING (r)),
kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) u
         JOIN x USING (r) WHERE gone IS NULL OR NOT list_contains(gone, i) GROUP BY x.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(k AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM x LEFT JOIN kept USING (r)
"""
