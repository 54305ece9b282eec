"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every sliding window of ``window - k + 1``
grams, so any shared span of ``window`` words leaves an equal fingerprint at an equal
offset on both. Training and test fingerprints meet in a Spark join; every match names a
diagonal (document position minus item position) along which the words themselves are
compared, which extends the hit to its full length and discards chance collisions.

Items of fewer than ``window`` words are a window by themselves: for each of their (at
most ``window - 1``) lengths every gram of that length is a fingerprint, on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, materialise, signed, text_chunks

#: Up to so many benchmark fingerprints, of three numbers each and so at most some 20 MB, are
#: broadcast; beyond it both sides are shuffled by fingerprint.
BROADCAST_FINGERPRINTS = 500_000
#: Parts that a fingerprint's documents are dealt to where both sides are shuffled.
SALTS = 16


def winnow(starts: np.ndarray, hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> np.ndarray:
    """Indexes into ``starts`` of the leftmost smallest hash of every window of words."""
    span = window - k + 1
    if len(starts) < span:
        return np.zeros(0, dtype=np.int64)
    # grams of one text are consecutive; a window of grams is whole if its ends are span - 1 apart
    heads = np.flatnonzero(starts[span - 1:] - starts[:len(starts) - span + 1] == span - 1)
    text_of = np.searchsorted(first, starts, side="right")
    heads = heads[text_of[heads] == text_of[heads + span - 1]]
    best, where = hashes[heads], heads.copy()
    for step in range(1, span):
        other = hashes[heads + step]
        smaller = other < best
        best = np.where(smaller, other, best)
        where = np.where(smaller, heads + step, where)
    return np.unique(where)


def _fingerprints(words: Words, k: int, window: int, short: list[int], items: bool):
    """(word index, hash) of the chunk's fingerprints; ``items``: only whole short items."""
    hashed = words.hashes()
    starts, grams = words.gram_hashes(hashed, k)
    kept = winnow(starts, grams, words.first, k, window)
    parts = [(starts[kept], grams[kept])]
    for length in short:
        at, dense = words.gram_hashes(hashed, length)
        dense = dense ^ np.uint64(0x5851F42D4C957F2D)  # apart from the grams of winnowing
        if items:
            whole = np.isin(at, words.first[:-1][words.counts() == length])
            at, dense = at[whole], dense[whole]
        parts.append((at, dense))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _fingerprint_rows(df: DataFrame, key: str, text: str, k: int, window: int, short: list[int], items: bool) -> DataFrame:
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text):
            words = Words(texts, ALNUM, lower=True)
            at, hashes = _fingerprints(words, k, window, short, items)
            of = np.searchsorted(words.first, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(of)), pa.array(signed(hashes)), pa.array((at - words.first[of]).astype(np.int32))],
                names=["key", "h", "pos"],
            )

    schema = T.StructType([T.StructField("key", kind), T.StructField("h", T.LongType()), T.StructField("pos", T.IntegerType())])
    return df.select(key, text).mapInArrow(run, schema)


def _word_list(text: bytes) -> list[bytes]:
    words = Words([text], ALNUM, lower=True)
    raw = words.buffer.tobytes()
    return [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]


def _hits(doc: list[bytes], found: list[dict], window: int) -> tuple[np.ndarray, set[str]]:
    """Which words of the document are hit, and the items that hit them.

    Along each diagonal all words are compared at once; runs of equal words as long as the
    item's window are hits.
    """
    number = {w: i for i, w in enumerate(dict.fromkeys(doc))}
    own = np.array([number[w] for w in doc], dtype=np.int64)
    cover, names, items = np.zeros(len(doc) + 1, dtype=np.int64), set(), {}
    for c in found:
        item = items.get(c["item_text"])
        if item is None:
            item = items[c["item_text"]] = np.array([number.get(w, -1) for w in _word_list(c["item_text"])], dtype=np.int64)
        need = min(window, len(item))
        for d in c["diagonals"]:
            lo, hi = max(d, 0), min(d + len(item), len(doc))
            if hi - lo < need:
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own[lo:hi] == item[lo - d:hi - d], [False]]).astype(np.int8)))
            starts, ends = edges[::2] + lo, edges[1::2] + lo
            long = ends - starts >= need
            if long.any():
                cover[starts[long]] += 1
                cover[ends[long]] -= 1
                names.add(c["item"])
    return np.cumsum(cover[:-1]) > 0, names


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    broadcast_fingerprints: int = BROADCAST_FINGERPRINTS,
) -> DataFrame:
    """Every document with the words that benchmark items share with it.

    Returns one row per row of ``docs``: the id, ``n_words``, ``n_hit``, ``spans`` (hit word
    ranges, end exclusive) and ``items`` (sorted item ids as strings). A null or empty text
    has no words and no hits; null or wordless items match nothing; a null item id reads as
    an empty string; rows with a repeated or null id are each judged on their own text, and
    other columns are ignored. Repeated items count once.
    """
    bench = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("item_text")).distinct()
    n_words = F.size(F.filter(F.split(F.coalesce("item_text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    short = sorted(r[0] for r in bench.select(n_words.alias("n")).where(F.col("n").between(1, window - 1)).distinct().collect())

    # fingerprints carry an item's number; its text joins the matches at last
    items = materialise(bench.withColumn("no", F.monotonically_increasing_id()), "benchmark-items")
    tests = _fingerprint_rows(items, "no", "item_text", k, window, short, items=True).select(F.col("key").alias("no"), "h", F.col("pos").alias("item_pos"))
    small = tests.count() <= broadcast_fingerprints
    if small:
        tests = F.broadcast(tests)

    # rows meet their matches by a hash of id and text, so null and repeated ids stay apart; were
    # two texts to share it, the words along each other's diagonals would be compared in vain
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    docs = docs.withColumn("key_", F.xxhash64("id_", "text_"))
    train, on = _fingerprint_rows(docs, "key_", "text_", k, window, short, items=False), ["h"]
    if not small:
        # texts that many documents hold share their fingerprints: those rows are dealt out
        train, tests, on = train.withColumn("salt", F.pmod("key", F.lit(SALTS))), tests.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["h", "salt"]
    matches = train.join(tests, on).select("key", "no", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    matches = matches.groupBy("key", "no").agg(F.collect_list("diagonal").alias("diagonals"))
    texts = items.select("no", "item", F.encode("item_text", "utf-8").alias("item_text"))
    found = matches.join(texts, "no").groupBy("key").agg(F.collect_list(F.struct("item", "item_text", "diagonals")).alias("found"))
    joined = docs.join(found, F.col("key_") == F.col("key"), "left").select("id_", "text_", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text_"):
            counts = Words(texts, ALNUM, lower=True).counts()
            n_hit, spans, items = [], [], []
            for text, found in zip(texts, batch.column("found").to_pylist()):
                hit, names = _hits(_word_list(text), found, window) if found else (np.zeros(0, dtype=bool), ())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                n_hit.append(int(hit.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                items.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id_"), pa.array(counts.astype(np.int64)), pa.array(n_hit, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                names=[id_col, "n_words", "n_hit", "spans", "items"],
            )

    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    return joined.mapInArrow(run, schema)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the word ranges ``spans`` (as ``decontaminate`` gives them).

    Words and what stands between them alternate; a range goes with the gaps inside it.
    """
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    words = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    gaps = F.split(text, word, -1)
    # position i is covered if the last range that starts at or before it has not ended
    def covered(i: Column) -> Column:
        return F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"]))

    def inside(i: Column) -> Column:
        return F.exists(spans, lambda s: (s["start"] < i) & (i < s["end"]))

    kept = F.transform(F.arrays_zip(gaps.alias("gap"), words.alias("word")), lambda x, i: F.concat(
        F.when(inside(i), F.lit("")).otherwise(x["gap"]), F.when(covered(i), F.lit("")).otherwise(F.coalesce(x["word"], F.lit("")))
    ))
    return F.array_join(kept, "")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query: the operator over all documents and benchmark items, digested."""
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same by windows spelled out as text, for DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
