"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints within ``DISTANCE`` bits agree on whole 16-bit blocks: of four blocks at
least two. The top nodes of the index are therefore the shared masked patterns of two
blocks each; every distinct fingerprint stands below six of them, and any two linked
fingerprints meet below one. Nodes with more than ``NODE_LIMIT`` fingerprints factor out
two of four sub-blocks of the remaining 32 bits in the same way, which leaves 16 free bits
and so at most 65,536 fingerprints below any node, however hot.

Below a node the fingerprints are sorted by Gray rank, so that neighbours share long bit
patterns. Runs of ``FAN_OUT`` neighbours make a group with a mask of the bits they share;
groups of groups make the levels above. The search descends pairs of groups and adds up
the bits in which their shared patterns differ: once over ``DISTANCE`` the whole pair of
groups is pruned. Each node returns a spanning forest of its links, never all pairs, and
components are then found by alternating star contractions on tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NONSPACE, Words, materialise, signed, text_chunks

DISTANCE = 2
SHINGLE = 3
NODE_LIMIT = 1024
FAN_OUT = 16

_U = np.uint64
#: Every two of the four 16-bit blocks.
TOP_MASKS = [sum(0xFFFF << (16 * b) for b in pair) for pair in combinations(range(4), 2)]


def _sub_masks(mask: int) -> list[int]:
    """Every two of the four 8-bit blocks of the bits that ``mask`` leaves free."""
    free = [b for b in range(8) if not mask >> (8 * b) & 1]
    return [sum(0xFF << (8 * b) for b in pair) for pair in combinations(free, 2)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): 64 bits, each set if set in over half the hashes of the word shingles.

    Words are runs of non-space after A-Z became a-z, shingles are joined by one blank and
    hashed by XXH64 with seed 42; repeats count. Fewer words than a shingle hash as one
    sequence; no words (null, empty, blank) give 0.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch, texts in text_chunks(batches, text_col, 1 << 20):
            words = Words(texts, NONSPACE, lower=True)
            raw, out = words.buffer.tobytes(), np.zeros(len(texts), dtype=_U)
            starts, ends, first = words.starts.tolist(), words.ends.tolist(), words.first.tolist()
            for i in range(len(texts)):
                a, b = first[i], first[i + 1]
                if a == b:
                    continue
                own = b" ".join([raw[s:e] for s, e in zip(starts[a:b], ends[a:b])])
                at, edges = 0, [0]
                for s, e in zip(starts[a:b], ends[a:b]):
                    at += e - s + 1
                    edges.append(at)
                n = max(1, b - a - shingle + 1)
                last = edges[min(shingle, b - a):]
                hashes = np.fromiter((digest(own[s:e - 1], 42) for s, e in zip(edges, last)), dtype=_U, count=n)
                ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(2 * ones > n, bitorder="little").view(_U)[0]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(signed(out))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def gray_rank(fp: Column) -> Column:
    """Position of a 64-bit pattern in Gray order."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared mask, shared pattern) of the groups of each level, leaves first."""
    masks, patterns = np.full(len(fps), ~_U(0)), fps
    levels = [(masks, patterns)]
    while len(patterns) > 1:
        heads = np.arange(0, len(patterns), FAN_OUT)
        both = np.bitwise_and.reduceat(patterns, heads)
        either = np.bitwise_or.reduceat(patterns | ~masks, heads)
        shared = np.bitwise_and.reduceat(masks, heads)
        masks = shared & (both | ~either)
        patterns = both & masks
        levels.append((masks, patterns))
    return levels


def search(fps: np.ndarray, distance: int = DISTANCE, block: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (i < j) of ``fps`` (in Gray order) within ``distance`` bits.

    Descends pairs of groups in blocks of at most ``block``, so memory stays bounded for
    dense nodes as well.
    """
    levels = _levels(fps)[::-1]
    step = np.arange(FAN_OUT)
    root = np.zeros(1, dtype=np.int64)
    stack = [(0, root, root, np.zeros(1, dtype=_U), root)]
    while stack:
        depth, a, b, seen, spent = stack.pop()
        masks, patterns = levels[depth]
        inside = (a < len(patterns)) & (b < len(patterns)) & (a <= b)
        a, b, seen, spent = a[inside], b[inside], seen[inside], spent[inside]
        common = masks[a] & masks[b]
        # only bits that the groups above did not share are counted anew
        spent = spent + np.bitwise_count((patterns[a] ^ patterns[b]) & common & ~seen)
        near = spent <= distance
        a, b, seen, spent = a[near], b[near], common[near], spent[near]
        if depth + 1 == len(levels):
            apart = a < b
            yield a[apart], b[apart]
            continue
        for at in range(0, len(a), block):
            left = a[at:at + block, None, None] * FAN_OUT + step[:, None]
            right = b[at:at + block, None, None] * FAN_OUT + step
            left, right = np.broadcast_arrays(left, right)
            more = FAN_OUT * FAN_OUT
            stack.append((depth + 1, left.ravel(), right.ravel(), np.repeat(seen[at:at + block], more), np.repeat(spent[at:at + block], more)))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep the components of all near pairs: (member, root), one per non-root."""
    label = np.arange(len(fps))
    for a, b in search(fps):
        while (label[a] != label[b]).any():
            high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label = label[label]
    member = np.flatnonzero(label != np.arange(len(fps)))
    return list(zip(member.tolist(), label[member].tolist()))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) links that connect all fingerprints of ``distinct`` (column fp) within two bits."""
    def keyed(df: DataFrame, masks: dict[int, list[int]] | None) -> DataFrame:
        if masks is None:
            below = F.array(*[F.struct(F.lit(i).alias("node"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("pattern")) for i, m in enumerate(TOP_MASKS)])
            return df.select("fp", F.explode(below).alias("n")).select("fp", "n.*")
        choices = F.array(*[
            F.array(*[F.struct(F.lit(i).alias("sub"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("sub_pattern")) for i, m in enumerate(masks[node])])
            for node in sorted(masks)
        ])
        single = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_pattern")))
        below = F.when(F.col("count") > NODE_LIMIT, F.get(choices, F.col("node"))).otherwise(single)
        return df.select("fp", "node", "pattern", F.explode(below).alias("s")).select("fp", "node", "pattern", "s.*")

    nodes = keyed(distinct, None)
    sizes = nodes.groupBy("node", "pattern").count().where(F.col("count") > 1)
    grouped = keyed(nodes.join(sizes, ["node", "pattern"]), {i: _sub_masks(m) for i, m in enumerate(TOP_MASKS)})
    key = ["node", "pattern", "sub", "sub_pattern"]
    dealt = grouped.withColumn("rank", gray_rank(F.col("fp"))).repartition(*key).sortWithinPartitions(*key, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def found(columns: list[np.ndarray], last: bool):
            """Links of the complete groups, and the rows of the one that may go on."""
            n = len(columns[0])
            change = np.zeros(n, dtype=bool)
            for c in columns[:4]:
                change[1:] |= c[1:] != c[:-1]
            edges = np.concatenate([[0], np.flatnonzero(change), [n]])
            out: list[tuple[int, int]] = []
            fps = columns[4].view(_U)
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist() if last else edges[1:-1].tolist()):
                if e - s == 2:
                    if int(np.bitwise_count(fps[s] ^ fps[s + 1])) <= DISTANCE:
                        out.append((s + 1, s))
                elif e - s > 2:
                    out.extend((s + i, s + j) for i, j in forest(fps[s:e]))
            ij = np.array(out, dtype=np.int64).reshape(-1, 2)
            batch = pa.RecordBatch.from_arrays([pa.array(columns[4][ij[:, 0]]), pa.array(columns[4][ij[:, 1]])], names=["a", "b"])
            return batch, None if last else [c[edges[-2]:] for c in columns]

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*key, "fp")]
            columns = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            out, rest = found(columns, last=False)
            yield out
        if rest is not None:
            yield found(rest, last=True)[0]

    return dealt.select(*key, "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest of its component.

    Alternates large-star and small-star contractions, each a minimum per node and a join,
    until the table of links is its own image. Every round is a table in the shared folder.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(oriented(edges), label)
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        edges = materialise(
            oriented(low.select("a", F.col("low").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("low").alias("b")))), label
        )
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id that links of at most two differing bits reach. Null
    and empty texts share fingerprint 0 and link like any other; rows with repeated ids keep
    a row each; a null id is never the smallest unless its component has no other; other
    columns are ignored. Equal fingerprints collapse before any search, so exact copies cost
    one entry in the index.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("low_id"))
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low_id").alias("component_id"))
    labels = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
