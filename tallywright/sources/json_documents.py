"""Large JSON documents, split where their array's elements border.

A document of many gigabytes is one record to a JSON reader and so one task. Here Spark's
text reader cuts it into fragments at closing braces, split by split, and three scans find
the elements: the first takes from every split how its quotes and brackets change the state
(inside a string or not, depth) for either state at its start; running sums over the splits
give each its true start. The second names the arrays and keeps what is cut off at a split's
ends, the third yields the elements that lie within a split. The elements become JSON lines,
which Spark reads like any others, in as many tasks as they need.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path

_SIGN = np.zeros(256, dtype=np.int8)
_SIGN[[ord("{"), ord("[")]] = 1
_SIGN[[ord("}"), ord("]")]] = -1


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): what stands before each closing brace, in order within a split."""
    df = spark.read.option("lineSep", "}").text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.encode("value", "utf-8").alias("value"))


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start, bytes) of neighbouring fragments of one split, their braces put back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values = batch.column(2).to_pylist()
        at = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or starts[i] != starts[at] or files[i] != files[at]:
                yield files[at], starts[at], b"}".join(values[at:i]) + b"}"
                at = i


def _structure(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of quotes that delimit strings, of brackets, and for each bracket the quotes before it."""
    quotes, backslashes = np.flatnonzero(raw == 34), np.flatnonzero(raw == 92)
    if len(backslashes):
        breaks = np.diff(backslashes) != 1
        first, last = backslashes[np.concatenate([[True], breaks])], backslashes[np.concatenate([breaks, [True]])]
        quotes = np.setdiff1d(quotes, last[(last - first) % 2 == 0] + 1, assume_unique=True)  # after an odd run
    brackets = np.flatnonzero(_SIGN[raw])
    return quotes, brackets, np.searchsorted(quotes, brackets)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: its first character, whether it has an odd number of quotes, and the change of depth outside and inside a string."""
    seen: dict[tuple[str, int], list] = {}
    for file, start, text in _stretches(batches):
        raw = np.frombuffer(text, dtype=np.uint8)
        quotes, brackets, before = _structure(raw)
        own = seen.setdefault((file, start), ["", 0, 0, 0])
        if not own[0]:
            own[0] = text.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1")
        for inside in (0, 1):
            own[2 + inside] += int(_SIGN[raw[brackets]][(before + own[1] + inside) % 2 == 0].sum())
        own[1] = (own[1] + len(quotes)) % 2
    rows = [(*k, *v) for k, v in seen.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                     names=["file", "start", "first", "odd", "outside", "inside"])


#: Stands for the array that was open before a split, until the splits are put in order.
BEFORE = "\x00"


@dataclass
class State:
    """What holds where a split begins: inside a string, depth, the element depth of its document, the array it is in."""

    inside: int
    depth: int
    base: int
    key: str | None


class Walk:
    """Elements of one split, stretch by stretch.

    ``key`` is the array that stands open: ``""`` for a root array, null for anything else.
    """

    def __init__(self, state: State):
        self.inside, self.depth, self.base, self.key = state.inside, state.depth, state.base, state.key
        #: bytes of the element that stands open, whether it began in this split, and its array
        self.open: list[bytes] | None = [] if state.depth > state.base else None
        self.began, self.of = False, state.key

    def step(self, text: bytes) -> Iterator[tuple[str | None, bytes, bool]]:
        """(array, element, whether it began in this split) of every element that ends here."""
        raw = np.frombuffer(text, dtype=np.uint8)
        quotes, brackets, before = _structure(raw)
        outside = (before + self.inside) % 2 == 0
        at, before = brackets[outside], before[outside]
        sign = _SIGN[raw[at]].astype(np.int64)
        after = self.depth + np.cumsum(sign)
        char, prior = raw[at], after - sign
        marks = [(int(p), "start") for p in at[(char == 123) & (prior == self.base)]] + [(int(p), "end") for p in at[(char == 125) & (after == self.base)]]
        if self.base == 2:
            held = (sign > 0) & (prior == 1)
            marks += [(int(p), self._name(text, quotes, int(n)) if c == 91 else None) for p, n, c in zip(at[held], before[held], char[held])]
        since = 0 if self.open is not None else None
        for p, what in sorted(marks, key=lambda m: m[0]):
            if what == "start":
                self.open, since, self.began, self.of = [], p, True, self.key
            elif what == "end":
                if since is not None:
                    yield self.of, b"".join([*self.open, text[since:p + 1]]), self.began
                self.open = since = None
            else:
                self.key = None if what is None else what[4:]
        if since is not None:
            self.open.append(text[since:])
        self.inside = (self.inside + len(quotes)) % 2
        self.depth = int(after[-1]) if len(after) else self.depth

    @staticmethod
    def _name(text: bytes, quotes: np.ndarray, n: int) -> str:
        """``key:`` and the name before an opening bracket that ``n`` quotes precede."""
        if n < 2:
            raise ValueError("a top-level name holds a closing brace at the border of two splits")
        return "key:" + json.loads(text[quotes[n - 2]:quotes[n - 1] + 1])


_PARTS = "file string, start long, place int, key string, n long, piece binary, opens boolean, closes boolean"


def _parts(states: dict[tuple[str, int], State]):
    """Of each split: elements per array (place 0), the end of an element that began before (1), the
    begin of one that ends later (2), and the array that is open at its end (3)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[tuple[str, int], tuple[Walk, dict, list]] = {}
        for file, start, text in _stretches(batches):
            if (file, start) not in walks:
                walks[file, start] = (Walk(states[file, start]), {}, [])
            walk, counts, heads = walks[file, start]
            for key, element, began in walk.step(text):
                if began:
                    counts[key] = counts.get(key, 0) + 1
                else:
                    heads.append(element)
        rows = []
        for (file, start), (walk, counts, heads) in walks.items():
            if walk.open is not None:
                if walk.began:
                    counts[walk.of] = counts.get(walk.of, 0) + 1
                rows.append((file, start, 2, walk.of, 0, b"".join(walk.open), walk.began, False))
            rows += [(file, start, 0, key, n, None, False, False) for key, n in counts.items()]
            rows += [(file, start, 1, None, 0, piece, False, True) for piece in heads]
            rows.append((file, start, 3, walk.key, 0, None, False, False))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in _PARTS.split(", ")])

    return run


def _elements(states: dict[tuple[str, int], State], wanted: str):
    """The elements of the wanted array that lie within a split, each on one line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[tuple[str, int], Walk] = {}
        for file, start, text in _stretches(batches):
            walk = walks.get((file, start)) or walks.setdefault((file, start), Walk(states[file, start]))
            lines = [element.translate(_ONE_LINE).decode() for key, element, began in walk.step(text) if began and key == wanted]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return run


#: Line breaks stand only between a document's tokens, never inside its strings.
_ONE_LINE = bytes.maketrans(b"\r\n", b"  ")


def split_document(spark: SparkSession, path: str, to: str) -> str | None:
    """Writes the rows of JSON documents as JSON lines below ``to``; returns the array they were taken from.

    Rows are the objects of a root array (``""``), of the ``data`` array, or of the top-level
    array that holds the most (of equal ones the first by name); other elements, nulls too, are
    left out. Null if no array holds an object: nothing is written then. A row of six numbers a
    split comes to the driver, and no task holds more than a split's elements one by one.
    """
    raw = fragments(spark, path)
    effects = raw.mapInArrow(_effects, "file string, start long, first string, odd int, outside long, inside long").collect()
    states: dict[tuple[str, int], State] = {}
    file, inside, depth, base = None, 0, 0, 0
    for e in sorted(effects, key=lambda e: (e["file"], e["start"])):
        if e["file"] != file:
            file, inside, depth, base = e["file"], 0, 0, 1 if e["first"] == "[" else 2
        states[file, e["start"]] = State(inside, depth, base, "" if base == 1 else BEFORE)
        depth += e["inside"] if inside else e["outside"]
        inside = (inside + e["odd"]) % 2

    folder = scratch_path(spark, "json-parts")
    raw.mapInArrow(_parts(states), _PARTS).write.parquet(folder)
    parts = spark.read.schema(_PARTS).parquet(folder)
    ends = {(r["file"], r["start"]): r["key"] for r in parts.where("place = 3").select("file", "start", "key").collect()}
    file = key = None
    for at in sorted(states):
        if at[0] != file:
            file, key = at[0], states[at].key if states[at].base == 1 else None
        states[at].key = key
        key = key if ends[at] == BEFORE else ends[at]
    sizes: dict[str, int] = {}
    for r in parts.where("place = 0").select("file", "start", "key", "n").collect():
        name = states[r["file"], r["start"]].key if r["key"] == BEFORE else r["key"]
        if name is not None:
            sizes[name] = sizes.get(name, 0) + r["n"]
    if not sizes:
        return None
    wanted = "" if "" in sizes else "data" if "data" in sizes else max(sorted(sizes), key=sizes.get)

    opened = spark.createDataFrame([(*at, s.key) for at, s in states.items()], "file string, start long, before string")
    order = W.partitionBy("file").orderBy("start", "place")
    cut = parts.where(F.col("piece").isNotNull()).join(F.broadcast(opened), ["file", "start"])  # a row a split
    cut = cut.withColumn("number", F.count_if("opens").over(order))
    own = W.partitionBy("file", "number").orderBy("start", "place").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("over", F.coalesce(F.count_if("closes").over(own), F.lit(0)) > 0).where("number > 0 and not over")
    stitched = cut.groupBy("file", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", F.decode("piece", "utf-8").alias("text")))), lambda x: x["text"]), "").alias("value"),
        F.max(F.when(F.col("opens"), F.when(F.col("key") == BEFORE, F.col("before")).otherwise(F.col("key")))).alias("name"), F.max("closes").alias("whole"),
    ).where(F.col("whole") & (F.col("name") == wanted)).select(F.translate("value", "\r\n", "  ").alias("value"))
    raw.mapInArrow(_elements(states, wanted), "value string").unionByName(stitched).write.text(to)
    return wanted
