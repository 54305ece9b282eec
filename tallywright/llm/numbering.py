"""Texts as numbers of their units, with the units of a run of texts, a chunk, numbered apart.

One pass over texts makes cells of both kinds. Units are looked up by themselves, each distinct
one once, and what was found comes back to its chunks packed.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct words, and words in all, that a chunk of texts holds before the next begins.
DISTINCT_WORDS, CHUNK_WORDS = 3 << 17, 1 << 22
#: Units of a cell.
ROWS = 1 << 15


class Numbering:
    """The distinct words and units of a run of texts, numbered as they come; a text is its units' numbers."""

    def __init__(self):
        self.start()

    def start(self) -> None:
        self.words: dict[str, int] = defaultdict(itertools.count().__next__)
        self.text = array("i")
        self.ends = [0]

    def add(self, text: str) -> None:
        self.text.extend(self.number(text))
        self.ends.append(len(self.text))

    def distinct(self) -> int:
        return len(self.words)

    def number(self, text: str) -> Iterable[int]:
        """The numbers of the words of a text."""
        raise NotImplementedError

    def cut(self) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """(distinct units, the places among them of the units of all words by number, units of each word)."""
        raise NotImplementedError

    def finish(self, sizes: list[int]) -> tuple[pa.StringArray, list[tuple[np.ndarray, np.ndarray]]]:
        """Distinct units by number, frequent ones first; of each run of so many texts (units of each, numbers of units)."""
        units, numbers, count = self.cut()
        first, words = np.cumsum(count) - count, np.frombuffer(self.text, np.int32)
        n = np.bincount(words, minlength=len(count))
        order = np.argsort(-np.bincount(numbers, np.repeat(n, count), len(units)), kind="stable")
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        numbers, out, at = place[numbers], [], 0
        for size in sizes:
            ends = np.array(self.ends[at:at + size + 1])
            some = words[ends[0]:ends[-1]]
            of_texts = np.diff(np.append(0, np.cumsum(count[some]))[ends - ends[0]])
            out.append((of_texts, numbers[spread(first[some], count[some])]))
            at += size
        return units.take(pa.array(order)), out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run of so many, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit integers, compressed byte by byte of all."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


TEXTS, UNITS = 0, 1


def number_texts(docs: DataFrame, numberings: Callable[[], Numbering], id_col: str, text_col: str, head: int) -> DataFrame:
    """(chunk, cell): texts as numbers of units, and the numbered units, in one pass over ``docs``.

    A worker numbers the distinct units of the texts that it reads, a chunk, until they have
    ``head`` distinct words or ``CHUNK_WORDS`` words in all. A cell is pickled: (TEXTS, type and
    ids of the rows in Arrow's format, units of each, numbers) or (UNITS, first number, bytes of each,
    text). A chunk's name depends on all it holds, so cells of unlike runs never meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering, partition = numberings(), TaskContext.get().partitionId()
        chunks, held = itertools.count(), []

        def flush() -> Iterator[pa.RecordBatch]:
            units, texts = numbering.finish(list(map(len, held)))
            numbering.start()
            cells = []
            for ids, (of_texts, numbers) in zip(held, texts):
                rows = pa.RecordBatch.from_arrays([ids], names=["id"])
                cells.append(pickle.dumps((TEXTS, rows.schema.serialize().to_pybytes(), zstandard.compress(rows.serialize(), 1), packed(of_texts), packed(numbers))))
            held.clear()
            for i in range(0, len(units), ROWS):
                some = units.slice(i, ROWS).to_pylist()
                octets = [u.encode() for u in some]
                cells.append(pickle.dumps((UNITS, i, packed(np.array([len(u) for u in octets])), zstandard.compress(b"".join(octets), 1))))
            whole = hashlib.sha256(b"%d:%d:" % (partition, next(chunks)))
            for cell in cells:
                whole.update(cell)
            name = int.from_bytes(whole.digest()[:8], "big", signed=True)
            for i in range(0, len(cells), 16):
                some = cells[i:i + 16]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.int64()), pa.array(some, pa.binary())], names=["chunk", "cell"])
            # workers stay for later stages, what Arrow has freed need not
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for some in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                for text in some.column("text").to_pylist():
                    numbering.add(text or "")
                held.append(some.column("id"))
                if numbering.distinct() >= head or len(numbering.text) >= CHUNK_WORDS:
                    yield from flush()
        yield from flush()

    schema = T.StructType([T.StructField("chunk", T.LongType(), False), T.StructField("cell", T.BinaryType(), False)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def units_of(cell: tuple) -> tuple[int, list[str]]:
    """(first number, units) of a cell of units."""
    _, first, sizes, data = cell
    at, octets = np.cumsum(np.append(0, unpacked(sizes))).tolist(), zstandard.decompress(data)
    return first, [octets[a:b].decode() for a, b in itertools.pairwise(at)]


def units_to_look_up(cells: DataFrame, partitions: int, longest: int | None = None) -> DataFrame:
    """(unit, in_chunk, local) of the units in cells, dealt by unit; longer ones than ``longest`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("cell").to_pylist()):
                cell = pickle.loads(data)
                if cell[0] != UNITS:
                    continue
                first, units = units_of(cell)
                local = np.array([first + i for i, u in enumerate(units) if longest is None or len(u) <= longest], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([units[i - first] for i in local.tolist()], pa.string()), pa.array(np.full(len(local), chunk, dtype=np.int64)), pa.array(local)],
                    names=["unit", "in_chunk", "local"],
                )

    return cells.mapInArrow(run, T.StructType([
        T.StructField("unit", T.StringType(), False), T.StructField("in_chunk", T.LongType(), False), T.StructField("local", T.IntegerType(), False),
    ])).repartition(partitions, "unit")


def packed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(in_chunk, part): rows (in_chunk, local, ids) of a batch, packed by chunk."""
    for batch in gathered(batches, 1 << 18):
        chunk, local, ids = batch.column("in_chunk").to_numpy(), batch.column("local").to_numpy(), batch.column("ids")
        order = np.lexsort((local, chunk))
        ids = ids.take(pa.array(order))
        edges, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        chunk, local = chunk[order], local[order]
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        parts = [pickle.dumps((packed(np.diff(local[a:b], prepend=0)), packed(np.diff(edges[a:b + 1])), packed(values[edges[a]:edges[b]]))) for a, b in itertools.pairwise(cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]]), pa.array(parts, pa.binary())], names=["in_chunk", "part"])


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= rows):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
