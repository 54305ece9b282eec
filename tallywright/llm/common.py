"""Helpers shared by the training-data operators: scratch tables, Arrow batches, hashed words."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bytes of text handled at once inside a task; bounds a worker's arrays.
CHUNK_BYTES = 4 << 20


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage: whatever executor is lost later, the table stays.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def text_chunks(
    batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about ``limit`` bytes of text, with the texts as UTF-8.

    Null texts are empty. A text longer than ``limit`` is a slice of its own, whole.
    """
    for batch in batches:
        texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of letters, digits and all beyond ASCII, after A-Z became a-z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: Words between ASCII white space.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_U = np.uint64
_Q = _U(0xD6E8FEB86659FD93)
_Q_INV = _U(pow(int(_Q), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, for bases are few and chunks alike."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=_U)
        out[0] = 1
        have = np.cumprod(out, dtype=_U)
        if n <= 4 * CHUNK_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that their minimum is unbiased."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _spans_hash(values: np.ndarray, starts, ends, base, inverse) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for every span, from one running sum."""
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * powers(base, len(values)), dtype=_U, out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts]


#: Masks that keep the first n of eight bytes.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)


class Words:
    """The words of a chunk of texts, as positions in one buffer.

    ``first[i]:first[i + 1]`` are the words of text i. All texts are joined by a blank,
    which no word class holds, so words never cross texts.
    """

    def __init__(self, texts: list[bytes], word_class: np.ndarray, lower: bool):
        raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self.buffer = LOWER[raw] if lower else raw
        inside = np.zeros(len(raw) + 1, dtype=np.int8)
        inside[1:] = word_class[self.buffer]
        step = np.diff(inside)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.first = np.searchsorted(self.starts, at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of every word, from its length and its bytes eight at a time; other seeds give independent ones.

        Every step is a scrambling, so no texts share their hashes by their form, as all texts
        of some patterns do under polynomials modulo a power of two.
        """
        lengths = self.ends - self.starts
        padded = np.concatenate([self.buffer, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded.data, strides=(1,))
        h = mix((lengths.astype(_U) << _U(8)) ^ mix(np.array([seed + 1], dtype=_U)))
        h = mix(h ^ (eight[self.starts] & _FIRST_BYTES[np.minimum(lengths, 8)]))
        at, longer = 8, np.flatnonzero(lengths > 8)
        while len(longer):
            left = lengths[longer] - at
            h[longer] = mix(h[longer] ^ (eight[self.starts[longer] + at] & _FIRST_BYTES[np.minimum(left, 8)]))
            at, longer = at + 8, longer[left > 8]
        return h

    def gram_hashes(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every run of k words that stays inside one text."""
        starts = gram_starts(self.first, k)
        return starts, mix(_spans_hash(words, starts, starts + k, _Q, _Q_INV) ^ _U(k))


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Where runs of k words start, given the first word of each text (and the end)."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, dtype=np.int64)
    fits = np.ones(n + 1, dtype=bool)
    for back in range(k - 1):
        ends = first[1:] - 1 - back
        fits[ends[ends >= first[:-1]]] = False
    return np.flatnonzero(fits[:n])


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs Spark has."""
    return h.view(np.int64)


def same(a: str, b: str):
    """Null-safe equality of two aliased columns, for joins whose keys may be null."""
    return F.col(a).eqNullSafe(F.col(b))


def chunked(items: Iterable, n: int) -> Iterator[list]:
    it = iter(items)
    while part := list(itertools.islice(it, n)):
        yield part
