"""Token counts without token ids.

Texts fall into pre-tokens, which tokens never cross. Every distinct pre-token is encoded
once by the library, for its number of pieces; the pre-tokens of the documents join those
numbers, and they are summed. Texts are cut once: what is shuffled are numbers of pre-tokens,
and the distinct pre-tokens of a run of texts.
"""

from __future__ import annotations

import functools
import itertools
import json
import pickle
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunked
from .numbering import DISTINCT_WORDS, TEXTS, UNITS, Numbering, number_texts, packed_parts, units_to_look_up, unpacked

LIMIT = 1024
# Fixed value: the pattern by which byte-level pre-tokenizers cut.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PreTokens:
    """Pre-tokens of whole texts, by the library's own pre-tokenizer and added tokens.

    A text in which every space stands alone may be cut before every blank and line end,
    for a pre-token that holds a blank begins with it; the stretches repeat and are
    numbered. Other texts go through the pre-tokenizer whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(definition)
        added = spec.get("added_tokens") or []
        if spec.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("only tokenizers without a normalizer and with plain added tokens are cut into pre-tokens")
        longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.spaces = re.compile(r"\s\s")
        # Latin letters have been the same letters in every version of Unicode, so for them
        # the pattern of the byte-level pre-tokenizer need not be the library's own copy
        plain = spec.get("pre_tokenizer") or {}
        self.latin = regex.compile(BYTE_LEVEL).findall if plain.get("type") == "ByteLevel" and plain.get("use_regex", True) and not plain["add_prefix_space"] else None

    def _cut(self, text: str) -> list[str]:
        if self.latin is not None and max(text) < "\u0250":
            return self.latin(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _stretch(self, stretch: str) -> list[str]:
        """Pre-tokens of what follows a blank, or of a line's begin with the line end before it."""
        lead, body, head = ("", stretch[1:], ["\n"]) if stretch[0] == "\n" else (" ", stretch, [])
        if not body:
            return head
        core = body.rstrip(".,;:!?")
        if self.latin is not None and core.isalpha() and max(core) < "\u0250":
            return [*head, lead + core, body[len(core):]] if len(core) < len(body) else [*head, lead + core]
        return [*head, *self._cut(lead + body)]

    def numbers(self, text: str, stretches: dict[str, int], direct: dict[str, int]) -> Iterator[int]:
        """Numbers of a text's stretches that follow a blank, and of its other pre-tokens."""
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                yield direct[part]
            elif not part:
                continue
            elif part[0].isspace() or part[-1].isspace() or self.spaces.search(part):
                yield from map(direct.__getitem__, self._cut(part))
            else:
                # every space stands alone between others: a line end is a pre-token, a blank begins one
                first, *rest = part.replace("\n", " \n").split(" ")
                yield from map(direct.__getitem__, self._cut(first))
                yield from map(stretches.__getitem__, rest)

    def stretch(self, stretch: str) -> list[str]:
        if self.latin is not None and stretch.isascii() and stretch.isalpha():
            return [" " + stretch]
        return self._stretch(stretch)

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]


@functools.lru_cache(maxsize=1)
def _pretokens(definition: str) -> PreTokens:
    """One a worker process, whatever tasks it runs."""
    return PreTokens(definition)


class PreTokenNumbering(Numbering):
    """Stretches and pre-tokens that stand by themselves share one row of numbers."""

    def __init__(self, definition: str):
        self.cutter = _pretokens(definition)
        super().__init__()

    def start(self) -> None:
        super().start()
        self.direct: dict[str, int] = defaultdict(self.words.default_factory)

    def distinct(self) -> int:
        return len(self.words) + len(self.direct)

    def number(self, text: str) -> Iterable[int]:
        return self.cutter.numbers(text, self.words, self.direct)

    def cut(self) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        pretokens: dict[str, int] = defaultdict(itertools.count().__next__)
        count, parts = np.zeros(self.distinct(), dtype=np.int64), [b""] * self.distinct()
        for stretch, i in self.words.items():
            own = [pretokens[p] for p in self.cutter.stretch(stretch)]
            count[i], parts[i] = len(own), array("i", own).tobytes()
        for pretoken, i in self.direct.items():
            count[i], parts[i] = 1, array("i", [pretokens[pretoken]]).tobytes()
        return pa.array(list(pretokens), pa.string()), np.frombuffer(b"".join(parts), np.int32), count


def count_tokens(
    docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, head: int = DISTINCT_WORDS
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``definition`` is the JSON of a tokenizers file. Null texts are empty and have no
    tokens; rows with repeated or null ids are counted apart; other columns are ignored.
    A worker's chunk of texts ends at ``head`` distinct stretches (see ``number_texts``).
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    texts = docs.select(F.struct(F.col(id_col).alias("id"), n_bytes.alias("n_bytes")).alias("id"), F.col(text_col).alias("text"))
    # both readers ask for the same columns, and so share one shuffle
    cells = number_texts(texts, functools.partial(PreTokenNumbering, definition), "id", "text", head).repartition(partitions, "chunk")
    places = units_to_look_up(cells, partitions).sortWithinPartitions("unit")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(in_chunk, local, ids): the number of pieces; rows of a pre-token follow each other, and it is encoded once."""
        cutter, last = _pretokens(definition), {}
        for batch in batches:
            coded = batch.column("unit").dictionary_encode()
            names = coded.dictionary.to_pylist()
            fresh = [n for n in names if n not in last]
            last |= zip(fresh, itertools.chain.from_iterable(map(cutter.pieces, chunked(fresh, 1024))))
            pieces = np.array([last[n] for n in names], dtype=np.int32)[coded.indices.to_numpy()]
            last = {names[-1]: last[names[-1]]} if names else last
            ids = pa.ListArray.from_arrays(pa.array(np.arange(len(pieces) + 1, dtype=np.int32)), pa.array(pieces))
            yield pa.RecordBatch.from_arrays([batch.column("in_chunk"), batch.column("local"), ids], names=["in_chunk", "local", "ids"])

    parts = places.mapInArrow(lambda batches: packed_parts(counted(batches)), "in_chunk long, part binary")
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("n_tokens", T.LongType())])
    arrow = to_arrow_schema(schema)

    def summed(own: pa.Table, found: pa.Table) -> pa.Table:
        cells = list(map(pickle.loads, own.column("cell").to_pylist()))
        n = sum(len(unpacked(cell[2])) for cell in cells if cell[0] == UNITS)
        parts = [(np.cumsum(unpacked(steps)), unpacked(pieces)) for steps, _, pieces in map(pickle.loads, found.column("part").to_pylist())]
        at = np.concatenate([np.zeros(0, dtype=np.int64), *(a for a, _ in parts)])
        if len(at) != n or not np.array_equal(np.sort(at), np.arange(n)):
            raise ValueError("a pre-token without a count, or with more than one")
        pieces, out = np.empty(n, dtype=np.int64), []
        pieces[at] = np.concatenate([np.zeros(0, dtype=np.int64), *(p for _, p in parts)])
        for _, kind, body, of_texts, numbers in (cell for cell in cells if cell[0] == TEXTS):
            rows = pa.ipc.read_record_batch(pa.py_buffer(zstandard.decompress(body)), pa.ipc.read_schema(pa.py_buffer(kind)))
            totals = np.append(0, np.cumsum(pieces[unpacked(numbers)]))[np.append(0, np.cumsum(unpacked(of_texts)))]
            out.append(pa.RecordBatch.from_arrays([rows.column("id").cast(arrow.field("id").type), pa.array(np.diff(totals), pa.int64())], schema=arrow))
        return pa.Table.from_batches(out, arrow)

    sums = cells.groupBy("chunk").cogroup(parts.groupBy("in_chunk")).applyInArrow(summed, schema)
    return sums.select(F.col("id.id").alias(id_col), "id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract query: tokens of every document by byte_bpe_50k.json."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), definition)
