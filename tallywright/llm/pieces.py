"""SentencePiece encoding and decoding over a relational lattice.

Texts fall into units at places that no piece of the model spans: before a word's space
mark, and between two characters that stand side by side in no piece. Segmentation never
crosses units, so each distinct unit is segmented once: its substrings up to the longest
piece are exploded, equi-joined to the (broadcast, fixed-size) piece table, and the edges
grouped by unit; a higher-order ``aggregate`` folds the edges to a segmentation.

The fold follows the kind of the model. For unigram models it is Viterbi: the best score
of every prefix. For BPE models, whose scores are merge ranks, Viterbi does not give the
model's own pieces; there the fold is the model's merge rule over the same lattice: the
state is the set of boundaries as bits of a long, and the best edge that joins exactly two
current symbols closes the boundary between them.

Every distinct unit of at most ``LONGEST_UNIT`` characters goes through the lattice, once.
Longer ones, whose boundaries do not fit a long, follow the same rule where their text is read.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunked
from .numbering import DISTINCT_WORDS, TEXTS, Numbering, number_texts, packed_parts, spread, units_of, units_to_look_up, unpacked

SPACE = "▁"
#: Units of more characters do not fit the bits of a long and are merged one by one.
LONGEST_UNIT = 60
#: Words that are cut at once.
CUT = 1 << 15


#: The fold by the model type that a .model file states.
FOLDS = {1: "viterbi", 2: "merge"}


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, message[at:at + size]
        at += size


def model_type(proto: bytes) -> int:
    """The type in a model's trainer spec; unigram where it states none."""
    spec = b"".join(v for n, v in _fields(proto) if n == 2)
    return next((v for n, v in _fields(spec) if n == 3), 1)


@dataclass
class PieceModel:
    """A model's piece table: piece to (id, score), the ids of the 256 bytes, and the fold of its kind."""

    pieces: dict[str, tuple[int, float]]
    bytes: list[int]
    names: list[str] = field(default_factory=list)
    fold: str = "merge"

    def __post_init__(self):
        # equal scores share a rank; the better a score the smaller its rank
        scores = sorted({s for _, s in self.pieces.values()}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        self.ranks = {p: rank[s] for p, (_, s) in self.pieces.items()}
        self.longest = max(map(len, self.pieces), default=1)
        #: a character without a piece costs more than any piece, by as much as in the library
        self.unknown = min(scores, default=0.0) - 10.0
        self.spanned = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}

    @functools.cached_property
    def late(self) -> set[str]:
        """Pieces that are as good as a piece they are merged from, or better.

        Inside a piece the merges are those of the piece by itself, so its own are looked at.
        """
        out = set()
        for piece in self.pieces:
            symbols, done = list(piece), []
            while len(symbols) > 1:
                rank, at = min((self.ranks.get(a + b, len(self.ranks)), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
                if rank == len(self.ranks):
                    break
                symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
                done.append(rank)
            if done[:-1] and done[-1] <= max(done[:-1]):
                out.add(piece)
        return out

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """From a .model file; control and unknown pieces are no part of texts."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [i for i in range(n) if sp.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("a model without byte pieces cannot keep every text")
        usual = {names[i]: (i, sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        kind = model_type(sp.serialized_model_proto())
        if kind not in FOLDS:
            raise ValueError("neither a unigram nor a BPE model")
        return cls(usual, byte_ids, names, FOLDS[kind])


class Units:
    """Cuts texts into words, and words into units."""

    def __init__(self, spanned: set[str]):
        self.pairs = np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in spanned) or [-1], dtype=np.int64)

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text, in order; runs of spaces stay with the word after them, for pieces span them.

        A word after a single space, or at the start, stands without its mark; one after a run
        of spaces, and a run at the end, begins with the marks it takes.
        """
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        out, spaces = [], 1
        for word in text.split(" "):
            if word:
                out.append(word if spaces == 1 else SPACE * spaces + word)
                spaces = 1
            else:
                spaces += 1
        if spaces > 1:
            out.append(SPACE * (spaces - 1))
        return out

    def cut(self, words: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """(units of all words in order, how many each word has) of words as ``words`` gives them."""
        marked = [w if w[0] == SPACE else SPACE + w for w in words]
        text = "".join(marked)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        both = chars[:-1] << 21 | chars[1:]
        joined = self.pairs[np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)] == both
        joined[ends[:-1] - 1] = False
        cuts = np.append(np.flatnonzero(~joined) + 1, len(chars))
        # where characters end in UTF-8
        octets = np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))
        offsets = np.zeros(len(cuts) + 1, dtype=np.int32)
        offsets[1:] = octets[cuts - 1]
        units = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(text.encode()))
        return units, np.diff(np.searchsorted(cuts, ends, side="right"), prepend=0)


def merge(unit: str, model: PieceModel) -> list[str]:
    """The pieces of one unit by the merge rule: best score first, leftmost of equals.

    Short units look for the best pair among all; long ones keep the pairs in a heap.
    """
    symbols, ranks = list(unit), model.ranks
    if len(unit) <= LONGEST_UNIT:
        none = len(ranks)
        rank = ranks.get
        pairs = [rank(both, none) for both in map(add, symbols, symbols[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(symbols[i - 1] + symbols[i], none)
            if i < len(pairs):
                pairs[i] = rank(symbols[i] + symbols[i + 1], none)
        return symbols
    left, right = list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1]
    heap: list[tuple[int, int, int, str]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and (rank := ranks.get(both := symbols[i] + symbols[j])) is not None:
            heapq.heappush(heap, (rank, i, j, both))

    for i in range(len(unit) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if not symbols[i] or not symbols[j] or right[i] != j or symbols[i] + symbols[j] != both:
            continue
        symbols[i], symbols[j] = both, ""
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [s for s in symbols if s]


def viterbi(unit: str, model: PieceModel) -> list[str]:
    """The pieces of one unit on its best-scoring path; of equal paths the one whose last piece starts later."""
    best = [(0.0, 0)]
    for end in range(1, len(unit) + 1):
        options = [(best[end - 1][0] + model.unknown, end - 1)]
        for start in range(max(0, end - model.longest), end):
            known = model.pieces.get(unit[start:end])
            if known is not None:
                options.append((best[start][0] + known[1], start))
        best.append(max(options))
    out, end = [], len(unit)
    while end:
        start = best[end][1]
        out.append(unit[start:end])
        end = start
    return out[::-1]


#: How one unit is segmented, by fold.
SEGMENT = {"merge": merge, "viterbi": viterbi}


def ids_of(pieces: list[str], model: PieceModel) -> list[int]:
    """Ids of pieces; a character that is no piece becomes its bytes."""
    out: list[int] = []
    for p in pieces:
        known = model.pieces.get(p)
        if known is not None:
            out.append(known[0])
        else:
            out.extend(model.bytes[b] for b in p.encode())
    return out


#: An edge is one long: rank, whether it is late, id, size and start, from the high bits on, so
#: that edges sort by rank and then by start. Ids and ranks have 20 bits, size and start 6.
EDGE = "shiftleft(coalesce(rank, {worst}L), 33) | if(late, shiftleft(1L, 32), 0L) | shiftleft(cast(coalesce(id, {nothing}) AS bigint), 12) | shiftleft(size, 6) | start"
NOTHING = (1 << 20) - 1
#: The boundaries at and inside an edge, as bits from its start on.
INSIDE = "(shiftright(bounds, cast(e & 63 AS int)) & (shiftleft(2L, cast(shiftright(e, 6) & 63 AS int)) - 1))"
#: The boundary that an edge over two symbols takes away.
INNER = f"shiftleft({INSIDE} ^ (1L | shiftleft(1L, cast(shiftright(e, 6) & 63 AS int))), cast(e & 63 AS int))"
#: Whether both ends of an edge are boundaries, and so many others stand inside.
FITS = f"(bit_count({INSIDE}) = 2 + {{inside}} AND bit_count({INSIDE} & (1L | shiftleft(1L, cast(shiftright(e, 6) & 63 AS int)))) = 2)"
#: Boundaries after all merges: edges come best rank and then leftmost first, and one that
#: joins exactly two current symbols takes the boundary between them away. Where a unit holds
#: a late edge, one no worse than an edge it is merged from, such as a run of spaces, the
#: first edge that fits is looked for anew after every merge.
MERGE_FOLD = f"""
  if(exists(edges, e -> shiftright(e, 32) & 1 = 1),
    aggregate(sequence(1, length(unit)), shiftleft(1L, length(unit) + 1) - 1, (bounds, i) -> coalesce(
      get(transform(slice(filter(edges, e -> {FITS.format(inside=1)}), 1, 1), e -> bounds & ~{INNER}), 0), bounds)),
    aggregate(edges, shiftleft(1L, length(unit) + 1) - 1, (bounds, e) -> if({FITS.format(inside=1)}, bounds & ~{INNER}, bounds)))
"""
#: Boundaries of the best-scoring path: the fold keeps the best score and last edge of every
#: prefix; a character without a piece costs more than any path of pieces.
VITERBI_FOLD = """
  aggregate(
    reverse(sequence(1, length(unit))), named_struct('bounds', shiftleft(1L, length(unit)), 'at', length(unit), 'best',
      aggregate(sequence(1, length(unit)), array(named_struct('score', 0.0D, 'start', 0)), (best, e) -> concat(best, array(array_max(concat(
        array(named_struct('score', best[e - 1].score + {unknown}, 'start', e - 1)),
        transform(filter(scored, x -> x.start + x.size = e), x -> named_struct('score', best[x.start].score + x.score, 'start', x.start)))))))),
    (acc, e) -> if(e = acc.at, named_struct('bounds', acc.bounds | shiftleft(1L, acc.best[e].start), 'at', acc.best[e].start, 'best', acc.best), acc),
    acc -> acc.bounds)
"""
#: Edges between neighbouring boundaries as start and id, in order.
PATH = f"sort_array(transform(filter(edges, e -> {FITS.format(inside=0)}), e -> shiftleft(e & 63, 20) | (shiftright(e, 12) & {NOTHING})))"
#: Their ids; a character without a piece gives its bytes.
SPELL = """
  if(exists(path, e -> e & {nothing} = {nothing}),
     flatten(transform(path, e -> if(e & {nothing} < {nothing}, array(cast(e & {nothing} AS int)),
       transform(sequence(1, octet_length(substring(unit, cast(shiftright(e, 20) AS int) + 1, 1))), b -> get(array({bytes}), cast(conv(substring(hex(encode(substring(unit, cast(shiftright(e, 20) AS int) + 1, 1), 'utf-8')), 2 * b - 1, 2), 16, 10) AS int)))))),
     transform(path, e -> cast(e & {nothing} AS int)))
"""


def lattice(units: DataFrame, model: PieceModel, fold: str | None = None, key: tuple[str, ...] = ("unit",)) -> DataFrame:
    """Every row of ``units`` (column unit of 1 to ``LONGEST_UNIT`` characters; rows are distinct and other columns stay) with its ids.

    ``fold`` is the model's own if not given: ``merge`` for BPE models and ``viterbi`` for
    unigram ones (of paths with equal scores the one whose last edge starts later). ``key``
    tells rows apart. Units that are dealt by a part of it already, as a grouping leaves them,
    need no shuffle: they stay where they are while their substrings explode.
    """
    spark, fold = units.sparkSession, fold or model.fold
    others = [c for c in units.columns if c != "unit"]
    rest = [F.first(c).alias(c) for c in units.columns if c not in key]
    rows = [(p, i, s, model.ranks[p], p in model.late) for p, (i, s) in model.pieces.items()]
    if max(len(model.ranks), *(r[1] for r in rows)) >= NOTHING:
        raise ValueError("a model with a million pieces or more")
    table = F.broadcast(spark.createDataFrame(rows, "piece string, id int, score double, rank long, late boolean"))
    cut = units.select("unit", *others, F.explode(F.expr("sequence(0, length(unit) - 1)")).alias("start"))
    cut = cut.select("unit", *others, "start", F.explode(F.expr(f"sequence(1, least({model.longest}, length(unit) - start))")).alias("size"))
    edges = cut.withColumn("piece", F.expr("substring(unit, start + 1, size)")).join(table, "piece", "left").where("id is not null or size = 1")
    edge = F.expr(EDGE.format(worst=len(model.ranks), nothing=NOTHING))
    if fold == "merge":
        grouped = edges.select("unit", *others, edge.alias("e")).groupBy(*key).agg(*rest, F.sort_array(F.collect_list("e")).alias("edges"))
        bounds = grouped.withColumn("bounds", F.expr(MERGE_FOLD))
    else:
        scored = F.when(F.col("id").isNotNull(), F.struct("start", "size", "score"))
        grouped = edges.select("unit", *others, edge.alias("e"), scored.alias("s")).groupBy(*key).agg(*rest, F.collect_list("e").alias("edges"), F.collect_list("s").alias("scored"))
        bounds = grouped.withColumn("bounds", F.expr(VITERBI_FOLD.format(unknown=f"({model.unknown!r}D)")))
    path = bounds.withColumn("path", F.expr(PATH))
    return path.select("unit", *others, F.expr(SPELL.format(nothing=NOTHING, bytes=", ".join(map(str, model.bytes)))).alias("ids"))


def _small_tasks(spark: SparkSession) -> int:
    """Partitions for the lattice: what a task holds of it is many times its units."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


class UnitNumbering(Numbering):
    def __init__(self, spanned: set[str]):
        self.cutter = Units(spanned)
        super().__init__()

    def number(self, text: str) -> Iterable[int]:
        return map(self.words.__getitem__, self.cutter.words(text))

    def cut(self) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        cuts = [self.cutter.cut(words) for words in chunked(self.words, CUT)]
        units = pa.concat_arrays([pa.array([], pa.string()), *(u for u, _ in cuts)]).dictionary_encode()
        return units.dictionary, units.indices.to_numpy(), np.concatenate([np.zeros(0, np.int64), *(n for _, n in cuts)])


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", head: int = DISTINCT_WORDS) -> DataFrame:
    """(id, ids): the piece ids of every row of ``docs``, as the library gives them for a model of its kind.

    Null and empty texts have no ids; repeated and null ids keep a row each; other columns
    are ignored. Words and units of any length are whole. Texts are cut once, into numbers of
    units by chunk (``head`` as in ``number_texts``). Every distinct unit goes through the
    lattice once and joins the chunks that hold it, where its ids take the place of its number.
    """
    spark: SparkSession = docs.sparkSession
    # the readers of each of these two ask for the same columns without nulls, and so share one shuffle
    cells = number_texts(docs, functools.partial(UnitNumbering, model.spanned), id_col, text_col, head).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    places = units_to_look_up(cells, _small_tasks(spark), LONGEST_UNIT)
    distinct = places.groupBy("unit").agg(F.min("in_chunk").alias("least_chunk"), F.min("local").alias("least"))
    found = places.join(lattice(distinct, model), "unit").where("least_chunk <= in_chunk and least <= local").select("in_chunk", "local", "ids")
    parts = found.mapInArrow(packed_parts, "in_chunk long, part binary")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow, segment, shared = to_arrow_schema(schema), SEGMENT[model.fold], spark.sparkContext.broadcast(model)

    def filled(own: pa.Table, found: pa.Table) -> pa.Table:
        texts, lists, local, sizes = [], [], [], []
        n = 0
        for cell in map(pickle.loads, own.column("cell").to_pylist()):
            if cell[0] == TEXTS:
                texts.append(cell[1:])
                continue
            first, units = units_of(cell)
            n += len(units)
            for i, unit in enumerate(units, first):
                if len(unit) > LONGEST_UNIT:
                    lists.append(np.array(ids_of(segment(unit, shared.value), shared.value), dtype=np.int32))
                    local.append([i])
                    sizes.append([len(lists[-1])])
        for steps, lengths, ids in map(pickle.loads, found.column("part").to_pylist()):
            local.append(np.cumsum(unpacked(steps)))
            sizes.append(unpacked(lengths))
            lists.append(unpacked(ids))
        pa.default_memory_pool().release_unused()
        nothing = [np.zeros(0, dtype=np.int64)]
        at, length, values = np.concatenate(nothing + local), np.concatenate(nothing + sizes), np.concatenate([np.zeros(0, np.int32), *lists])
        if len(at) != n or not np.array_equal(np.sort(at), np.arange(n)):
            raise ValueError("a unit of a chunk has no ids, or more than once")
        starts, counts = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        starts[at], counts[at] = np.cumsum(length) - length, length
        out = []
        for kind, body, of_texts, numbers in texts:
            rows = pa.ipc.read_record_batch(pa.py_buffer(zstandard.decompress(body)), pa.ipc.read_schema(pa.py_buffer(kind)))
            flat = unpacked(numbers)
            edges = np.append(0, np.cumsum(counts[flat]))[np.append(0, np.cumsum(unpacked(of_texts)))]
            ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values[spread(starts[flat], counts[flat])]))
            out.append(pa.RecordBatch.from_arrays([rows.column("id").cast(arrow.field("id").type), ids.cast(arrow.field("ids").type)], schema=arrow))
        return pa.Table.from_batches(out, arrow)

    return cells.groupBy("chunk").cogroup(parts.groupBy("in_chunk")).applyInArrow(filled, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): texts of piece ids. Null ids are empty; bytes that are no UTF-8 read as U+FFFD."""
    kind = encoded.schema[id_col].dataType
    value = {i: p.replace(SPACE, " ").encode() for p, (i, _) in model.pieces.items()} | {i: bytes([b]) for b, i in enumerate(model.bytes)}
    most = max(value) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids that are no piece, negative ones included, have no bytes
        table = pa.array([value.get(i, b"") for i in range(most)] + [b""], pa.large_binary())
        for batch in batches:
            for some in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                lists = some.column(ids_col)
                edges = np.cumsum([0, *pc.list_value_length(lists).fill_null(0).to_pylist()])
                own = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                spelled = table.take(pa.array(np.where((own < 0) | (own > most), most, own)))
                # the bytes of all pieces stand one after the other, so a text is a slice of them
                at = np.cumsum(np.append(0, pc.binary_length(spelled).to_numpy()))[edges].tolist()
                octets = b"" if not at[-1] else spelled.buffers()[2].to_pybytes()
                texts = [octets[a:b].decode(errors="replace") for a, b in itertools.pairwise(at)]
                yield pa.RecordBatch.from_arrays([some.column(id_col), pa.array([t.removeprefix(" ") for t in texts], pa.string())], names=["id", "text"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType())])
    return encoded.select(id_col, ids_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def default_model() -> PieceModel:
    import public_tokenizers

    return PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: pieces, digests, and whether the text came back.

    A text that holds the space mark itself comes back with a blank in its place.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = default_model()
    keyed = docs.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sum")).alias("key"), "text")
    encoded = encode(keyed, model, "key")
    digested = encoded.select(
        F.struct("key.doc_id", "key.n_bytes", "key.sum", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")).alias("key"), "ids",
    )
    return decode(digested, model, "key").select("key.doc_id", "key.n_bytes", "key.n_pieces", "key.ids_sha256", (F.sha2("text", 256) == F.col("key.sum")).alias("round_trip"))
