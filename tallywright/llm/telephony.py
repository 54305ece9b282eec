"""Telephony audio: G.711 and IMA ADPCM payloads in WAV, expanded to resampled PCM.

mu-law and A-law bytes expand through 256-entry lookup tables built from the companding
rules; ADPCM blocks are decoded one nibble at a time across all blocks of a chunk at once.
Arithmetic is in integers throughout, so equal bytes give equal samples everywhere.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_chunks

RATE = 8_000
TARGET_RATE = 16_000
#: Bytes of an ADPCM block: a header of four and 120 samples in 60.
BLOCK = 64
#: WAV format codes.
FORMATS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}

# Fixed values of the IMA ADPCM format: step sizes, and the change of step by code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law bytes."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples of the 256 A-law bytes."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    magnitude = np.where(segment == 0, low + 8, low + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x 2 * (size - 4) + 1) of IMA ADPCM blocks (blocks x size, uint8).

    A step index beyond the table, which no encoder writes, is taken as the last.
    """
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), dtype=np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(size - 4):
        for j, code in enumerate((codes[i] & 0x0F, codes[i] >> 4)):
            step = STEPS[index]
            change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
            index = np.clip(index + CHANGES[code & 7], 0, len(STEPS) - 1)
            out[2 * i + j + 1] = value
    return out.T


def encode_adpcm(pcm: np.ndarray, size: int = BLOCK) -> bytes:
    """IMA ADPCM blocks of 16-bit samples (padded with the last sample); blocks start afresh."""
    per = 2 * (size - 4) + 1
    short = -len(pcm) % per or (per if not len(pcm) else 0)
    pcm = np.pad(pcm.astype(np.int32), (0, short), mode="edge" if len(pcm) else "constant").reshape(-1, per)
    value, index = pcm[:, 0].copy(), np.zeros(len(pcm), dtype=np.int32)
    blocks = np.zeros((len(pcm), size), dtype=np.uint8)
    blocks[:, :2] = value.astype("<i2").view(np.uint8).reshape(-1, 2)
    for i in range(1, per):
        step, delta = STEPS[index], pcm[:, i] - value
        code = np.where(delta < 0, 8, 0)
        rest, change = np.abs(delta), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = rest >= part
            code = code | np.where(take, bit, 0)
            rest, change = rest - np.where(take, part, 0), change + np.where(take, part, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + CHANGES[code & 7], 0, len(STEPS) - 1)
        blocks[:, 4 + (i - 1) // 2] |= (code << (4 * ((i - 1) % 2))).astype(np.uint8)
    return blocks.tobytes()


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in integers; the last sample is held."""
    n = len(pcm) * target // rate
    at = np.arange(n, dtype=np.int64) * rate
    left = at // target
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return ((wide[left] * (target - at % target) + wide[right] * (at % target)) // target).astype(np.int16)


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """``resample`` to twice the rate, along the last axis."""
    out = np.empty((*pcm.shape[:-1], 2 * pcm.shape[-1]), dtype=np.int16)
    out[..., ::2] = pcm
    wide = pcm.astype(np.int32)
    out[..., 1:-1:2] = (wide[..., :-1] + wide[..., 1:]) >> 1
    out[..., -1] = pcm[..., -1]
    return out


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file that holds ``payload`` as it is."""
    adpcm = codec == "adpcm"
    align, bits = (BLOCK, 4) if adpcm else (1, 8)
    per = 2 * (BLOCK - 4) + 1
    samples = len(payload) // BLOCK * per if adpcm else len(payload)
    extra = struct.pack("<H", per) if adpcm else b""
    fmt = struct.pack("<HHIIHHH", FORMATS[codec], 1, rate, rate * align // per if adpcm else rate, align, bits, len(extra)) + extra
    chunks = b"".join(struct.pack("<4sI", k, len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse_wav(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, payload) of a WAV file written by ``wav`` or alike."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, code, rate = 12, None, 0
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            codec = next((k for k, v in FORMATS.items() if v == code), None)
            if codec is None:
                raise ValueError(f"format {code} is not telephony audio")
            return codec, rate, media[at + 8:at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def expand(payload: bytes, codec: str) -> np.ndarray:
    """16-bit samples of one payload; ADPCM payloads are whole blocks."""
    raw = np.frombuffer(payload, dtype=np.uint8)
    if codec == "adpcm":
        return decode_adpcm(raw.reshape(-1, BLOCK)).ravel()
    return (mulaw_table() if codec == "mulaw" else alaw_table())[raw]


def store(df: DataFrame, codec: str = "mulaw", id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """(id, media): every binary payload as a WAV file, written to a shared table and read back.

    A null payload is null media. G.711 keeps any byte; ADPCM asks for whole blocks.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                media = [None if p is None else wav(p, codec) for p in part.column(payload_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(media, pa.binary())], names=["id", "media"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("media", T.BinaryType())])
    return materialise(df.select(id_col, payload_col).mapInArrow(run, schema), "telephony", compression="zstd").withColumnRenamed("id", id_col)


def decode(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", rate: int = TARGET_RATE) -> DataFrame:
    """(id, codec, rate, pcm): stored WAV files as little-endian 16-bit PCM at ``rate``.

    Write the result to keep the PCM. Null media give null columns.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, codec, pcm = batch.slice(i, 1), None, None
                if (file := part.column(media_col)[0].as_py()) is not None:
                    codec, own, payload = parse_wav(file)
                    pcm = resample(expand(payload, codec), own, rate).astype("<i2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array([codec], pa.string()), pa.array([rate if codec else None], pa.int32()), pa.array([pcm], pa.binary())], names=["id", "codec", "rate", "pcm"]
                )

    schema = T.StructType([T.StructField("id", media.schema[id_col].dataType), T.StructField("codec", T.StringType()), T.StructField("rate", T.IntegerType()), T.StructField("pcm", T.BinaryType())])
    return media.select(id_col, media_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _summary(codec: str, pcm: np.ndarray) -> str:
    """Samples, peak, mean square, sign changes, and CRC-32 of the PCM at twice the rate."""
    wide = pcm.astype(np.int64)
    signs = pcm < 0
    return f"{codec}:{len(pcm)}:{int(np.abs(wide).max())}:{int((wide * wide).sum() // len(pcm))}:{int((signs[1:] != signs[:-1]).sum())}:{zlib.crc32(double_rate(pcm).astype('<i2').tobytes()):08x}"


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Digests of stored media and features of their samples, whichever codec reads them.

    Every payload, a positive multiple of ``BLOCK`` bytes, is read as mu-law, as A-law and as
    ADPCM blocks; the blocks of many files are decoded together.
    """
    kind = media.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mulaw, alaw = mulaw_table(), alaw_table()
        for batch, files in text_chunks(batches, media_col, 1 << 20):
            payloads = [parse_wav(f)[2] for f in files]
            raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
            blocks = decode_adpcm(raw.reshape(-1, BLOCK))
            at, rows = 0, []
            for file, payload in zip(files, payloads):
                own = raw[at:at + len(payload)]
                text = ";".join((_summary("mulaw", mulaw[own]), _summary("alaw", alaw[own]), _summary("adpcm", blocks[at // BLOCK:(at + len(payload)) // BLOCK].ravel())))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), text))
                at += len(payload)
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))],
                names=["id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    names = (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, t) for n, t in names)])
    return media.select(id_col, media_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def text_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload): texts as UTF-8, padded by zero bytes to whole blocks.

    The payload ends with its padding, so the unpadded length cannot be read from it; it is
    kept beside it. Null texts are empty: one block of zeros.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    n = F.octet_length(raw)
    padding = F.when(n == 0, F.lit(BLOCK)).otherwise(F.pmod(-n, F.lit(BLOCK)))
    zeros = F.unhex(F.repeat(F.lit("00"), padding.cast("int")))
    return docs.select(F.col(id_col), n.cast("long").alias("n_bytes"), F.concat(raw, zeros).alias("payload"))


def op2_telephony(spark, sf_dir: str) -> DataFrame:
    """Contract query: all texts stored as mu-law WAV, read back and digested."""
    payloads = text_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.struct("doc_id", "n_bytes").alias("key"), "payload")
    out = features(store(payloads, "mulaw", "key"), "key")
    return out.select("key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
