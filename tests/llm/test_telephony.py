import hashlib
import zlib

import numpy as np
import pytest

from tallywright.llm import telephony as t


def test_tables_hold_the_published_corners():
    mulaw, alaw = t.mulaw_table(), t.alaw_table()
    assert [int(mulaw[c]) for c in (0x00, 0x80, 0x7F, 0xFF, 0x70)] == [-32124, 32124, 0, 0, -120]
    assert [int(alaw[c]) for c in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]
    assert len(set(alaw.tolist())) == 256 and len(set(mulaw.tolist())) == 255


def scalar_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(t.CHANGES[code & 7])))
            out.append(value)
    return out


def test_adpcm_equals_a_scalar_decoder_and_follows_a_tone():
    rng = np.random.default_rng(2)
    blocks = rng.integers(0, 256, (50, 64), dtype=np.uint8)
    assert t.decode_adpcm(blocks).tolist() == [scalar_adpcm(bytes(b)) for b in blocks]
    tone = (8000 * np.sin(np.arange(2420) / 9)).astype(np.int16)
    back = t.expand(t.encode_adpcm(tone), "adpcm")
    assert np.abs(back[40:2420].astype(int) - tone[40:]).mean() < 500


def test_resampling():
    pcm = np.array([0, 10, -4, 3], dtype=np.int16)
    assert t.double_rate(pcm).tolist() == [0, 5, 10, 3, -4, -1, 3, 3] == t.resample(pcm, 8000, 16000).tolist()
    assert t.resample(pcm, 8000, 4000).tolist() == [0, -4]


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_wav_round_trip(codec):
    payload = bytes(range(256)) * 3
    assert t.parse_wav(t.wav(payload, codec)) == (codec, 8000, payload)
    with pytest.raises(ValueError):
        t.parse_wav(b"RIFFxxxxWAVE")


def test_texts_come_back_byte_for_byte(spark):
    texts = [None, "", "a" * 64, "Grüße 漢字", "x" * 65, "y" * 900_000, "Grüße 漢字", "\0" * 3]
    rows = [(i if i != 6 else None, s, 1.5, "m") for i, s in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload double, media string")
    payloads = t.text_payloads(docs)
    stored = t.store(payloads.drop("n_bytes"))
    out = {r["doc_id"]: r for r in t.features(stored).collect()}
    for i, s, *_ in rows:
        raw = (s or "").encode()
        raw += b"\0" * ((-len(raw)) % 64 if raw else 64)
        r = out[i]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert r["media_sha256"] == hashlib.sha256(t.wav(raw, "mulaw")).hexdigest()
    assert out[3]["feature"] == out[None]["feature"]
    assert {r["doc_id"]: r["n_bytes"] for r in payloads.select("doc_id", "n_bytes").collect()}[7] == 3
    pcm = {r["doc_id"]: r for r in t.decode(stored).collect()}
    assert pcm[2]["rate"] == 16000 and len(pcm[2]["pcm"]) == 64 * 2 * 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert t.features(t.store(t.text_payloads(docs))).collect() == []
