"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded with numpy, resampled to PCM.

``store`` wraps payload bytes losslessly as the sample data of a WAV file (one
byte is one 8-bit sample; for ADPCM a block of 576 bytes is the unit),
``load`` reads such a file back, ``decode`` expands its samples to 16-bit PCM
(companded codecs by lookup tables, ADPCM step by step over all blocks at once)
and ``resample`` brings PCM to another rate.

Nulls: a null text is an empty payload before padding. An empty table gives an
empty result; repeated rows give equal values; extra columns are ignored.
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

from .common import map_arrow, text_batches

RATE, BLOCK = 8000, 576
#: WAVE format tags.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
#: IMA ADPCM index changes by code.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: IMA ADPCM step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: all 256 codes as 16-bit samples."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: all 256 codes as 16-bit samples."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def _nibble_steps() -> tuple[np.ndarray, np.ndarray]:
    """For each (step index, code): what is added to the sample, and the next index."""
    index, code = np.arange(89)[:, None], np.arange(16)[None, :]
    step = STEPS[index]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), np.clip(index + INDEX_STEP[code], 0, 88).astype(np.int32).ravel()


_ADD, _NEXT = _nibble_steps()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, mono: (n, size) bytes to (n, 1 + 2 * (size - 4)) samples; one step of all blocks at a time.

    A block starts with its first sample (16 bits, little-endian), its step
    index (clamped to 88) and a spare byte; then two codes a byte, low half first.
    """
    n, size = blocks.shape
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.empty((2 * (size - 4), n), np.uint8)
    body = blocks[:, 4:].T
    codes[0::2], codes[1::2] = body & 15, body >> 4
    out = np.empty((1 + len(codes), n), np.int16)
    out[0] = sample
    for k, code in enumerate(codes, 1):
        at = index * 16 + code
        sample = np.clip(sample + _ADD[at], -32768, 32767)
        index = _NEXT[at]
        out[k] = sample
    return out.T


def store(payload: bytes, codec: str) -> bytes:
    """A WAV file whose data chunk is ``payload``; ADPCM payloads are whole blocks."""
    if codec == "adpcm":
        if len(payload) % BLOCK:
            raise ValueError("an ADPCM payload must be whole blocks")
        per_block = 1 + 2 * (BLOCK - 4)
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * BLOCK // per_block, BLOCK, 4, 2, per_block)
    else:
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
    chunks = [(b"fmt ", fmt), (b"data", payload)]
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def store_pcm(samples: np.ndarray, rate: int) -> bytes:
    """A WAV file of 16-bit PCM."""
    data = samples.astype("<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data


def load(media: bytes) -> tuple[str, bytes]:
    """(codec, payload) of a stored file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    codec, at = None, 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next((k for k, v in TAGS.items() if v == tag), "pcm")
        elif name == b"data" and codec:
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no audio data")


def decode_many(coded: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """16-bit PCM of each (codec, payload); the blocks of all ADPCM payloads are decoded together."""
    adpcm = [x for c, x in coded if c == "adpcm"]
    waves: Iterator[np.ndarray] = iter(())
    if adpcm:
        flat = decode_adpcm(np.frombuffer(b"".join(adpcm), np.uint8).reshape(-1, BLOCK))
        waves = (x.ravel() for x in np.split(flat, np.cumsum([len(x) // BLOCK for x in adpcm])[:-1]))
    return [next(waves) if c == "adpcm" else TABLES[c][np.frombuffer(x, np.uint8)] for c, x in coded]


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    if not len(samples):
        return samples
    at = np.arange(len(samples) * to // rate) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(samples)), samples)).astype(np.int16)


def feature(pcm: np.ndarray, codec: str) -> str:
    """codec, samples, root mean square, peak, zero crossings and crc32 of the PCM."""
    wide = pcm.astype(np.int64)
    rms = float(np.sqrt((wide * wide).sum() / max(1, len(pcm))))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec}:{len(pcm)}:{rms:.3f}:{int(np.abs(wide).max(initial=0))}:{crossings}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def payload_of(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def codec_of(payload: bytes) -> str:
    """The codec that stands for a payload: by its crc32, so equal payloads share it."""
    return sorted(TAGS)[zlib.crc32(payload) % len(TAGS)]


def media_columns(docs: DataFrame, rate: int = 16000, keep_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm_bytes and pcm_sha256 of each text's audio.

    Everything but n_bytes is taken from the stored bytes as they are read back;
    pcm is the WAV file of the PCM at ``rate``, read back for its digest. With
    ``keep_media`` both files are columns too (media, pcm).
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    schema += ", media binary, pcm binary" if keep_media else ""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc_id")
        for at, texts in text_batches(batch, "text"):
            raw = [x.encode("utf-8", "surrogatepass") for x in texts]
            files = [store(p, codec_of(p)) for p in map(payload_of, raw)]
            coded = [load(x) for x in files]
            waves = [resample(x, RATE, rate) for x in decode_many(coded)]
            pcm = [store_pcm(w, rate) for w in waves]
            out = {
                "doc_id": ids.slice(at, len(texts)),
                "n_bytes": [len(x) for x in raw],
                "payload_bytes": [len(p) for _, p in coded],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for _, p in coded],
                "tail_crc32": [zlib.crc32(p[-32:]) for _, p in coded],
                "media_bytes": [len(x) for x in files],
                "media_sha256": [hashlib.sha256(x).hexdigest() for x in files],
                "feature": [feature(w, c) for w, (c, _) in zip(waves, coded, strict=True)],
                "pcm_bytes": [len(x) for x in pcm],
                "pcm_sha256": [hashlib.sha256(load(x)[1]).hexdigest() for x in pcm],
            }
            if keep_media:
                out |= {"media": files, "pcm": pcm}
            yield out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)
