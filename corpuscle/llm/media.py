"""Telephony audio in media columns: WAV files with mu-law, A-law or IMA ADPCM samples are parsed, expanded
(lookup tables for the companded codecs, numpy across all blocks at once for ADPCM), resampled to twice
their rate and stored as PCM.

Defined cases: a null media value, or one that is no such file, gives nulls in every made column; a file
without samples gives empty PCM; repeated rows give equal results; other columns pass through, but those
named as a made one, which it replaces. In `store_bytes`, null is stored as an empty payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from corpuscle.llm.shared import documents, extended

RATE = 8000
UNIT = 64  # bytes; also an ADPCM block
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
CODECS = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}

# Fixed values of the IMA ADPCM format: quantizer steps and the index change of each 4-bit code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    """The 256 linear values of G.711 mu-law, from its rule."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 256 linear values of G.711 A-law, from its rule."""
    code = np.arange(256) ^ 0x55
    part, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(part == 0, low, (low + 256) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def _move_table() -> np.ndarray:
    """The move of the predictor for each step index and 4-bit code."""
    step, code = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32)


MOVE = _move_table()
NEXT = np.clip(np.arange(len(STEPS))[:, None] + CHANGE[None, :], 0, len(STEPS) - 1).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (rows of bytes, one channel) -> samples, a row for each block. One pass over the
    codes of a block, each step for all blocks at once."""
    n, width = blocks.shape
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    predicted = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, len(STEPS) - 1)
    out[0] = predicted
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        at = (index << 4) + (codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15)
        predicted = np.clip(predicted + MOVE.ravel()[at], -32768, 32767)
        index = NEXT.ravel()[at]
        out[k + 1] = predicted
    return np.ascontiguousarray(out.T)


def wav(codec: int, data: bytes, rate: int = RATE, block: int = UNIT) -> bytes:
    """A RIFF WAVE file of one channel around stored samples."""
    align, bits = (block, 4) if codec == ADPCM else (2, 16) if codec == PCM else (1, 8)
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if codec == ADPCM else b"" if codec == PCM else struct.pack("<H", 0)
    per_second = rate * block // (2 * (block - 4) + 1) if codec == ADPCM else rate * align
    fmt = struct.pack("<HHIIHH", codec, 1, rate, per_second, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[int, int, int, bytes] | None:
    """codec, rate, block size and stored samples of a one-channel WAVE file; None if it is none."""
    if media is None or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"fmt " and size >= 16 and at + 24 <= len(media):
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif media[at : at + 4] == b"data":
            return (fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]) if fmt and fmt[1] == 1 and fmt[0] in CODECS else None
        at += 8 + size + (size & 1)
    return None


def expand(codec: int, block: int, data: list[bytes]) -> list[np.ndarray]:
    """The samples of several payloads of one codec and block size, in one pass. A last ADPCM block that is
    cut off is decoded as far as it goes; one without a whole header and a code has no samples."""
    if codec != ADPCM:
        table = MULAW_TABLE if codec == MULAW else ALAW_TABLE
        return [table[np.frombuffer(x, np.uint8)] for x in data]
    counts = [len(x) // block for x in data]
    rows = np.frombuffer(b"".join(x[: n * block] for x, n in zip(data, counts, strict=True)), np.uint8).reshape(-1, block)
    samples = decode_adpcm(rows)
    ends = np.cumsum(counts)
    found = [samples[e - n : e].ravel() for e, n in zip(ends, counts, strict=True)]
    for i, x in enumerate(data):
        if (rest := len(x) % block) > 4:
            found[i] = np.concatenate((found[i], decode_adpcm(np.frombuffer(x[-rest:], np.uint8).reshape(1, rest)).ravel()))
    return found


def twice(samples: np.ndarray) -> np.ndarray:
    """Resampled to twice the rate: between two samples their mean, after the last the last."""
    out = np.empty(2 * len(samples), np.int16)
    out[::2] = samples
    if len(samples):
        wide = samples.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = samples[-1]
    return out


def features(codec: int, samples: np.ndarray, pcm: bytes) -> str:
    """codec:samples:rms:peak:zero crossings:crc32 of the resampled PCM."""
    wide = samples.astype(np.int64)
    rms = (float(np.dot(wide, wide)) / len(wide)) ** 0.5 if len(wide) else 0.0
    crossings = int(np.count_nonzero((samples[:-1] < 0) != (samples[1:] < 0)))
    return f"{CODECS[codec]}:{len(wide)}:{rms:.3f}:{int(np.abs(wide).max(initial=0))}:{crossings}:{zlib.crc32(pcm):08x}"


def decode_many(media: list[bytes | None]) -> list[tuple | None]:
    """(codec, rate, stored samples, samples, resampled PCM) of each file, decoded by groups of codec."""
    parsed = [parse(x) for x in media]
    out: list[tuple | None] = [None] * len(media)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(parsed):
        if p and (p[0] != ADPCM or p[2] > 4):
            groups.setdefault((p[0], p[2]), []).append(i)
    for (codec, block), places in groups.items():
        for i, samples in zip(places, expand(codec, block, [parsed[i][3] for i in places]), strict=True):
            out[i] = (codec, parsed[i][1], parsed[i][3], samples, twice(samples).astype("<i2").tobytes())
    return out


def with_pcm(df: DataFrame, media: str = "media") -> DataFrame:
    """The rows of df without `media`, with codec, rate (of the PCM), pcm (a 16-bit WAVE file) and feature,
    which take the place of columns of these names."""

    def step(files):
        found = decode_many(files)
        codec, rate = [x and CODECS[x[0]] for x in found], [x and 2 * x[1] for x in found]
        return [codec, rate, [x and wav(PCM, x[4], 2 * x[1]) for x in found], [x and features(x[0], x[3], x[4]) for x in found]]

    return extended(df, step, "codec string, rate int, pcm binary, feature string", media, 1 << 20)


def store_bytes(data: bytes, unit: int = UNIT) -> bytes:
    """Bytes, padded with 0 to a positive multiple of the unit, as the samples of a WAVE file. The number
    of units chooses the codec, so that each of the three has its share."""
    padded = data + b"\0" * (-len(data) % unit or (0 if data else unit))
    return wav((MULAW, ALAW, ADPCM)[len(padded) // unit % 3], padded, block=unit)


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    """Beside the contract's columns the size and digest of the stored PCM file (pcm_bytes, pcm_sha256)."""

    def step(texts):
        media = [store_bytes(x or b"") for x in texts]
        found = decode_many(media)
        payload, pcm = [x[2] for x in found], [wav(PCM, x[4], 2 * x[1]) for x in found]
        hexes = lambda values: [hashlib.sha256(x).hexdigest() for x in values]
        return [
            [len(x or b"") for x in texts], [len(x) for x in payload], hexes(payload), [zlib.crc32(x[-64:]) for x in payload],
            [len(x) for x in media], hexes(media), [features(x[0], x[3], x[4]) for x in found], [len(x) for x in pcm], hexes(pcm),
        ]

    made = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return extended(documents(spark, sf_dir).select("doc_id", "text"), step, made, most=1 << 20)
