"""Media columns: telephony audio in WAV containers.

Mu-law and A-law are expanded by lookup tables of 256 entries, IMA ADPCM blocks are decoded with
numpy across all blocks at once, and audio is kept as resampled 16-bit PCM. Stored 8-bit forms are lossless.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, raw_texts, slices, stored

RATE = 8_000
#: WAVE format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
UNIT = 64
#: Samples of a mono ADPCM block of 64 bytes.
ADPCM_SAMPLES = 2 * (64 - 4) + 1
#: Fixed values of IMA ADPCM.
ADPCM_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
ADPCM_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law code to 16-bit PCM."""
    u = ~np.arange(256, dtype=np.int32) & 255
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law code to 16-bit PCM."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = a >> 4 & 7, ((a & 15) << 4) + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM mono blocks, one in each row of uint8, to int16 of 2 * (width - 4) + 1 samples a block.

    A block starts with its first sample (16 bits) and step index (8 bits, taken as at most 88).
    The loop runs over the places in a block; each step handles all blocks.
    """
    n, width = blocks.shape
    out = np.empty((n, 2 * (width - 4) + 1), dtype=np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[:, 0] = value
    nibbles = np.empty((2 * (width - 4), n), dtype=np.uint8)
    nibbles[0::2], nibbles[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    for k, code in enumerate(nibbles, 1):
        step, size = ADPCM_STEPS[index], code & 7
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + ADPCM_INDEX[size], 0, 88)
        out[:, k] = value
    return out


def upsample2(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: between samples a 4-tap half-band value (-1, 9, 9, -1) / 16, ends repeated."""
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def wav(tag: int, data: bytes, rate: int = RATE, bits: int = 8, channels: int = 1) -> bytes:
    """A WAV file; ADPCM blocks are 64 bytes a channel."""
    align = 64 * channels if tag == IMA_ADPCM else bits // 8 * channels
    extra = struct.pack("<HH", 2, ADPCM_SAMPLES) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    per_second = rate * align // ADPCM_SAMPLES if tag == IMA_ADPCM else rate * align
    form = struct.pack("<HHIIHH", tag, channels, rate, per_second, align, 4 if tag == IMA_ADPCM else bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass(frozen=True)
class Wav:
    """What a WAV file says of itself, and its samples' bytes."""

    tag: int
    channels: int
    rate: int
    width: int
    bits: int
    data: bytes


def parse_wav(media: bytes) -> Wav:
    """The parts of a WAV file; ValueError or struct.error where it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and form:
            tag, channels, rate, _, width, bits = form
            if not channels or not rate or not width:
                raise ValueError("no channels, no rate or no block width")
            return Wav(tag, channels, rate, width, bits, media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("the WAV file has no data")


def to_pcm(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, int16 samples, a row a frame and a column a channel) of a WAV file in any of the four formats; a cut-off end is left out."""
    w = parse_wav(media)
    codes = np.frombuffer(w.data, dtype=np.uint8)

    def frames(samples: np.ndarray) -> np.ndarray:
        return samples[: len(samples) // w.channels * w.channels].reshape(-1, w.channels)

    if w.tag == MULAW and w.bits == 8:
        return w.rate, frames(MULAW_PCM[codes])
    if w.tag == ALAW and w.bits == 8:
        return w.rate, frames(ALAW_PCM[codes])
    if w.tag == IMA_ADPCM:
        head = 4 * w.channels
        if w.width < head or w.width % head:
            raise ValueError("an ADPCM block has no whole number of words a channel")
        n = len(codes) // w.width
        # Words of four bytes go to the channels in turn: each channel's own are a mono block.
        own = codes[: n * w.width].reshape(n, -1, w.channels, 4).transpose(0, 2, 1, 3).reshape(n * w.channels, -1)
        return w.rate, decode_adpcm(own).reshape(n, w.channels, -1).transpose(0, 2, 1).reshape(-1, w.channels)
    if w.tag == PCM and w.bits == 16:
        return w.rate, frames(codes[: len(codes) // 2 * 2].view("<i2"))
    if w.tag == PCM and w.bits == 8:
        return w.rate, frames(((codes.astype(np.int16) - 128) << 8).astype(np.int16))
    raise ValueError(f"unknown format {w.tag} with {w.bits} bits")


def resampled(media: bytes) -> bytes:
    """A WAV file of 16-bit PCM at twice the rate, with the same channels."""
    rate, pcm = to_pcm(media)
    out = np.stack([upsample2(np.ascontiguousarray(c)) for c in pcm.T], axis=1) if len(pcm) else pcm
    return wav(PCM, out.astype("<i2").tobytes(), 2 * rate, 16, pcm.shape[1])


def payload(text: bytes | None) -> bytes:
    """The text's UTF-8 with bytes 0 up to a positive multiple of 64."""
    data = text or b""
    return data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))


def feature(pcm: np.ndarray, rate: int) -> str:
    """Rate, samples, peak, mean square, sign changes and checksum of the resampled PCM, all from integers."""
    x = pcm.astype(np.int64)
    changes = int(np.count_nonzero(np.diff(np.signbit(pcm))))
    return f"pcm16/{rate} n={len(pcm)} peak={int(np.abs(x).max(initial=0))} ms={int((x * x).sum()) // max(1, len(pcm))} zc={changes} crc={zlib.crc32(pcm.tobytes()):08x}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        texts = raw_texts(batch.column("text"))
        media = pa.array([wav(MULAW, payload(t)) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), media], names=["doc_id", "n_bytes", "media"])


_DIGESTS = ("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, alaw_crc32 long, adpcm_samples long, adpcm_crc32 long, pcm_bytes long, pcm_sha256 string")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    for batch in slices(batches, "media", 2 << 20):
        files = batch.column("media").to_pylist()
        parsed = [parse_wav(m) for m in files]
        # The payloads as ADPCM blocks of 64 bytes, those of all texts at once.
        blocks = decode_adpcm(np.frombuffer(b"".join(w.data for w in parsed), dtype=np.uint8).reshape(-1, UNIT))
        rows, at = [], 0
        for media, w in zip(files, parsed, strict=True):
            own, at = blocks[at : at + len(w.data) // UNIT], at + len(w.data) // UNIT
            pcm = resampled(media)
            rows.append((
                len(w.data), hashlib.sha256(w.data).hexdigest(), zlib.crc32(w.data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(parse_wav(pcm).data, dtype="<i2"), 2 * w.rate),
                zlib.crc32(ALAW_PCM[np.frombuffer(w.data, dtype=np.uint8)].tobytes()), own.size, zlib.crc32(own.tobytes()), len(pcm), hashlib.sha256(pcm).hexdigest(),
            ))
        columns = [pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for x in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *names])


def store_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, null as empty, as the samples of a mu-law WAV file."""
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_store, f"doc_id {_kind(docs, key)}, n_bytes long, media binary")


def _kind(docs: DataFrame, key: str) -> str:
    return docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()


def resampled_pcm(media: DataFrame, column: str = "media", out: str = "pcm") -> DataFrame:
    """media with ``out`` in place of ``column`` (a column named ``out`` goes): a WAV file of 16-bit PCM at twice the rate.

    Mu-law, A-law, IMA ADPCM and PCM of 8 or 16 bits are read, with any number of channels; a null, and whatever isn't such a
    file, gives null, a file without samples one without samples. Rows keep their number, an empty table gives an empty one.
    """
    kept = [c for c in media.columns if c not in (column, out)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in slices(batches, len(kept), 2 << 20):
            done = []
            for x in batch.column(len(kept)).to_pylist():
                try:
                    done.append(resampled(x or b""))
                except (ValueError, struct.error):
                    done.append(None)
            yield [*batch.columns[:-1], pa.array(done, pa.binary())]

    return mapped(media, kept, column, each, [(out, "binary")])


def media_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores every text as media in the shared folder, reads the stored bytes back and describes them.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature (of the mu-law expansion, resampled
    to 16-bit PCM); then the checksum of the payload's A-law expansion, the number and checksum of its samples as ADPCM blocks, and the size and
    digest of the resampled file. Equal texts give equal values, null is an empty text, repeated rows stay, an empty table gives no rows,
    and other columns are ignored.
    """
    table = stored(store_media(docs, text, key), "media", **{"parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)})
    return table.mapInArrow(_read, f"doc_id {_kind(docs, key)}, n_bytes long, {_DIGESTS}")
