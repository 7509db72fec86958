import hashlib
import itertools
import struct
import zlib

import numpy as np

from framesieve.llm import telephony as tp


def test_tables():
    assert tp.MULAW_PCM[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert tp.ALAW_PCM[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert len(set(tp.ALAW_PCM.tolist())) == 256 and len(set(tp.MULAW_PCM.tolist())) == 255


def scalar_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(tp.ADPCM_STEPS[index])
            change = step >> 3
            if code & 4:
                change += step
            if code & 2:
                change += step >> 1
            if code & 1:
                change += step >> 2
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(tp.ADPCM_INDEX[code & 7])))
            out.append(value)
    return out


def test_adpcm_blocks():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    got = tp.decode_adpcm(blocks)
    assert got.shape == (50, 121) and all(got[k].tolist() == scalar_adpcm(b.tobytes()) for k, b in enumerate(blocks))


def test_containers():
    pcm = np.random.default_rng(2).integers(-32768, 32768, 500).astype(np.int16)
    assert tp.to_pcm(tp.wav(tp.PCM, pcm.tobytes(), 8000, 16))[1][:, 0].tolist() == pcm.tolist()
    data = bytes(range(256))
    for tag, table in ((tp.MULAW, tp.MULAW_PCM), (tp.ALAW, tp.ALAW_PCM)):
        media = tp.wav(tag, data)
        assert tp.parse_wav(media).data == data and tp.to_pcm(media)[1][:, 0].tolist() == table.tolist()
    assert len(tp.to_pcm(tp.wav(tp.IMA_ADPCM, data))[1]) == 4 * 121
    up = tp.upsample2(pcm)
    assert up[::2].tolist() == pcm.tolist() and len(up) == 1000
    assert tp.upsample2(np.full(9, 500, dtype=np.int16)).tolist() == [500] * 18


def test_payloads():
    assert [len(tp.payload(t)) for t in (None, b"", b"x", b"x" * 64, b"x" * 65)] == [64, 64, 64, 64, 128]


def plain_mulaw(code):
    code = ~code & 255
    size = ((code & 15) * 8 + 132) * 2 ** (code >> 4 & 7) - 132
    return -size if code & 128 else size


def plain_alaw(code):
    code ^= 0x55
    exponent, size = code >> 4 & 7, (code & 15) * 16 + 8
    size = (size + 256) * 2 ** (exponent - 1) if exponent else size
    return size if code & 128 else -size


def plain_upsampled(x):
    out = []
    for k, v in enumerate(x):
        a, b, c = x[max(k - 1, 0)], x[min(k + 1, len(x) - 1)], x[min(k + 2, len(x) - 1)]
        out += [v, max(-32768, min(32767, (9 * (v + b) - a - c + 8) // 16))]
    return out


def plain_wav(tag, bits, rate, data):
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * bits // 8, bits // 8, bits) + (b"" if tag == 1 else b"\0\0")
    body = b"WAVEfmt " + len(form).to_bytes(4, "little") + form + b"data" + len(data).to_bytes(4, "little") + data
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def plain_row(text):
    """All of a text's digests, sample by sample."""
    data = (text or "").encode()
    n = len(data)
    data += bytes(max(64, -(-n // 64) * 64) - n)
    media, linear = plain_wav(7, 8, 8000, data), [plain_mulaw(c) for c in data]
    up = plain_upsampled(linear)
    packed = struct.pack(f"<{len(up)}h", *up)
    pcm = plain_wav(1, 16, 16000, packed)
    changes = sum((a < 0) != (b < 0) for a, b in itertools.pairwise(up))
    feature = f"pcm16/16000 n={len(up)} peak={max(map(abs, up))} ms={sum(x * x for x in up) // len(up)} zc={changes} crc={zlib.crc32(packed):08x}"
    adpcm = [x for k in range(0, len(data), 64) for x in scalar_adpcm(data[k : k + 64])]
    alaw = struct.pack(f"<{len(data)}h", *map(plain_alaw, data))
    sha = [hashlib.sha256(x).hexdigest() for x in (data, media, pcm)]
    return n, len(data), sha[0], zlib.crc32(data[-64:]), len(media), sha[1], feature, zlib.crc32(alaw), len(adpcm), zlib.crc32(struct.pack(f"<{len(adpcm)}h", *adpcm)), len(pcm), sha[2]


def test_digests(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 300_000), (4, "x" * 300_000), (None, "abc")]
    docs = spark.createDataFrame([(*r, b"m") for r in rows], "`doc.id` long, text string, media binary")
    out = tp.media_digests(docs, key="doc.id").collect()
    assert {tuple(r) for r in out} == {(k, *plain_row(t)) for k, t in rows} and len(out) == len(rows)
    assert tp.media_digests(docs.limit(0), key="doc.id").count() == 0


def test_query_equals_the_plain_version(spark):
    from framesieve.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = {(r["doc_id"], *plain_row(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {tuple(r) for r in QUERIES["op5_media"](spark, sf).collect()} == want


def test_resampled_column(spark):
    good = [tp.wav(t, bytes(range(128))) for t in (tp.MULAW, tp.ALAW, tp.IMA_ADPCM)]
    stereo = tp.wav(tp.MULAW, bytes(range(100)), channels=2)
    both = tp.wav(tp.IMA_ADPCM, bytes(range(128)), channels=2)
    broken = [None, b"broken", b"", good[0][:30], good[2][:32] + b"\0\0" + good[2][34:], good[0][:22] + b"\0\0" + good[0][24:], good[2][:32] + b"\7\0" + good[2][34:], tp.wav(9, b"x"), tp.wav(tp.PCM, b"x" * 6, bits=24)]
    media = [*good, stereo, both, tp.wav(tp.MULAW, b""), *broken, good[0]]
    table = tp.resampled_pcm(spark.createDataFrame([(k, m, "p") for k, m in enumerate(media)], "`i.d` long, media binary, pcm string"))
    assert table.columns == ["i.d", "pcm"]
    out = {r[0]: r["pcm"] for r in table.collect()}
    assert all(out[k] is None for k in range(6, 6 + len(broken))) and out[len(media) - 1] == out[0]
    for k in range(5):
        rate, pcm = tp.to_pcm(bytes(out[k]))
        assert rate == 16000 and pcm[::2].tolist() == tp.to_pcm(media[k])[1].tolist()
        for c in range(pcm.shape[1]):
            assert pcm[:, c].tolist() == plain_upsampled(tp.to_pcm(media[k])[1][:, c].tolist())
    left, right = ([plain_mulaw(c) for c in range(s, 100, 2)] for s in (0, 1))
    assert tp.to_pcm(stereo)[1].T.tolist() == [left, right] and len(tp.to_pcm(bytes(out[5]))[1]) == 0
    words = [bytes(range(k, k + 4)) for k in range(0, 128, 4)]
    assert tp.to_pcm(both)[1].T.tolist() == [scalar_adpcm(b"".join(words[c::2])) for c in (0, 1)]
