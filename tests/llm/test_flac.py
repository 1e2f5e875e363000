"""FLAC media (op3): exact round trips, checksums, seeking, and a writer of other subframe kinds."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from spendloom.llm import flac


def payloads():
    rnd = random.Random(2)
    out = [b"\0" * 64, b"a", b"ab" * 32, bytes(range(256)) * 40, rnd.randbytes(10_000), ("text é " * 3000).encode(), b"\xff\0" * 5000, bytes(8192), bytes(4096), b"x" * 4097]
    return out + [rnd.randbytes(rnd.randrange(1, 300)) for _ in range(60)] + [bytes(rnd.randrange(90, 120) for _ in range(rnd.randrange(1, 9000))) for _ in range(20)]


def test_round_trip():
    ps = payloads()
    streams = flac.encode(ps)
    assert flac.decode(streams) == ps
    assert [flac.encode([p])[0] for p in ps] == streams
    assert sum(map(len, flac.encode([bytes(range(97, 123)) * 400]))) < 6000


def test_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 20, 1 << 21, (1 << 31) - 1, 1 << 31, (1 << 36) - 1):
        raw = flac._utf8(n)
        assert flac._coded(raw, 0) == (n, len(raw))
        if n < 0x110000 and not 0xD800 <= n < 0xE000:
            assert raw == chr(n).encode()


def test_checksums():
    data = np.frombuffer(b"123456789", np.uint8)
    assert flac.crc16(data, np.array([0]), np.array([9]))[0] == 0xFEE8
    assert flac.crc8(b"123456789") == 0xF4
    stream = flac.encode([b"some payload " * 100])[0]
    for at in range(60, len(stream), 37):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises((flac.BadStream, IndexError)):
            flac.decode([bytes(bad)])


def test_seek():
    p = bytes(random.Random(1).randrange(97, 110) for _ in range(20_000))
    stream = flac.encode([p])[0]
    for i in (0, 4095, 4096, 10_000, 19_999):
        first, block = flac.seek(stream, i)
        assert first <= i < first + len(block) and block == p[first : first + len(block)]


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += format(v & (1 << n) - 1, f"0{n}b") if n else ""

    def bytes(self):
        s = self.s + "0" * (-len(self.s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big")


def test_other_subframes():
    """Constant, fixed 4, LPC, partitions, escapes and wasted bits, written bit by bit; the table of offsets is left out."""
    x = [((i * 7) % 23 - 11) * 2 for i in range(64)]
    bodies = []
    b = Bits(); b.put(0, 8); b.put(-5, 8); bodies.append((b, [-5] * 64))
    for order, kind, coefs, shift in ((4, 12, (4, -6, 4, -1), 0), (3, 32 + 2, (5, -3, 2), 2)):
        b = Bits(); b.put(0, 1); b.put(kind, 6); b.put(0, 1)
        for v in x[:order]:
            b.put(v, 8)
        if kind >= 32:
            b.put(7 - 1, 4); b.put(shift, 5)
            for c in coefs:
                b.put(c, 7)
        b.put(0, 2); b.put(2, 4)
        for part in range(4):
            lo, hi = max(order, part * 16), part * 16 + 16
            res = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(lo, hi)]
            if part == 1:
                b.put(15, 4); b.put(12, 5)
                for e in res:
                    b.put(e, 12)
            else:
                b.put(part + 1, 4)
                for e in res:
                    u = e << 1 ^ e >> 31
                    b.put(1, (u >> part + 1) + 1); b.put(u, part + 1)
        bodies.append((b, x))
    b = Bits(); b.put(0, 1); b.put(1, 6); b.put(1, 1); b.put(1, 1)  # verbatim, one wasted bit
    for v in x:
        b.put(v >> 1, 7)
    bodies.append((b, x))
    frames, pcm = b"", b""
    for i, (b, want) in enumerate(bodies):
        frame = flac._header(i, 64) + b.bytes()
        a = np.frombuffer(frame, np.uint8)
        frames += frame + int(flac.crc16(a, np.array([0]), np.array([len(a)]))[0]).to_bytes(2, "big")
        pcm += np.array(want, np.int8).tobytes()
    info = struct.pack(">HH", 64, 64) + bytes(6) + (8000 << 44 | 7 << 36 | len(pcm)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frames
    assert flac.decode([stream])[0] == bytes(v ^ 128 for v in pcm)


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in flac.op3_flac_media(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        raw = d.text.encode()
        p = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_edges(spark, tmp_path):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "é" * 100_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media long")
    got = flac.flac_media(docs, f"file://{tmp_path}/kept", chunk=64).collect()
    assert len(got) == 4 and sorted(r.payload_bytes for r in got) == [64, 64, 64, 200_000]
    assert len({r.media_sha256 for r in got}) == 2
    for r in got:
        path = r.file.removeprefix("file://")
        with open(path + ".flac", "rb") as f, open(path + ".pcm", "rb") as g:
            f.seek(r.media_offset)
            g.seek(r.pcm_offset)
            payload = flac.decode([f.read(r.media_bytes)])[0]
            assert hashlib.sha256(payload).hexdigest() == r.payload_sha256
            assert bytes(x ^ 128 for x in g.read(r.payload_bytes)) == payload
    long = next(r for r in got if r.doc_id == 2)
    first, block = flac.read_block(long.file, 0, 150_000)
    assert first <= 150_000 < first + len(block) and bytes(x ^ 128 for x in block) == ("é" * 100_000).encode()[first : first + len(block)]
    assert flac.flac_media(docs.where("false"), f"file://{tmp_path}/none").collect() == []
    assert sorted(r.media_sha256 for r in flac.flac_media(docs, f"file://{tmp_path}/gone", keep=False).collect()) == sorted(r.media_sha256 for r in got)
    assert list((tmp_path / "gone").iterdir()) == []


def test_sparse_points(monkeypatch):
    """Points several frames apart, as where a table of all frames would have no room."""
    p = bytes(random.Random(5).randrange(60, 110) for _ in range(3_000))
    whole = flac.encode([p], 64)[0]
    monkeypatch.setattr(flac, "TABLE", 18 * 5)
    stream = flac.encode([p], 64)[0]
    assert len(whole) - len(stream) == 18 * (47 - 5) and flac.decode([stream, whole]) == [p, p]
    for i in range(0, 3_000, 97):
        first, block = flac.seek(stream, i)
        assert first <= i < first + 64 and block == p[first : first + 64]
    with pytest.raises(IndexError):
        flac.seek(stream, 3_000)


def reference_decode(stream):
    """One bit at a time, after the published format: fixed subframes and verbatim ones."""
    at = 4
    while True:
        last, size = stream[at] & 128, int.from_bytes(stream[at + 1 : at + 4], "big")
        at += 4 + size
        if last:
            break
    bits, i, out = "".join(format(b, "08b") for b in stream[at:]), 0, []

    def take(n):
        nonlocal i
        i += n
        return int(bits[i - n : i], 2) if n else 0

    signed = lambda n: (v := take(n)) - ((v >> n - 1) << n)
    while i < len(bits):
        assert take(16) == 0xFFF8
        size, _, _ = take(4), take(4), take(8)
        lead = take(8)
        while lead & 128 and lead & 64:
            take(8)
            lead = lead << 1 & 255
        n = take(16) + 1 if size == 7 else 4096
        take(8)
        assert take(1) == 0
        kind, _ = take(6), take(1)
        if kind == 1:
            x = [signed(8) for _ in range(n)]
        else:
            order = kind - 8
            x = [signed(8) for _ in range(order)]
            assert take(2) == 0
            parts = 1 << take(4)
            for q in range(parts):
                k = take(4)
                for _ in range(n // parts - (order if q == 0 else 0)):
                    run = bits.index("1", i) - i
                    i += run + 1
                    u = run << k | take(k)
                    e = u >> 1 ^ -(u & 1)
                    x.append(e - sum(c * x[-1 - j] for j, c in enumerate(flac.FIXED[order][1:])))
        i += -i % 8 + 16
        out += x
    return bytes(v + 128 & 255 for v in out)


def test_independent_decoder():
    rnd = random.Random(7)
    smooth = [int(120 * np.sin(i / 40) * np.sin(i / 900)) + 128 for i in range(9_000)]
    ps = [bytes(smooth), ("Plain text, for all to read. " * 400).encode(), bytes(rnd.randrange(97, 123) for _ in range(5_000)), b"\0" * 64]
    for p, stream in zip(ps, flac.encode(ps)):
        assert reference_decode(stream) == p


