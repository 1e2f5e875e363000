"""FLAC for byte payloads: 8-bit mono frames with fixed predictors and Rice residuals, written and read in numpy.

All frames of a chunk are coded side by side: one numpy step handles the i-th
sample of every frame. A seek table names first samples and byte offsets, so
frames of one stream are decoded independently. The reader takes constant,
verbatim, fixed and LPC subframes with any Rice partitioning and checks CRC-8 of
each header, CRC-16 of each frame and the MD5 of the samples. A task stores its
streams in chunk files, reads each back and writes the decoded samples as PCM
blocks with a table of their sample and byte offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, slices, small_batches, table

BLOCK = 4096
RATE = 8000
ALIGN = 64
#: Rice partitions of a whole frame.
PARTITIONS = 8
#: Bytes of streams in a chunk file, before the next one is begun.
CHUNK = 8 << 20
#: Frames decoded side by side.
FRAMES = 4096
#: Most bytes of a seek table; beyond, its points are several frames apart.
TABLE = (1 << 24) - 1
#: A frame is stored verbatim if Rice codes would take this many times its bits.
SLACK = 1.05
#: Residual of the fixed predictors of order 0 to 4: e = sum of c[j] * s[i-j].
FIXED = ((1,), (1, -1), (1, -2, 1), (1, -3, 3, -1), (1, -4, 6, -4, 1))


def _crc_table(width: int, poly: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for x in range(256):
        x <<= width - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x & top else x << 1) & mask
        out.append(x)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_weights = np.zeros((0, 256), np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each data[start:end]. A CRC is the xor of what each byte adds, by its distance from the end."""
    global _weights
    sizes = ends - starts
    if len(sizes) and sizes.max() > len(_weights):
        rows = [_CRC16] if not len(_weights) else list(_weights)
        while len(rows) < int(sizes.max()) + 64:
            x = rows[-1]
            rows.append((x << np.uint16(8)) ^ _CRC16[x >> np.uint16(8)])
        _weights = np.array(rows, np.uint16)
    out = np.zeros(len(sizes), np.uint16)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        if e > s:
            out[i] = np.bitwise_xor.reduce(_weights[np.arange(e - s - 1, -1, -1), data[s:e]])
    return out


def _utf8(n: int) -> bytes:
    """FLAC's coded number: UTF-8 carried on to 36 bits."""
    if n < 128:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 63)
        n >>= 6
    return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


def _coded(data: bytes, at: int) -> tuple[int, int]:
    b = data[at]
    if b < 128:
        return b, at + 1
    more = 8 - (b ^ 0xFF).bit_length() - 1
    n = b & (0x3F >> more)
    for c in data[at + 1 : at + 1 + more]:
        n = n << 6 | c & 63
    return n, at + 1 + more


def _fixed(x: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Residuals of all samples; those of a frame's first order samples mean nothing."""
    out = x.astype(np.int32)
    for j in range(1, order + 1):
        out[j:] += FIXED[order][j] * x[:-j]
    return out


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload of one byte or more; samples are bytes less 128."""
    if not payloads:
        return []
    data = np.frombuffer(b"".join(payloads), np.uint8)
    x = data.astype(np.int32) - 128
    sizes = np.array([len(p) for p in payloads], np.int64)
    frames_of = -(-sizes // block)
    first = np.concatenate([[0], np.cumsum(frames_of)])
    base = np.cumsum(sizes) - sizes
    number = np.arange(first[-1]) - np.repeat(first[:-1], frames_of)
    starts = np.repeat(base, frames_of) + number * block
    n = np.minimum(block, np.repeat(base + sizes, frames_of) - starts)
    nth = np.arange(len(x)) - np.repeat(starts, n)
    parts = np.where((n == block) & (block % PARTITIONS == 0) & (block // PARTITIONS > 4), PARTITIONS, 1)
    part_first = np.cumsum(parts) - parts
    frame_of = np.repeat(np.arange(len(n)), parts)
    nth_part = np.arange(len(frame_of)) - part_first[frame_of]
    part_n = (n // parts)[frame_of]
    part_start = starts[frame_of] + nth_part * part_n
    # Rice cost of each predictor order, estimated from the partitions' means; verbatim where all are longer by SLACK.
    best, order, k = n * 8.0 * SLACK, np.full(len(n), -1), np.zeros(len(frame_of), np.int64)
    residuals = {}
    for o in range(len(FIXED)):
        e = _fixed(x, starts, o)
        residuals[o] = (e << 1) ^ (e >> 31)
        residuals[o][np.flatnonzero(nth < o)] = 0  # warm-up samples, whose residuals reach into the frame before
        total = np.add.reduceat(residuals[o], part_start, dtype=np.int64)
        rice = np.clip(np.floor(np.log2(np.maximum(total / part_n, 1) * 0.72)), 0, 14).astype(np.int64)
        bits = np.add.reduceat(part_n * (rice + 1) + (total >> rice) + 5, part_first) + 8 * o + 6
        fits = (n > o) & (bits < best)
        best, order, k = np.where(fits, bits, best), np.where(fits, o, order), np.where(fits[frame_of], rice, k)
    owner = np.repeat(np.arange(len(n)), n)
    o_of, k_of = order[owner], np.repeat(k, part_n)
    u = residuals[0].astype(np.int64)
    for o in range(1, len(FIXED)):
        if (order == o).any():
            u = np.where(o_of == o, residuals[o], u)
    plain = nth < np.maximum(o_of, 0)
    quotient = u >> k_of
    width = np.where((o_of < 0) | plain, 8, quotient + 1 + k_of)
    later = np.flatnonzero((nth_part > 0) & (order[frame_of] >= 0))  # partitions whose parameter comes among the samples
    width[part_start[later]] += 4
    cum = np.cumsum(width)
    body = np.add.reduceat(width, starts)
    tail = np.where(order >= 0, 2 + 4 + 4, 0)  # coding method, partition order and one parameter, after the warm-up
    total = 8 + body + tail
    heads = [_header(int(f), int(m)) for f, m in zip(number.tolist(), n.tolist())]
    head_sizes = np.array([len(h) for h in heads], np.int64)
    body_bytes = -(-total // 8)
    ends = np.cumsum(head_sizes + body_bytes + 2)
    at = ends - (head_sizes + body_bytes + 2)
    origin = (at + head_sizes) * 8
    bits = np.zeros(int(ends[-1]) * 8 if len(ends) else 0, np.uint8)
    code = np.where(order >= 0, 8 + order, 1)
    for j in range(6):
        bits[origin + 1 + j] = code >> (5 - j) & 1
    riced = np.flatnonzero(order >= 0)
    warm = origin[riced] + 8 + 8 * order[riced]
    halvings = np.log2(parts[riced]).astype(np.int64)
    for j in range(4):
        bits[warm + 2 + j] = halvings >> (3 - j) & 1
        bits[warm + 6 + j] = k[part_first[riced]] >> (3 - j) & 1
    pos = origin[owner] + 8 + (cum - width) - np.repeat((cum - width)[starts], n) + np.where(plain, 0, tail[owner])
    for j in range(4):
        bits[pos[part_start[later]] + j] = k[later] >> (3 - j) & 1
    pos[part_start[later]] += 4
    eight = np.flatnonzero((o_of < 0) | plain)
    for j in range(8):
        bits[pos[eight] + j] = x[eight] >> (7 - j) & 1
    coded = np.flatnonzero(~((o_of < 0) | plain))
    p, q, kk, uu = pos[coded], quotient[coded], k_of[coded], u[coded]
    bits[p + q] = 1
    p += q + 1
    for j in range(int(kk.max()) if len(kk) else 0):
        has = kk > j
        if has.all():
            bits[p + kk - 1 - j] = uu >> j & 1
        else:
            bits[(p + kk - 1 - j)[has]] = (uu >> j & 1)[has]
    packed = np.packbits(bits)
    flat_heads = np.frombuffer(b"".join(heads), np.uint8)
    packed[np.repeat(at - np.cumsum(head_sizes) + head_sizes, head_sizes) + np.arange(len(flat_heads))] = flat_heads
    crc = crc16(packed, at, ends - 2)
    packed[ends - 2], packed[ends - 1] = crc >> 8, crc & 255
    out = []
    for i, payload in enumerate(payloads):
        lo, hi = int(first[i]), int(first[i + 1])
        lengths = (ends - at)[lo:hi]
        pcm = (data[base[i] : base[i] + sizes[i]] ^ 128).tobytes()
        info = struct.pack(">HH", block, block) + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        apart = -(-(hi - lo) * 18 // TABLE)
        table = b"".join(struct.pack(">QQH", int(number[f]) * block, int(at[f] - at[lo]), int(n[f])) for f in range(lo, hi, apart))
        head = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table
        out.append(head + packed[at[lo] : ends[hi - 1]].tobytes())
    return out


def _header(number: int, n: int) -> bytes:
    head = b"\xff\xf8" + bytes([0x74 if n != 4096 else 0xC4, 0x02]) + _utf8(number) + ((n - 1).to_bytes(2, "big") if n != 4096 else b"")
    return head + bytes([crc8(head)])


class BadStream(ValueError):
    pass


def _parse(stream: bytes):
    """(samples, md5, [(first sample, offset)] or [], offset of the first frame, most bytes of a frame)"""
    if stream[:4] != b"fLaC":
        raise BadStream("no FLAC marker")
    at, points, info = 4, [], None
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            info = body
        elif kind & 127 == 3:
            points = [p for i in range(0, size, 18) if (p := struct.unpack_from(">QQH", body, i))[0] < (1 << 64) - 1]
        at += 4 + size
        if kind & 128:
            break
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 36 & 31 != 7 or packed >> 41 & 7:
        raise BadStream("not 8-bit mono")
    return packed & (1 << 36) - 1, info[18:34], points, at, int.from_bytes(info[7:10], "big")


def _walk(stream: bytes, at: int, sample: int, end: int, most: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first sample, samples, offset, offset of the subframe, end) of the frames from a place on, each found by decoding the one before."""
    while at < end:
        part = stream[at : at + most] if most else stream[at:end]
        _, n, body = _frame_header(part, 0)
        _, stop = decode_frames(part, [body], [n])
        size = int(stop[0]) + 2
        yield sample, n, at, at + body, at + size
        sample, at = sample + n, at + size


def _frame_header(data: bytes, at: int) -> tuple[int, int, int]:
    """(number, samples, offset of the subframe)"""
    if data[at : at + 2] != b"\xff\xf8":
        raise BadStream("lost the frame sync")
    kind = data[at + 2] >> 4
    number, p = _coded(data, at + 4)
    if kind == 6:
        n, p = data[p] + 1, p + 1
    elif kind == 7:
        n, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        n = 192 if kind == 1 else 576 << kind - 2 if kind < 6 else 256 << kind - 8
    rate = data[at + 2] & 15
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:p]) != data[p]:
        raise BadStream("header checksum")
    return number, n, p + 1


class _Bits:
    """Big-endian bit fields at one cursor for each frame."""

    def __init__(self, data: bytes, at: np.ndarray):
        raw = np.frombuffer(data + b"\0" * 16, np.uint8)
        self.words = np.zeros(len(raw) - 8, np.uint64)
        for j in range(8):
            self.words |= raw[j : j + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.at = at.astype(np.int64)

    def window(self, who) -> np.ndarray:
        p = self.at[who]
        return self.words[p >> 3] << (p & 7).astype(np.uint64)

    def take(self, who, n) -> np.ndarray:
        """n bits (0 to 32, a number or one for each frame) as unsigned."""
        n = np.asarray(n, np.uint64)
        out = np.where(n == 0, np.uint64(0), self.window(who) >> (np.uint64(64) - np.maximum(n, np.uint64(1)))).astype(np.int64)
        self.at[who] += n.astype(np.int64)
        return out


_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def _signed(v: np.ndarray, bits) -> np.ndarray:
    return v - ((v >> (np.asarray(bits) - 1) & 1) << np.asarray(bits))


def _unary(bits: _Bits, who: np.ndarray) -> np.ndarray:
    q = _ZEROS[(bits.window(who) >> np.uint64(48)).astype(np.int64)]
    bits.at[who] += q
    long = np.flatnonzero(q == 16)
    while len(long):
        more = _ZEROS[(bits.window(who[long]) >> np.uint64(48)).astype(np.int64)]
        q[long] += more
        bits.at[who[long]] += more
        long = long[more == 16]
    bits.at[who] += 1
    return q


def decode_frames(data: bytes, offsets: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frame, i) of frames whose subframes start at the byte offsets, and the byte where each one's bits end."""
    n = np.array(counts, np.int64)
    bits = _Bits(data, np.array(offsets, np.int64) * 8)
    every = np.arange(len(n))
    x = np.zeros((len(n), int(n.max()) if len(n) else 0), np.int32)
    head = bits.take(every, 8)
    if (head & 128).any():
        raise BadStream("padding bit set")
    kind = head >> 1 & 63
    wasted = np.zeros(len(n), np.int64)
    odd = np.flatnonzero(head & 1)
    if len(odd):
        wasted[odd] = _unary(bits, odd) + 1
    depth = 8 - wasted
    constant = np.flatnonzero(kind == 0)
    if len(constant):
        x[constant] = _signed(bits.take(constant, depth[constant]), depth[constant])[:, None]
    for i in range(int(n[kind == 1].max()) if (kind == 1).any() else 0):
        who = np.flatnonzero((kind == 1) & (n > i))
        x[who, i] = _signed(bits.take(who, depth[who]), depth[who])
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, -1))
    if ((order < 0) & (kind > 1)).any():
        raise BadStream("reserved subframe")
    riced = np.flatnonzero(order >= 0)
    for i in range(int(order.max()) if len(riced) else 0):
        who = riced[order[riced] > i]
        x[who, i] = _signed(bits.take(who, depth[who]), depth[who])
    coefficients, shift = np.zeros((len(n), 32), np.int64), np.zeros(len(n), np.int64)
    for o in range(1, 5):
        who = np.flatnonzero(~lpc & (order == o))
        coefficients[who, :o] = [-c for c in FIXED[o][1:]]
    who = np.flatnonzero(lpc)
    if len(who):
        precision = bits.take(who, 4) + 1
        shift[who] = _signed(bits.take(who, 5), 5)
        for j in range(int(order[who].max())):
            some = order[who] > j
            coefficients[who[some], j] = _signed(bits.take(who[some], precision[some]), precision[some])
    if len(riced):
        _residuals(bits, riced, n, order, coefficients, shift, x)
    if wasted.any():
        x <<= wasted[:, None].astype(np.int32)
    return x, -(-bits.at // 8)


def _residuals(bits: _Bits, riced, n, order, coefficients, shift, x) -> None:
    wide = np.zeros(len(n), np.int64)
    method = bits.take(riced, 2)
    if (method > 1).any():
        raise BadStream("reserved residual")
    wide[riced] = 4 + method
    parts = np.zeros(len(n), np.int64)
    parts[riced] = bits.take(riced, 4)
    k, raw = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    left = np.zeros(len(n), np.int64)
    at = order.copy()
    most = int(order[riced].max())
    done = riced
    first = True
    by_length = riced[np.argsort(-(n - order)[riced], kind="stable")]
    steps = (n - order)[by_length]
    active = len(by_length)
    for i in range(int(steps[0]) if len(steps) else 0):
        while active and steps[active - 1] <= i:
            active -= 1
        who = by_length[:active]
        if first or (left[who] == 0).any():
            new = who[left[who] == 0]
            left[new] = (n[new] >> parts[new]) - np.where(at[new] == order[new], order[new], 0)
            while len(new):
                k[new] = bits.take(new, wide[new])
                escaped = new[k[new] == (1 << wide[new]) - 1]
                if len(escaped):
                    raw[escaped] = bits.take(escaped, 5)
                    k[escaped] = -1
                new = new[left[new] <= 0]
                left[new] += n[new] >> parts[new]
            first = False
        kk = k[who]
        if (kk >= 0).all():
            u = _unary(bits, who) << kk
            u |= bits.take(who, kk)
            e = (u >> 1) ^ -(u & 1)
        else:
            e = np.zeros(len(who), np.int64)
            plain = np.flatnonzero(kk < 0)
            some = np.flatnonzero(kk >= 0)
            width = np.maximum(raw[who[plain]], 1)
            e[plain] = np.where(raw[who[plain]] > 0, _signed(bits.take(who[plain], raw[who[plain]]), width), 0)
            u = _unary(bits, who[some]) << kk[some]
            u |= bits.take(who[some], kk[some])
            e[some] = (u >> 1) ^ -(u & 1)
        if most:
            guess = np.zeros(len(who), np.int64)
            for j in range(most):
                back = at[who] - 1 - j
                guess += coefficients[who, j] * np.where(back >= 0, x[who, back], 0)
            e = e + (guess >> shift[who])
        x[who, at[who]] = e
        at[who] += 1
        left[who] -= 1
    empty = done[(n - order)[done] <= 0]
    if len(empty):
        bits.take(empty, wide[empty])


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams, with every checksum verified."""
    data, jobs, totals = b"".join(streams), [], []
    base = 0
    for s, stream in enumerate(streams):
        samples, md5, points, at, most = _parse(stream)
        totals.append((samples, md5))
        stops = [at + p[1] for p in points[1:]] + [len(stream)]
        for (sample, offset, _), ahead, e in zip(points or [(0, 0, 0)], [*(p[0] for p in points[1:]), samples], stops):
            o = at + offset
            _, n, body = _frame_header(stream, o)
            if sample + n >= ahead:
                jobs.append((s, sample, n, base + o, base + body, base + e))
            else:  # points several frames apart, or none
                jobs += [(s, first, m, base + x, base + y, base + z) for first, m, x, y, z in _walk(stream, o, sample, e, most)]
        base += len(stream)
    raw = np.frombuffer(data, np.uint8)
    blocks: list[list[bytes]] = [[] for _ in streams]
    for lo in range(0, len(jobs), FRAMES):
        part = jobs[lo : lo + FRAMES]
        floor, top = min(j[3] for j in part), max(j[5] for j in part)
        x, ends = decode_frames(data[floor:top], [j[4] - floor for j in part], [j[2] for j in part])
        stops = np.array([j[5] for j in part])
        if (ends + floor + 2 != stops).any():
            raise BadStream("frame length")
        crc = crc16(raw, np.array([j[3] for j in part]), stops - 2)
        if (crc != raw[stops - 2].astype(np.uint16) << 8 | raw[stops - 1]).any():
            raise BadStream("frame checksum")
        pcm = x.astype(np.int8).view(np.uint8)
        for row, (s, _, n, _, _, _) in zip(pcm, part):
            blocks[s].append(row[:n].tobytes())
    out = []
    for (samples, md5), pieces in zip(totals, blocks):
        pcm = b"".join(pieces)
        if len(pcm) != samples or hashlib.md5(pcm).digest() != md5:
            raise BadStream("samples checksum")
        out.append((np.frombuffer(pcm, np.uint8) ^ 128).tobytes())
    return out


def seek(stream: bytes, sample: int) -> tuple[int, bytes]:
    """(first sample, payload bytes) of the block that holds a sample. Only that frame is decoded, and those between it and the point before it."""
    samples, _, points, at, most = _parse(stream)
    if not 0 <= sample < samples:
        raise IndexError(sample)
    first, offset, _ = max((p for p in points if p[0] <= sample), default=(0, 0, 0))
    for first, n, o, body, end in _walk(stream, at + offset, first, len(stream), most):
        if sample < first + n:
            x, _ = decode_frames(stream[o:end], [body - o], [n])
            return first, (x[0, :n].astype(np.int8).view(np.uint8) ^ 128).tobytes()
    raise BadStream("fewer samples than stated")


def feature(payload: bytes, block: int = BLOCK) -> str:
    """Of the decoded samples: blocks, mean, peak, zero crossings, as text."""
    x = (np.frombuffer(payload, np.uint8) ^ 128).view(np.int8).astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"blocks={-(-len(x) // block)};sum={int(x.sum())};peak={int(np.abs(x).max())};energy={int((x * x).sum())};crossings={crossings}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * ((max(1, -(-len(raw) // ALIGN)) * ALIGN) - len(raw))


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, file string, media_offset long, pcm_offset long"
BLOCKS = pa.schema([("doc_id", pa.int64()), ("stream", pa.int64()), ("first_sample", pa.int64()), ("samples", pa.int64()), ("offset", pa.int64())])


class _Chunk:
    """A file of streams that a task writes, closes, reads back and decodes."""

    def __init__(self, uri: str):
        self.uri, (self.fs, self.path) = uri, pafs.FileSystem.from_uri(uri)
        self.out = self.fs.open_output_stream(self.path + ".flac")
        self.bytes, self.ids, self.sizes, self.lengths = 0, [], [], []

    def add(self, ids: list, sizes: list[int], media: list[bytes]) -> None:
        self.out.write(b"".join(media))
        self.ids += ids
        self.sizes += sizes
        self.lengths += map(len, media)
        self.bytes += sum(map(len, media))

    def read_back(self, keep: bool) -> pa.RecordBatch:
        """The rows of the chunk from its stored bytes; the PCM blocks and their table are written beside it."""
        self.out.close()
        with self.fs.open_input_file(self.path + ".flac") as f:
            data = f.read()
        ends = np.cumsum(self.lengths)
        at = ends - self.lengths
        media = [data[x:y] for x, y in zip(at.tolist(), ends.tolist())]
        back = decode(media)
        pcm_at = np.cumsum([0, *map(len, back)])
        with self.fs.open_output_stream(self.path + ".pcm") as f:
            f.write((np.frombuffer(b"".join(back), np.uint8) ^ 128).tobytes())
        counts = np.array([-(-len(p) // BLOCK) for p in back])
        owner = np.repeat(np.arange(len(back)), counts)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * BLOCK
        samples = np.minimum(BLOCK, np.array([len(p) for p in back])[owner] - first)
        with self.fs.open_output_stream(self.path + ".blocks") as f, pa.ipc.new_stream(f, BLOCKS) as table:
            table.write_batch(pa.record_batch([pa.array(self.ids, pa.int64()).take(pa.array(owner)), pa.array(owner), pa.array(first), pa.array(samples), pa.array(pcm_at[owner] + first)], schema=BLOCKS))
        if not keep:
            for kind in (".flac", ".pcm", ".blocks"):
                self.fs.delete_file(self.path + kind)
        cols = [self.ids, self.sizes, [len(p) for p in back], [hashlib.sha256(p).hexdigest() for p in back], [zlib.crc32(p[-ALIGN:]) for p in back], self.lengths, [hashlib.sha256(m).hexdigest() for m in media], [feature(p) for p in back], [self.uri if keep else None] * len(back), at.tolist(), pcm_at[:-1].tolist()]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in MEDIA.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in MEDIA.split(", ")])


def read_block(uri: str, stream: int, sample: int) -> tuple[int, bytes]:
    """(first sample, PCM bytes) of the block that holds a sample of a chunk's n-th stream: one row of the table and one read at its offset."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path + ".blocks") as f:
        rows = pa.ipc.open_stream(f).read_all()
    mine = rows.filter((pa.compute.equal(rows["stream"], stream)))
    i = int(np.searchsorted(mine["first_sample"].to_numpy(), sample, "right")) - 1
    first, n, at = (mine[c][i].as_py() for c in ("first_sample", "samples", "offset"))
    with fs.open_input_file(path + ".pcm") as f:
        return first, f.read_at(n, at)


def flac_media(docs: DataFrame, folder: str, keep: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Each text as a FLAC stream in a chunk file of the folder, with what is computed from the samples decoded from that file.

    A chunk is NAME.flac (streams one after another, the row's at media_offset),
    NAME.pcm (the decoded samples, the row's at pcm_offset) and NAME.blocks (an
    Arrow stream: doc_id, stream, first_sample, samples, offset of each block);
    file is NAME. Without keep a chunk is deleted once its rows are made, and
    file is null. A retried task writes files of its own, so only those named in
    the rows count.

    A null text is empty and stored as 64 zero bytes. Equal texts have equal
    values. Long texts are split in frames, so memory follows a chunk or the one
    longest text. A failed checksum raises BadStream. Repeated rows and null ids
    are kept. Empty table: no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n = TaskContext.get(), None, 0
        for b in batches:
            for rows in slices(b, 1, 2 << 20, 2048):
                sizes, payloads = zip(*map(padded, rows.column(1).to_pylist()))
                if held is None:
                    held, n = _Chunk(f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{n:05d}"), n + 1
                held.add(rows.column(0).to_pylist(), list(sizes), encode(list(payloads)))
                if held.bytes >= chunk:
                    yield held.read_back(keep)
                    held = None
        if held is not None:
            yield held.read_back(keep)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MEDIA)


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flac_media(table(spark, sf_dir, "documents"), new_folder(spark, "flac"), keep=False)
    return out.drop("file", "media_offset", "pcm_offset")
