"""FLAC media columns: a vectorised encoder and decoder, and PCM blocks.

Streams follow RFC 9639: STREAMINFO with MD5, a SEEKTABLE with a point for each
frame, then frames whose headers carry CRC-8 and whose ends carry CRC-16.  The
decoder reads constant, verbatim, fixed-predictor and LPC subframes, both Rice
methods with partitions and escapes, wasted bits, and the stereo modes.  It
verifies both checksums of each frame and the MD5 of each stream.

Rice codes can't be found without reading those before them, so the decoder
works across frames: where the seek table tells every frame's place, all frames
of a block of rows are read together, one residual of each frame a step, with
one gather of 64 bits a step.  Other streams are read in waves, their first
frames together, then their second ones, and so on.

Cases: a null or empty text gives a payload of zeros of the least length; a
null media value gives no blocks; damaged streams raise ValueError; repeated
rows and ids are each handled; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.blocks import sliced, utf8
from caseloom.scratch import discard, save

BLOCK = 4096
RATE = 8000
#: Order, coefficient bits and shift of the encoder's linear predictor.
ORDER, PRECISION, SHIFT = 8, 11, 9
#: Parts of a corpus whose media are stored one after another when only digests are wanted.
SHARES = 3
#: Bytes of payload handled at once in a worker.
CHUNK = 1 << 21
#: Fixed values of the format: the fixed predictors' coefficients by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << bits - 1, (1 << bits) - 1
    out = []
    for i in range(256):
        c = i << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_CRC8_LIST = _CRC8.tolist()
#: Zeros before the first one in 16 bits.
_ZEROS = np.array([16] + [15 - int(i).bit_length() + 1 for i in range(1, 1 << 16)], np.uint8)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8_LIST[c ^ b]
    return c


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of data[starts[i]:starts[i] + sizes[i]], all runs together."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order].copy(), sizes[order]
    crc = np.zeros(len(at), np.uint32)
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
    for n in live.tolist():
        c = crc[:n]
        crc[:n] = ((c << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC16[(c >> np.uint32(8)) ^ data[at[:n]]]
        at[:n] += 1
    out = np.zeros(len(at), np.uint32)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """The frame number in the format's UTF-8-like code."""
    if n < 128:
        return bytes([n])
    tail = []
    lead = 64
    while n >= lead:
        tail.append(128 | n & 63)
        n >>= 6
        lead = max(lead >> 1, 1)
    head = (0xFF00 >> len(tail) + 1) & 0xFF
    return bytes([head | n, *reversed(tail)])


def _frame_head(number: int, size: int) -> bytes:
    """A mono 8-bit frame's header; the sample rate is the stream's."""
    code = 0xC if size == BLOCK else 7
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _coded_number(number)
    if code == 7:
        head += (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _levinson(auto: np.ndarray, order: int) -> np.ndarray:
    """Predictor coefficients for each row of autocorrelations."""
    a = np.zeros((len(auto), order))
    err = auto[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy() if i else 0
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    return a


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = (value >> (width - 1 - b)) & 1


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A mono 8-bit FLAC stream of each payload; a byte b is the sample b - 128."""
    sizes: list[int] = []
    owner: list[int] = []
    for i, p in enumerate(payloads):
        full, rest = divmod(len(p), BLOCK)
        part = [BLOCK] * full + [rest] * (rest > 0)
        sizes += part
        owner += [i] * len(part)
    frames = _encode_frames(np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128, np.array(sizes, np.int64), _numbers(owner))
    out, at = [], 0
    for i, p in enumerate(payloads):
        mine = []
        while at < len(owner) and owner[at] == i:
            mine.append(at)
            at += 1
        seek, where = b"", 0
        for number, f in enumerate(mine):
            seek += (number * BLOCK).to_bytes(8, "big") + where.to_bytes(8, "big") + sizes[f].to_bytes(2, "big")
            where += len(frames[f])
        lengths = [len(frames[f]) for f in mine] or [0]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed, usedforsecurity=False).digest()
        out.append(b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + b"".join(frames[f] for f in mine))
    return out


def _numbers(owner: list[int]) -> list[int]:
    out: list[int] = []
    for i, o in enumerate(owner):
        out.append(out[-1] + 1 if i and owner[i - 1] == o else 0)
    return out


def _encode_frames(x: np.ndarray, sizes: np.ndarray, numbers: list[int]) -> list[bytes]:
    if not len(sizes):
        return []
    n = len(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(x)) - np.repeat(starts, sizes)
    total = lambda v: np.add.reduceat(v, starts)
    shifted = [x] + [np.concatenate((np.zeros(j, x.dtype), x[:-j])) * (place >= j) for j in range(1, ORDER + 1)]
    # candidates: fixed predictors of order 0 to 2, and a quantised linear predictor
    auto = np.stack([total((x * s).astype(np.float64)) for s in shifted], axis=1)
    limit = (1 << PRECISION - 1) - 1
    coef = np.clip(np.rint(_levinson(auto, ORDER) * (1 << SHIFT)), -limit, limit).astype(np.int32)
    pred = np.zeros(len(x), np.int32)
    for j in range(ORDER):
        pred += np.repeat(coef[:, j], sizes) * shifted[j + 1]
    tries = [(x, 0), (x - shifted[1], 1), (x - 2 * shifted[1] + shifted[2], 2), (x - (pred >> SHIFT), ORDER)]
    cost = np.stack([total(np.abs(r) * (place >= o)) + 8 * o for r, o in tries], axis=1)
    cost[sizes <= 2 * ORDER, 3] = 1 << 40
    pick = cost.argmin(axis=1)
    order = np.array([o for _, o in tries])[pick]
    res = np.choose(np.repeat(pick, sizes), [r for r, _ in tries])
    warm = place < np.repeat(order, sizes)
    u = (res.astype(np.int64) << 1 ^ res.astype(np.int64) >> 63) * ~warm
    count = sizes - order
    bits_at = np.stack([total(u >> k) + count * (k + 1) for k in range(12)], axis=1)
    k = bits_at.argmin(axis=1)
    lpc = pick == 3
    head = [_frame_head(number, size) for number, size in zip(numbers, sizes.tolist())]
    head_bits = np.array([8 * len(h) for h in head])
    fore = 8 + 8 * order + lpc * (9 + ORDER * PRECISION) + 10
    whole = (head_bits + fore + bits_at[np.arange(n), k] + 7) // 8
    begin = np.concatenate(([0], np.cumsum(whole + 2)))
    bits = np.zeros(int(begin[-1]) * 8, np.uint8)
    at = begin[:-1] * 8 + head_bits
    _put(bits, at, np.where(lpc, 32 | ORDER - 1, 8 | order) << 1, 8)
    ks = np.repeat(k, sizes)
    size_of = np.where(warm, 0, (u >> ks) + 1 + ks)
    ends = np.cumsum(size_of)
    ends += np.repeat(at + fore - np.concatenate(([0], ends))[starts], sizes)
    w = np.flatnonzero(warm)
    _put(bits, np.repeat(at + 8, sizes)[w] + 8 * place[w], x[w] & 255, 8)
    f = np.flatnonzero(lpc)
    spot = at[f] + 8 + 8 * ORDER
    _put(bits, spot, np.full(len(f), (PRECISION - 1) << 5 | SHIFT), 9)
    for j in range(ORDER):
        _put(bits, spot + 9 + PRECISION * j, coef[f, j] & (1 << PRECISION) - 1, PRECISION)
    _put(bits, at + fore - 10, k, 10)  # method 0, one partition, parameter
    codes = np.flatnonzero(~warm)
    ends, u, ks = ends[codes], u[codes], ks[codes]
    bits[ends - ks - 1] = 1
    low, high = int(ks.min(initial=0)), int(ks.max(initial=0))
    for b in range(high):
        if b < low:
            bits[ends - 1 - b] = (u >> b) & 1
        else:
            some = np.flatnonzero(ks > b)
            bits[ends[some] - 1 - b] = (u[some] >> b) & 1
    data = np.packbits(bits)
    raw = np.frombuffer(b"".join(head), np.uint8)
    sizes_h = head_bits // 8
    data[np.repeat(begin[:-1] - np.concatenate(([0], np.cumsum(sizes_h)[:-1])), sizes_h) + np.arange(len(raw))] = raw
    crc = crc16(data, begin[:-1], whole)
    data[begin[1:] - 2], data[begin[1:] - 1] = crc >> 8, crc & 255
    flat = data.tobytes()
    return [flat[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


class _Stream:
    """A stream's metadata."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last = 4, False
        points: list[tuple[int, int, int]] = []
        info = None
        while not last:
            last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
            body = media[at + 4 : at + 4 + size]
            if len(body) != size:
                raise ValueError("the stream ends early")
            if kind == 0:
                info = body
            elif kind == 3:
                points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            at += 4 + size
        if info is None:
            raise ValueError("no STREAMINFO")
        word = int.from_bytes(info[10:18], "big")
        self.block, self.rate, self.channels, self.bits, self.total = int.from_bytes(info[:2], "big"), word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1
        self.md5, self.body = info[18:34], at
        points = [p for p in points if p[0] != (1 << 64) - 1]
        ends = [a + n for a, _, n in points]
        whole = points and points[0][0] == 0 and ends[-1] == self.total and all(e == p[0] for e, p in zip(ends, points[1:]))
        #: Every frame's offset, if the seek table has all.
        self.frames = [p[1] for p in points] if whole or self.total == 0 else None


class _Frame:
    """A frame header at media[at:]."""

    def __init__(self, media: bytes, at: int, stream: _Stream):
        b = media[at : at + 17]
        if len(b) < 6 or b[0] != 0xFF or b[1] & 0xFE != 0xF8:
            raise ValueError("no frame here")
        size_code, rate_code, self.mode, bits_code = b[2] >> 4, b[2] & 15, b[3] >> 4, b[3] >> 1 & 7
        i, lead = 5, b[4]
        ones = 8 - (lead ^ 0xFF).bit_length()
        number = lead if ones == 0 else lead & 0xFF >> ones + 1
        for _ in range(max(0, ones - 1)):
            number = number << 6 | b[i] & 63
            i += 1
        if size_code in (6, 7):
            width = size_code - 5
            self.size = int.from_bytes(b[i : i + width], "big") + 1
            i += width
        elif size_code == 1:
            self.size = 192
        elif 2 <= size_code <= 5:
            self.size = 576 << size_code - 2
        elif size_code >= 8:
            self.size = 256 << size_code - 8
        else:
            raise ValueError("reserved block size")
        i += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
        if crc8(b[:i]) != b[i]:
            raise ValueError("a frame header's CRC-8 is wrong")
        self.first = number if b[1] & 1 else number * stream.block
        self.bits = {0: stream.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bits_code]
        self.channels = self.mode + 1 if self.mode < 8 else 2
        self.head = i + 1


class _Bits:
    """Reads at many bit positions at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        self.words = np.ndarray((len(padded) - 8,), ">u8", padded.tobytes(), strides=(1,))
        self.most = len(self.words) - 1

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position, at the top."""
        return self.words[np.minimum(at >> 3, self.most)].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned fields of up to 32 bits."""
        width = np.broadcast_to(np.asarray(width, np.uint64), at.shape)
        return ((self.window(at) >> np.uint64(1)) >> (np.uint64(63) - width)).astype(np.int64)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value = self.take(at, width)
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        return np.where((width > 0) & (value >> np.maximum(width - 1, 0) & 1 == 1), value - (np.int64(1) << width), value)


def _subframes(bits: _Bits, at: np.ndarray, sizes: np.ndarray, depth: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Decodes one subframe at each bit position: (samples of each, end positions)."""
    n = len(at)
    head = bits.take(at, 8)
    if (head & 128).any():
        raise ValueError("a subframe's padding bit is set")
    kind, wasted = head >> 1 & 63, head & 1
    at = at + 8
    more = np.flatnonzero(wasted)
    while len(more):  # the count of wasted bits is unary
        bit = bits.take(at[more], 1)
        at[more] += 1
        more = more[bit == 0]
        wasted[more] += 1
    depth = depth - wasted
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for i in np.flatnonzero(kind == 0).tolist():
        out[i] = np.full(sizes[i], bits.signed(at[i : i + 1], depth[i])[0])
        at[i] += depth[i]
    for i in np.flatnonzero(kind == 1).tolist():
        spots = at[i] + np.arange(sizes[i]) * depth[i]
        out[i] = bits.signed(spots, int(depth[i]))
        at[i] += sizes[i] * depth[i]
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise ValueError("reserved subframe type")
    some = np.flatnonzero(fixed | lpc)
    if len(some):
        some = some[np.argsort(-(sizes[some] - np.where(lpc[some], kind[some] - 31, kind[some] - 8)), kind="stable")]
        order = np.where(lpc[some], kind[some] - 31, kind[some] - 8)
        found, ends = _predicted(bits, at[some], sizes[some], depth[some], order, lpc[some])
        for j, i in enumerate(some.tolist()):
            out[i] = found[j]
        at[some] = ends
    return [x << w if w else x for x, w in zip(out, wasted.tolist())], at


def _predicted(bits: _Bits, at: np.ndarray, sizes: np.ndarray, depth: np.ndarray, order: np.ndarray, lpc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Fixed and LPC subframes, with those of most residuals first."""
    n, most = len(at), int(order.max())
    count = sizes - order
    if (count < 0).any():
        raise ValueError("a predictor longer than its block")
    samples = np.zeros((most + int(count[0]), n), np.int64)
    for j in range(most):  # warm-up samples stand right before the first residual
        has = np.flatnonzero(order > j)
        samples[most - order[has] + j, has] = bits.signed(at[has] + j * depth[has], depth[has])
    at = at + order * depth
    coef, shift = np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    q = np.flatnonzero(lpc)
    width = bits.take(at[q], 4) + 1
    shift[q] = bits.signed(at[q] + 4, 5)
    if (width == 16).any() or (shift < 0).any():
        raise ValueError("reserved predictor precision or shift")
    for j in range(most):
        has = order[q] > j
        coef[j, q[has]] = bits.signed(at[q[has]] + 9 + j * width[has], width[has])
    at[q] += 9 + order[q] * width
    for i in np.flatnonzero(~lpc).tolist():
        coef[: order[i], i] = FIXED[order[i]]
    method, parts = bits.take(at, 2), bits.take(at + 2, 4)
    if (method > 1).any() or ((sizes >> parts) << parts != sizes).any() or ((sizes >> parts) < order).any():
        raise ValueError("reserved or impossible residual coding")
    at += 6
    step = sizes >> parts
    rice_bits, last = 4 + method, (np.int64(1) << 4 + method) - 1
    k, raw, change, before = np.zeros(n, np.uint64), np.full(n, -1, np.int64), np.zeros(n, np.int64), order.copy()
    live = np.searchsorted(-count, -np.arange(int(count[0])), "left")
    one, top, rest = np.uint64(1), np.uint64(48), np.uint64(63)
    due = 0
    for t, a in enumerate(live.tolist()):
        while t == due:  # some frames begin a partition
            new = np.flatnonzero(change[:a] == t)
            value = bits.take(at[new], rice_bits[new])
            at[new] += rice_bits[new]
            escaped = value == last[new]
            raw[new], k[new] = -1, value.astype(np.uint64)
            e = new[escaped]
            raw[e] = bits.take(at[e], 5)
            at[e] += 5
            change[new] += step[new] - before[new]  # the first partition lacks the warm-up samples
            before[new] = 0
            due = int(change[:a].min())
        p, kk = at[:a], k[:a]
        w = bits.words[np.minimum(p >> 3, bits.most)].astype(np.uint64) << (p & 7).astype(np.uint64)
        zeros = _ZEROS[(w >> top).astype(np.int64)].astype(np.int64)
        far = np.flatnonzero(zeros == 16)
        if len(far):
            for i in far[raw[far] < 0].tolist():
                z, spot = 0, int(p[i])
                while True:
                    x = int(bits.window(np.array([spot]))[0]) >> 8
                    if x:
                        z += 56 - x.bit_length()
                        break
                    z, spot = z + 56, spot + 56
                    if spot >> 3 > bits.most:
                        raise ValueError("the stream ends early")
                zeros[i] = z
        z = zeros.astype(np.uint64)
        u = ((w << (np.minimum(z, rest) + one)) >> one) >> (rest - kk)
        if len(far):
            u[far] = (bits.window(p[far] + zeros[far] + 1) >> one) >> (rest - kk[far])
        u = (u | z << kk).astype(np.int64)
        r = u >> 1 ^ -(u & 1)
        ahead = zeros + 1 + kk.astype(np.int64)
        if (raw[:a] >= 0).any():
            e = np.flatnonzero(raw[:a] >= 0)
            r[e], ahead[e] = bits.signed(p[e], raw[e]), raw[e]
        at[:a] += ahead
        if most:
            past = samples[t : t + most, :a][::-1]
            r += (past * coef[:, :a]).sum(axis=0) >> shift[:a]
        samples[most + t, :a] = r
    return [samples[most - o : most + c, i] for i, (o, c) in enumerate(zip(order.tolist(), count.tolist()))], at


def decode_streams(media: list[bytes], verify: bool = True) -> list[tuple[_Stream, list[tuple[int, np.ndarray]]]]:
    """For each stream its metadata and frames (first sample, samples by channel), in order."""
    streams = [_Stream(m) for m in media]
    out: list[tuple[_Stream, list]] = [(s, []) for s in streams]
    joined = np.frombuffer(b"".join(media), np.uint8)
    bits, base = _Bits(joined), np.concatenate(([0], np.cumsum([len(m) for m in media]))).tolist()
    wave = [(i, s.body + x) for i, s in enumerate(streams) for x in (s.frames if s.frames is not None else [0] if s.total or len(media[i]) > s.body else [])]
    while wave:
        heads = [_Frame(media[i], at, streams[i]) for i, at in wave]
        starts = np.array([base[i] + at for i, at in wave], np.int64)
        at = (starts + np.array([h.head for h in heads])) * 8
        sizes, depth = np.array([h.size for h in heads]), np.array([h.bits for h in heads])
        mode, channels = np.array([h.mode for h in heads]), np.array([h.channels for h in heads])
        got: list[list[np.ndarray]] = [[] for _ in wave]
        for c in range(int(channels.max())):
            some = np.flatnonzero(channels > c)
            side = ((mode[some] == 8) & (c == 1)) | ((mode[some] == 9) & (c == 0)) | ((mode[some] == 10) & (c == 1))
            found, at[some] = _subframes(bits, at[some], sizes[some], depth[some] + side)
            for j, x in zip(some.tolist(), found):
                got[j].append(x)
        ends = (at + 7) >> 3
        if verify:
            limit = np.array([base[i + 1] for i, _ in wave])
            if (ends + 2 > limit).any():
                raise ValueError("the stream ends early")
            crc = crc16(joined, starts, ends - starts)
            if (crc != joined[ends].astype(np.uint32) << 8 | joined[ends + 1]).any():
                raise ValueError("a frame's CRC-16 is wrong")
        following = []
        for j, ((i, _), h) in enumerate(zip(wave, heads)):
            x = np.stack(got[j])
            if h.mode == 8:
                x[1] = x[0] - x[1]
            elif h.mode == 9:
                x[0] = x[0] + x[1]
            elif h.mode == 10:
                mid = x[0] << 1 | x[1] & 1
                x[0], x[1] = mid + x[1] >> 1, mid - x[1] >> 1
            out[i][1].append((h.first, x))
            after = int(ends[j]) + 2 - base[i]
            if streams[i].frames is None and after < len(media[i]):
                following.append((i, after))
        wave = following
    for s, frames in out:
        got_n = sum(x.shape[1] for _, x in frames)
        if s.total and got_n != s.total:
            raise ValueError("samples are missing")
        if verify and any(s.md5):
            width = (s.bits + 7) // 8
            raw = b"".join(np.ascontiguousarray(x.T).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() for _, x in frames)
            if hashlib.md5(raw, usedforsecurity=False).digest() != s.md5:
                raise ValueError("the stream's MD5 is wrong")
    return out


def pcm(stream: _Stream, samples: np.ndarray) -> bytes:
    """Interleaved little-endian PCM: unsigned up to 8 bits, as in WAV, else signed."""
    width = (stream.bits + 7) // 8
    x = np.ascontiguousarray(samples.T) + (128 if width == 1 else 0)
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's padded UTF-8 bytes as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, CHUNK):
            data, offsets = utf8(batch.column(1))
            raw = data.tobytes()
            media = encode_payloads([payload(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def _blocks(media: list[bytes]) -> Iterator[tuple[int, _Stream, list[tuple[int, int, bytes]]]]:
    """(place, stream, PCM blocks) of each stream; a block has the sample where a seek lands, its samples, and their bytes."""
    for i, (stream, frames) in enumerate(decode_streams(media)):
        yield i, stream, [(first, x.shape[1], pcm(stream, x)) for first, x in frames]


def pcm_blocks(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, block, first_sample, n_samples, pcm): a row for each frame; first_sample is where a seek lands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, CHUNK):
            known = batch.filter(batch.column(1).is_valid())
            keys, rows = known.column(0).to_pylist(), []
            for i, _, found in _blocks(known.column(1).to_pylist()):
                rows += [(keys[i], b, *block) for b, block in enumerate(found)]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary())], names=["id", "block", "first_sample", "n_samples", "pcm"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, block long, first_sample long, n_samples long, pcm binary")


DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest_rows(media: list[bytes]) -> list[tuple]:
    rows = []
    for i, stream, found in _blocks(media):
        starts = np.cumsum([0] + [n for _, n, _ in found])
        if [first for first, *_ in found] != starts[:-1].tolist():
            raise ValueError("the blocks' sample offsets have gaps")
        raw = b"".join(x for *_, x in found)
        x = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
        crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
        text = f"rate={stream.rate};frames={len(found)};mean={x.mean() if len(x) else 0:.6f};power={(x * x).mean() if len(x) else 0:.6f};crossings={crossings}"
        rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), text))
    return rows


def _digest_batch(fore: list[pa.Array], names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(fore + columns, names=names + [x.split()[0] for x in DIGESTS.split(", ")])


def digests(df: DataFrame, id_col: str = "id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each stream, from its PCM blocks.

    feature: sample rate, frames, mean level, mean power, and how often the
    signal crosses its middle.  Null media give no row.
    """
    names = ["id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(names), CHUNK):
            known = batch.filter(batch.column(len(names)).is_valid())
            yield _digest_batch(known.columns[:-1], names, _digest_rows(known.column(len(names)).to_pylist()))

    kinds = [f"`{n}` {df.schema[c].dataType.simpleString()}" for n, c in zip(names, [id_col, *keep])]
    return df.select(F.col(id_col).alias("id"), *keep, F.col(media_col).alias("media")).mapInArrow(run, ", ".join([*kinds, DIGESTS]))


def stored_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shares: int = SHARES) -> DataFrame:
    """n_bytes and the digests of every text's stream, which is written to the shared folder and read back.

    The media column is larger than its source, so it is stored in `shares`
    parts, dealt by a hash of id and text: each is written, read back for its
    digests, which are written too, and then deleted.
    """
    found = None
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for i in range(shares):
        media = save(encode_column(rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(shares)) == i), "id"), "media", "none")
        part = save(digests(media, keep=("n_bytes",)), "digests")
        discard(media)
        found = part if found is None else found.unionByName(part)
    return found
