import hashlib
import random
import zlib

import numpy as np
import pytest

from caseloom.llm import flac


class Bits:
    """A bit writer, for streams with features that the encoder doesn't use."""

    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - i)) & 1 for i in range(width)]

    def bytes(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


def plain_crc(data, width, poly):
    c = 0
    for b in data:
        c ^= b << width - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c >> width - 1 & 1 else c << 1) & (1 << width) - 1
    return c


def put_subframe(w, x, depth, rng):
    waste = 0
    if any(x) and all(v % 4 == 0 for v in x):
        waste, x, depth = 2, [v >> 2 for v in x], depth - 2
    kind = rng.choice(["verbatim", "fixed", "lpc", "lpc"]) if len(set(x)) > 1 else "constant"
    order = {"fixed": rng.randrange(5), "lpc": rng.choice([1, 3, 12])}.get(kind, 0)
    if order >= len(x):
        kind, order = "verbatim", 0
    code = {"constant": 0, "verbatim": 1, "fixed": 8 | order, "lpc": 32 | order - 1}[kind]
    w.put(code << 1 | (waste > 0), 8)
    if waste:
        w.put(1, waste)
    if kind in ("constant", "verbatim"):
        for v in x[:1] if kind == "constant" else x:
            w.put(v, depth)
        return
    for v in x[:order]:
        w.put(v, depth)
    coef, shift = list(flac.FIXED[order]) if kind == "fixed" else [rng.randrange(-60, 60) for _ in range(order)], 0 if kind == "fixed" else 5
    if kind == "lpc":
        w.put(7 - 1, 4)
        w.put(shift, 5)
        for c in coef:
            w.put(c, 7)
    res = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coef)) >> shift) for i in range(order, len(x))]
    parts = rng.choice([p for p in range(4) if len(x) % (1 << p) == 0 and len(x) >> p >= order])
    method = rng.randrange(2)
    w.put(method, 2)
    w.put(parts, 4)
    at = 0
    for part in range(1 << parts):
        size = (len(x) >> parts) - (order if part == 0 else 0)
        run = res[at : at + size]
        at += size
        if rng.random() < 0.3:
            width = max([1] + [v.bit_length() + 1 for v in run]) if any(run) else 0
            w.put((1 << 4 + method) - 1, 4 + method)
            w.put(width, 5)
            for v in run:
                w.put(v, width)
            continue
        top = max([v << 1 if v >= 0 else -2 * v - 1 for v in run] or [0])
        k = max(0, min(14, top.bit_length() - rng.choice([2, 4, 7])))
        w.put(k, 4 + method)
        for v in run:
            u = v << 1 if v >= 0 else -2 * v - 1
            w.put(1, (u >> k) + 1)
            w.put(u, k)


def stream(samples, depth, rng, seek):
    """samples: list of channels; a stream of blocks of 16 to 300 samples."""
    n, channels, frames, at, number = len(samples[0]), len(samples), [], 0, 0
    points = []
    size = rng.choice([16, 64, 300])
    while at < n:
        block = [c[at : at + size] for c in samples]
        mode = rng.choice([1, 8, 9, 10]) if channels == 2 else channels - 1
        w = Bits()
        head = bytes([0xFF, 0xF8, 0x70, mode << 4]) + flac._coded_number(number) + (len(block[0]) - 1).to_bytes(2, "big")
        head += bytes([plain_crc(head, 8, 7)])
        for b in head:
            w.put(b, 8)
        a, b = (block + [None])[:2]
        coded = {8: lambda: [a, [p - q for p, q in zip(a, b)]], 9: lambda: [[p - q for p, q in zip(a, b)], b], 10: lambda: [[p + q >> 1 for p, q in zip(a, b)], [p - q for p, q in zip(a, b)]]}.get(mode, lambda: block)()
        for c, x in enumerate(coded):
            put_subframe(w, x, depth + ((mode, c) in ((8, 1), (9, 0), (10, 1))), rng)
        body = w.bytes()
        points.append((at, sum(map(len, frames)), len(block[0])))
        frames.append(body + plain_crc(body, 16, 0x8005).to_bytes(2, "big"))
        at, number = at + size, number + 1
    raw = b"".join(v.to_bytes((depth + 7) // 8, "little", signed=True) for row in zip(*samples) for v in row)
    info = size.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | channels - 1 << 41 | depth - 1 << 36 | n).to_bytes(8, "big") + hashlib.md5(raw).digest()
    table = b"".join(a.to_bytes(8, "big") + b.to_bytes(8, "big") + c.to_bytes(2, "big") for a, b, c in points)
    more = bytes([0x83]) + len(table).to_bytes(3, "big") + table if seek else bytes([0x81, 0, 0, 2, 0, 0])
    return b"fLaC" + bytes([0, 0, 0, 34]) + info + more + b"".join(frames)


def test_decodes_every_kind_of_subframe():
    rng = random.Random(7)
    wanted, media = [], []
    for i in range(60):
        depth, channels, n = rng.choice([8, 12, 16, 24]), rng.choice([1, 2, 2, 3]), rng.choice([1, 17, 64, 640, 901])
        top = (1 << depth - 1) - 1
        step = rng.choice([3, 40, top])
        data = []
        for _ in range(channels):
            v, x = 0, []
            for _ in range(n):
                v = max(-top, min(top, v + rng.randrange(-step, step + 1)))
                x.append(v)
            data.append([v // 4 * 4 for v in x] if i % 5 == 0 else [7] * n if i % 11 == 0 else x)
        wanted.append(data)
        media.append(stream(data, depth, rng, seek=i % 2 == 0))
    for data, (s, frames) in zip(wanted, flac.decode_streams(media)):
        assert np.concatenate([x for _, x in frames], axis=1).tolist() == data
        assert [first for first, _ in frames] == [s.block * i for i in range(len(frames))]


def test_checksums_are_verified():
    media = flac.encode_payloads([b"some words " * 900])[0]
    body = flac._Stream(media).body
    for at in (body + 5, body + 300, len(media) - 1, 30):
        broken = bytearray(media)
        broken[at] ^= 16
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(broken)])
    with pytest.raises(ValueError):
        flac.decode_streams([media[:-3]])


def test_crc_tables():
    data = np.frombuffer(bytes(range(200)), np.uint8)
    starts, sizes = np.array([0, 5, 9]), np.array([10, 0, 150])
    assert flac.crc16(data, starts, sizes).tolist() == [plain_crc(data[a : a + n].tobytes(), 16, 0x8005) for a, n in zip(starts, sizes)]
    assert flac.crc8(b"abc") == plain_crc(b"abc", 8, 7)


def test_contract_and_blocks(spark):
    rng = random.Random(1)
    texts = [None, "", "x", "y" * 64, "é" * 4096, "long text, " * 3000, "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(5000))] + ["word " * n for n in range(1, 60)] + ["x"]
    docs = spark.createDataFrame([(i, t, b"n") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.id: r for r in flac.stored_digests(docs).collect()}
    two = {r.id: r for r in flac.digests(flac.encode_column(docs)).collect()}
    blocks = {}
    for r in flac.pcm_blocks(flac.encode_column(docs)).collect():
        blocks.setdefault(r.id, {})[r.first_sample] = r.pcm
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert all(r[c] == two[i][c] for c in two[i].asDict())
        assert b"".join(p for _, p in sorted(blocks[i].items())) == full and all(full[a : a + len(p)] == p for a, p in blocks[i].items())
    assert rows[2][2:] == rows[len(texts) - 1][2:]
    assert flac.stored_digests(docs.limit(0)).count() == 0 and flac.digests(spark.createDataFrame([(1, None)], "id long, media binary")).count() == 0


def test_whole_query_matches_brute_force(spark, tmp_path):
    from caseloom.llm.queries import op2_flac

    rng = random.Random(5)
    texts = [None, "", "x", "é" * 3000, "same text", "same text"] + ["".join(rng.choice("ab é漢\n") for _ in range(rng.randrange(9000))) for _ in range(40)]
    spark.createDataFrame([(i, t, b"n", 1) for i, t in enumerate(texts)], "doc_id long, text string, media binary, n_bytes int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op2_flac(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        media = flac.encode_payloads([full])[0]
        want = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(media), hashlib.sha256(media).hexdigest())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want
    assert rows[4].feature == rows[5].feature
