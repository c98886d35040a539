"""AVI motion-JPEG: writing, RIFF index parsing, intra-frame decoding and shot detection.

Frames are grey 32x32 baseline JPEGs.  A payload byte is one quantised DCT
coefficient (the format's lossless unit): byte b is the coefficient whose eight
magnitude bits are b, so a block holds 64 bytes, and the entropy-coded form
gives them back exactly.  A restart marker follows each block, so all blocks of
a batch are decoded together: every pass reads the next Huffman symbol of each
block through a 16-bit lookup table.  The decoder takes any baseline grey table
set with one block per restart interval.

Shots: grey histograms of consecutive frames differ by a normalised L1
distance; a cut is a distance above the mean plus CUT_SIGMA deviations of the
WINDOW distances before it, and above CUT_FLOOR.

Nulls count as empty texts, whose payload is 64 zero bytes.  Equal texts give
equal rows.  Payloads of any length are whole: they take as many frames as
needed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from stratawell.llm.arrow_map import map_batches
from stratawell.llm.bytes_np import slices, utf8

SIDE, BLOCK, FPS = 32, 64, 25
BLOCKS = (SIDE // 8) ** 2
WINDOW, CUT_SIGMA, CUT_FLOOR = 8, 1.5, 0.2
#: ITU T.81 figure A.6: zig-zag order of the coefficients of a block.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8) if (k // 8 + k % 8) % 2 else (k % 8))))


def _dct() -> np.ndarray:
    k, n = np.mgrid[0:8, 0:8]
    c = np.cos((2 * n + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


#: Zig-zag coefficients (64) to pixels (64).
IDCT = np.einsum("ux,vy->uvxy", _dct(), _dct()).reshape(64, 64)[ZIGZAG].astype(np.float32)

# Huffman tables: symbol lists by code length; magnitude size 8 has one bit, "nothing" (DC 0, end of block) two.
TABLES = {(0, 0): {1: [8], 2: [0]}, (1, 0): {1: [8], 2: [0]}}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    out = b"\xff\xd8" + _segment(0xDB, b"\0" + bytes([1] * 64))
    out += _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0]))
    for (kind, k), by_length in TABLES.items():
        counts = bytes(len(by_length.get(n, ())) for n in range(1, 17))
        out += _segment(0xC4, bytes([kind << 4 | k]) + counts + bytes(s for n in sorted(by_length) for s in by_length[n]))
    return out + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


HEAD = _jpeg_head()
#: A block without coefficients: DC size 0 ("10"), end of block ("10"), then ones.
EMPTY = bytes([0b10101111])


def encode_blocks(payload: np.ndarray) -> np.ndarray:
    """Entropy-coded blocks (n, 72) before byte stuffing, from n * 64 bytes in zig-zag order."""
    n = len(payload) // BLOCK
    bits = np.zeros((n, BLOCK, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(payload).reshape(n, BLOCK, 8)
    return np.packbits(bits.reshape(n, -1), axis=1)


def frames_of(blocks: np.ndarray) -> list[bytes]:
    """JPEG frames of BLOCKS blocks each; the last is filled up with empty ones."""
    out, stuffing = [], bool((blocks == 0xFF).any())
    for a in range(0, len(blocks), BLOCKS):
        part = blocks[a : a + BLOCKS]
        n = len(part)
        body = np.empty((n, 74), np.uint8)
        body[:, :72] = part
        body[:, 72] = 0xFF
        body[:, 73] = 0xD0 + np.arange(n) % 8
        if stuffing:
            scan = b"".join(r[:72].tobytes().replace(b"\xff", b"\xff\0") + r[72:].tobytes() for r in body)
        else:
            scan = body.tobytes()
        scan += b"".join(EMPTY + bytes([0xFF, 0xD0 + k % 8]) for k in range(n, BLOCKS))
        out.append(HEAD + scan[:-2] + b"\xff\xd9")
    return out


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], fps: int = FPS) -> bytes:
    """An AVI 1.0 file with one MJPG stream and an idx1 index."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<3I", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, a: int, z: int):
    while a + 8 <= z:
        tag, n = data[a : a + 4], struct.unpack_from("<I", data, a + 4)[0]
        yield tag, a + 8, min(a + 8 + n, z)
        a += 8 + n + n % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the video frames, by the idx1 index, or by the movi list where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FPS), None, []
    for tag, a, z in _chunks(data, 12, len(data)):
        if tag == b"LIST" and data[a : a + 4] == b"hdrl":
            for t, b, _ in _chunks(data, a + 4, z):
                if t == b"avih":
                    fps = 1e6 / max(1, struct.unpack_from("<I", data, b)[0])
        elif tag == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, z)
        elif tag == b"idx1":
            index = [struct.unpack_from("<4s3I", data, k) for k in range(a, z - 15, 16)]
    if movi is None:
        raise ValueError("no movi list")
    if index:
        base = movi[0] if data[movi[0] + index[0][2] : movi[0] + index[0][2] + 4] == index[0][0] else 0
        return fps, [data[base + at + 8 : base + at + 8 + n] for tag, _, at, n in index if tag[2:] in (b"dc", b"db")]
    return fps, [data[b:c] for t, b, c in _chunks(data, movi[0] + 4, movi[1]) if t[2:] in (b"dc", b"db")]


class Jpeg:
    """Header of a baseline grey JPEG and the restart segments of its scan."""

    _heads: dict[bytes, tuple] = {}

    def __init__(self, data: bytes):
        if data.startswith(HEAD):  # the usual header is parsed once
            if HEAD not in self._heads:
                self._heads[HEAD] = self._parse(HEAD)
            got = self._heads[HEAD]
        else:
            got = self._parse(data)
        self.height, self.width, self.quant, self.tables, self.scan = got
        body = data[self.scan : data.rindex(b"\xff\xd9")]
        raw = np.frombuffer(body, np.uint8)
        marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
        self.body, self.start, self.stop = body, np.concatenate([[0], marks + 2]), np.concatenate([marks, [len(raw)]])

    @staticmethod
    def _parse(data: bytes) -> tuple:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        at, quant, tables, size, interval = 2, {}, {}, None, 0
        while True:
            _, marker, n = struct.unpack_from(">BBH", data, at)
            a, z = at + 4, at + 2 + n
            if marker == 0xDB:
                while a < z:
                    wide, k = data[a] >> 4, data[a] & 15
                    quant[k] = np.frombuffer(data, ">u2" if wide else np.uint8, 64, a + 1).astype(np.float32)
                    a += 1 + 64 * (1 + wide)
            elif marker == 0xC0:
                _, h, w, parts = struct.unpack_from(">BHHB", data, a)
                if parts != 1:
                    raise ValueError("only grey frames are supported")
                size, q = (h, w), data[a + 8]
            elif marker == 0xC4:
                while a < z:
                    kind, counts = data[a], list(data[a + 1 : a + 17])
                    symbols = data[a + 17 : a + 17 + sum(counts)]
                    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
                    code = used = 0
                    for bits, m in enumerate(counts, 1):
                        for _ in range(m):
                            lo = code << (16 - bits)
                            length[lo : lo + (1 << (16 - bits))], symbol[lo : lo + (1 << (16 - bits))] = bits, symbols[used]
                            code, used = code + 1, used + 1
                        code <<= 1
                    tables[kind] = (length, symbol)
                    a += 17 + sum(counts)
            elif marker == 0xDD:
                interval = struct.unpack_from(">H", data, a)[0]
            elif marker == 0xDA:
                if interval != 1 or size is None:
                    raise ValueError("one block per restart interval is expected")
                return size[0], size[1], quant[q], (tables[data[a + 2] >> 4], tables[0x10 | data[a + 2] & 15]), z
            at = z


def decode_blocks(bodies: list[bytes], starts: np.ndarray, stops: np.ndarray, tables: tuple) -> np.ndarray:
    """Coefficients (n, 64) in zig-zag order of n restart segments that lie in the joined bodies."""
    data = np.frombuffer(b"".join([*bodies, bytes(9)]), np.uint8)
    stuffed = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0))
    stuffed = stuffed[: np.searchsorted(stuffed, stops[-1])] + 1 if len(stops) else stuffed
    if len(stuffed):
        drop = np.searchsorted(stuffed, starts), np.searchsorted(stuffed, stops)
        data, starts, stops = np.delete(data, stuffed), starts - drop[0], stops - drop[1]
    n = len(starts)
    out = np.zeros((BLOCK, n), np.int16)
    packed = [(length | (symbol & 15) << 8 | (symbol >> 4) << 16).astype(np.int32) for length, symbol in tables]
    # Eight bytes from each byte on, as one number: a symbol and its bits fit in whatever bit it starts at.
    window = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    at, live = starts * 8, np.arange(n)
    k = np.zeros(n, np.int32)
    first = True
    while len(live):
        bits64 = window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        entry = packed[0 if first else 1][bits64 >> np.uint64(48)]
        length, bits, run = entry & 255, (entry >> 8) & 255, entry >> 16
        if not length.all():
            raise ValueError("bad Huffman code")
        value = ((bits64 << length.astype(np.uint64)) >> np.uint64(48)).astype(np.int32) >> (16 - bits)
        value -= np.where((value >> np.maximum(bits - 1, 0)) == 0, (1 << bits) - 1, 0).astype(np.int32)
        at += length + bits
        k += run
        if len(live) == n and (k == k[0]).all() and k[0] < BLOCK and bits.all():
            out[k[0]] = value
        else:
            put = (bits > 0) & (k < BLOCK)
            out[k[put], live[put]] = value[put]
        k += 1
        stop = k >= BLOCK
        if not first:
            stop |= (bits == 0) & (run == 0)
        if stop.any():
            live, at, k = live[~stop], at[~stop], k[~stop]
        first = False
    return out.T


def payload_of(blocks: np.ndarray) -> np.ndarray:
    """The payload bytes that coefficients hold; filler blocks hold none."""
    full = blocks[blocks[:, 0] != 0]
    return np.where(full < 0, full + 255, full).astype(np.uint8).reshape(-1)


def pixels(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Grey samples (n, 64) of the blocks."""
    return np.clip(np.rint((blocks * quant) @ IDCT) + 128, 0, 255).astype(np.uint8)


def histograms(samples: np.ndarray, frames: int) -> np.ndarray:
    """Share of samples in 16 grey levels, for each frame."""
    level = (samples.reshape(frames, -1) >> 4).astype(np.int64) + 16 * np.arange(frames)[:, None]
    return np.bincount(level.ravel(), minlength=16 * frames).reshape(frames, 16) / level.shape[1]


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges [a, b) of the shots."""
    step = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, d in enumerate(step.tolist()):
        past = step[max(0, i - WINDOW) : i]
        if d > CUT_FLOOR and (not len(past) or d > past.mean() + CUT_SIGMA * past.std()):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(hist)]))


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % BLOCK if text else BLOCK)


def media_rows(texts: list[bytes]) -> list[dict]:
    """For each text: the stored AVI, the payload read back from it, and its shots."""
    payload = [padded(t) for t in texts]
    blocks = encode_blocks(np.frombuffer(b"".join(payload), np.uint8))
    ends = np.cumsum([len(p) // BLOCK for p in payload]).tolist()
    files = [write_avi(frames_of(blocks[a:z])) for a, z in zip([0, *ends], ends)]
    del blocks
    read = [read_avi(f) for f in files]
    jpegs = [Jpeg(f) for _, fs in read for f in fs]
    by_table: dict[int, list[int]] = {}
    for i, j in enumerate(jpegs):
        by_table.setdefault(id(j.tables), []).append(i)
    coefs: list[np.ndarray] = [None] * len(jpegs)
    hists = np.zeros((len(jpegs), 16))
    for group in by_table.values():
        base = np.cumsum([0, *(len(jpegs[i].body) for i in group)])
        starts, stops = (np.concatenate([getattr(jpegs[i], what) + b for i, b in zip(group, base)]) for what in ("start", "stop"))
        got = decode_blocks([jpegs[i].body for i in group], starts, stops, jpegs[group[0]].tables)
        count = [len(jpegs[i].start) for i in group]
        if len(set(count)) == 1:
            hists[group] = histograms(pixels(got, jpegs[group[0]].quant), len(group))
        for i, a, m in zip(group, np.cumsum([0, *count]), count):
            coefs[i] = got[a : a + m]
            if len(set(count)) > 1:
                hists[i] = histograms(pixels(coefs[i], jpegs[i].quant), 1)[0]
    out, k = [], 0
    for text, f, (fps, fs) in zip(texts, files, read):
        back = payload_of(np.concatenate(coefs[k : k + len(fs)])).tobytes()
        clips = [(a / fps, b / fps) for a, b in shots(hists[k : k + len(fs)])]
        mean = hists[k : k + len(fs)].mean(axis=0) @ (np.arange(16) * 16 + 8)
        out.append({"media": f, "payload": back, "n_bytes": len(text), "clips": clips, "frames": len(fs), "grey": float(mean)})
        k += len(fs)
    return out


def store_frame(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, media (the AVI file), n_bytes and clips (start_s, end_s) of each row."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_bytes bigint, media binary, clips array<struct<start_s: double, end_s: double>>"

    def make():
        def work(batch):
            for a, b, texts in text_runs(batch):
                rows = media_rows(texts)
                yield {k: batch.column(i).slice(a, b - a) for i, k in enumerate(keys)} | {"n_bytes": [r["n_bytes"] for r in rows], "media": [r["media"] for r in rows], "clips": [[{"start_s": x, "end_s": y} for x, y in r["clips"]] for r in rows]}

        return work

    return map_batches(df.select(*[F.col(k) for k in keys], F.col(text).alias("__text")), make, schema)


def text_runs(batch):
    data, offsets = utf8(batch.column(batch.num_columns - 1))
    raw = data.tobytes()
    for a, b in slices(offsets, 1 << 20):
        yield a, b, [raw[offsets[i] : offsets[i + 1]] for i in range(a, b)]


def clip_rows(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per shot of each stored file: clip number and times."""
    return stored.select(key, F.posexplode("clips").alias("clip", "c")).select(key, "clip", "c.start_s", "c.end_s")


def op9_avi_shots(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def make():
        def work(batch):
            for a, b, texts in text_runs(batch):
                rows = media_rows(texts)
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_bytes": [r["n_bytes"] for r in rows],
                    "payload_bytes": [len(r["payload"]) for r in rows],
                    "payload_sha256": [sha(r["payload"]) for r in rows],
                    "tail_crc32": [zlib.crc32(r["payload"][-64:]) for r in rows],
                    "media_bytes": [len(r["media"]) for r in rows],
                    "media_sha256": [sha(r["media"]) for r in rows],
                    "feature": [f"frames={r['frames']};shots={len(r['clips'])};grey={r['grey']:.3f};cuts=" + ",".join(f"{x:.2f}" for x, _ in r["clips"][1:]) for r in rows],
                    "n_clips": [len(r["clips"]) for r in rows],
                    "duration_s": [r["clips"][-1][1] for r in rows],
                }

        return work

    return map_batches(docs, make, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_clips bigint, duration_s double")
