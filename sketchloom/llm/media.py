"""Media columns: motion-JPEG in AVI, written and read without any codec library.

A payload becomes grey frames of 24 x 24 samples of 8 bits, each an intra frame in JPEG's lossless process (SOF3, predictor 1), so samples
come back exactly; frames are chunks of a RIFF/AVI file with an index. Reading parses the RIFF lists, finds the frames by the index,
and decodes all frames of a batch side by side: each numpy step takes one Huffman code of every frame. Shots are cut where the
difference of two frames' histograms stands out from that of the frames around (an adaptive threshold, in
integers only), and each shot is a timed clip row.

A null text counts as empty; its payload is one frame of filling. Long texts are many frames and are worked on in slices of
bounded size. Equal payloads give equal files. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices_by_bytes, slices_of

SIDE = 24
FRAME = SIDE * SIDE
FILL = 255
FPS = 25
SLICE = 3_000_000
BINS = 16
NEAR = 8
LEAST = FRAME // 8

#: Huffman table: categories 0 to 8 of a difference and how many codes there are of each length. Text moves by 2 to 6 bits mostly.
CATEGORIES = bytes([4, 5, 3, 2, 7, 6, 1, 0, 8])
LENGTHS = bytes([0, 0, 7, 1, 1, *[0] * 11])


def huffman(lengths: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """Canonical codes: value -> (code, length)."""
    out, code, at = {}, 0, 0
    for size, n in enumerate(lengths, 1):
        for v in values[at : at + n]:
            out[v] = (code, size)
            code += 1
        at, code = at + n, code << 1
    return out


def jpeg_header() -> bytes:
    dht = b"\xff\xc4" + struct.pack(">HB", 19 + len(CATEGORIES), 0) + LENGTHS + CATEGORIES
    sof = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    sos = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
    return b"\xff\xd8" + dht + sof + sos


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG files of frames (n, SIDE, SIDE) of bytes."""
    n = len(samples)
    x = samples.astype(np.int32)
    before = np.empty_like(x)
    before[:, :, 1:] = x[:, :, :-1]
    before[:, 1:, 0] = x[:, :-1, 0]
    before[:, 0, 0] = 128
    d = (x - before).reshape(n, FRAME)
    size_of = np.zeros(256, dtype=np.int64)
    for k in range(1, 9):
        size_of[1 << (k - 1) : 1 << k] = k
    table = huffman(LENGTHS, CATEGORIES)
    code, length = (np.array([table[c][j] for c in range(9)], dtype=np.int64) for j in (0, 1))
    size = size_of[np.abs(d)]
    bits = np.where(d >= 0, d, d + (1 << size) - 1)
    value, width = (code[size] << size) | bits, length[size] + size
    total = width.sum(axis=1)
    room = (total + 7) // 8
    begin = np.concatenate([[0], np.cumsum(room)])
    at = (np.cumsum(width, axis=1) - width + 8 * begin[:-1, None]).ravel()
    shifted = value.ravel() << (24 - (at & 7) - width.ravel())  # at most 13 + 7 bits
    byte, m = at >> 3, int(begin[-1]) + 2
    packed = sum(np.bincount(byte + j, (shifted >> (16 - 8 * j)) & 255, m) for j in range(3)).astype(np.int64)
    packed[begin[1:] - 1] |= (1 << (8 * room - total)) - 1  # filled up with ones
    packed = packed[: begin[-1]].astype(np.uint8)
    stuffed = packed == 255
    place = np.arange(len(packed)) + np.cumsum(stuffed) - stuffed
    out = np.zeros(len(packed) + int(stuffed.sum()), dtype=np.uint8)
    out[place] = packed
    edge = np.concatenate([[0], np.cumsum(stuffed)])[begin] + begin
    blob, head = out.tobytes(), jpeg_header()
    edges = edge.tolist()
    return [head + blob[a:b] + b"\xff\xd9" for a, b in zip(edges, edges[1:], strict=False)]


def parse_frame(jpeg: bytes) -> tuple[bytes, int, int]:
    """(DHT contents, begin and end of the scan) of a lossless one-component frame of the expected size."""
    at, table = 2, b""
    while True:
        marker, size = struct.unpack_from(">HH", jpeg, at)
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFFC4:
            table = body[1:]
        elif marker == 0xFFC3:
            if struct.unpack(">BHHB", body[:6]) != (8, SIDE, SIDE, 1):
                raise ValueError("unexpected frame")
        elif marker == 0xFFDA:
            if body[3] != 1:
                raise ValueError("unexpected predictor")
            return table, at, len(jpeg) - 2


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Category and code length for every next 16 bits."""
    kind, length = np.zeros(65536, dtype=np.int64), np.zeros(65536, dtype=np.int64)
    for v, (code, size) in huffman(table[:16], table[16:]).items():
        kind[code << (16 - size) : (code + 1) << (16 - size)] = v
        length[code << (16 - size) : (code + 1) << (16 - size)] = size
    return kind, length


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """Samples (n, SIDE, SIDE) of lossless JPEG files, all decoded side by side."""
    parsed = [parse_frame(j) for j in jpegs]
    tables = {t for t, _, _ in parsed}
    if len(tables) > 1:
        out = np.empty((len(jpegs), SIDE, SIDE), dtype=np.uint8)
        for t in tables:
            own = [i for i, p in enumerate(parsed) if p[0] == t]
            out[own] = decode_frames([jpegs[i] for i in own])
        return out
    scans = [j[a:b].replace(b"\xff\x00", b"\xff") for j, (_, a, b) in zip(jpegs, parsed, strict=True)]
    data = np.frombuffer(b"".join(scans) + bytes(8), dtype=np.uint8).astype(np.int64)
    word = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    kind, length = lookup(tables.pop())
    at = 8 * np.concatenate([[0], np.cumsum([len(s) for s in scans])[:-1]])
    d = np.empty((FRAME, len(jpegs)), dtype=np.int64)
    for i in range(FRAME):
        window = (word[at >> 3] << (at & 7)) & 0xFFFFFFFF
        top = window >> 16
        size, used = kind[top], length[top]
        bits = (window >> (32 - used - size)) & ((1 << size) - 1)
        d[i] = np.where(bits >> np.maximum(size - 1, 0) != 0, bits, bits - (1 << size) + 1)
        at = at + used + size
    d = d.T.reshape(-1, SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """A RIFF/AVI file of one video stream of the given JPEG frames, with its index."""
    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 0, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    parts, index, at = [], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    body = head + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", b"AVI " + body)


def read_avi(media: bytes) -> list[bytes]:
    """The frames of the video stream, in the order of the index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    return [media[movi + o + 8 : movi + o + 8 + n] for name, _, o, n in struct.iter_unpack("<4sIII", index) if name[2:] == b"dc"]


@dataclass
class Clips:
    """First frame of every shot of every file, and the mean sample of each shot (rounded down)."""

    firsts: list[list[int]]
    means: list[list[int]]


def find_shots(samples: np.ndarray, counts: list[int]) -> Clips:
    """Shots of consecutive frames of several files; counts: frames of each file.

    A cut lies before frame i if its histogram differs from frame i - 1's by over LEAST samples and by over twice the mean difference
    of up to NEAR frames on either side."""
    n = len(samples)
    levels = samples.reshape(n, FRAME) >> 4
    hist = np.bincount((levels + np.arange(n)[:, None] * BINS).ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.zeros(n, dtype=np.int64)
    diff[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1) // 2
    begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    diff[begin[:-1]] = 0
    own = np.repeat(np.arange(len(counts)), counts)
    lo, hi = np.maximum(begin[own] + 1, np.arange(n) - NEAR), np.minimum(begin[own + 1], np.arange(n) + NEAR + 1)
    sums = np.concatenate([[0], np.cumsum(diff)])
    around, others = sums[np.maximum(hi, lo)] - sums[lo] - diff, np.maximum(hi - lo - 1, 1)
    cut = (diff > LEAST) & (diff * others > 2 * around)
    cut[begin[:-1]] = True
    first = np.flatnonzero(cut)
    light = np.add.reduceat(samples.reshape(n, FRAME).sum(axis=1, dtype=np.int64), first) // (np.diff(np.append(first, n)) * FRAME)
    of = np.searchsorted(first, begin)
    local = first - begin[own[first]]
    return Clips(*([x[a:b].tolist() for a, b in zip(of, of[1:], strict=False)] for x in (local, light)))


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes([FILL]) * ((-len(raw)) % FRAME if raw else FRAME)


def to_files(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads whose sizes are multiples of FRAME."""
    frames = encode_frames(np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, SIDE, SIDE))
    edge = np.concatenate([[0], np.cumsum([len(p) // FRAME for p in payloads])]).tolist()
    return [write_avi(frames[a:b]) for a, b in zip(edge, edge[1:], strict=False)]


def from_files(files: list[bytes]) -> tuple[list[bytes], Clips]:
    """Payloads and shots of AVI files."""
    listed = [read_avi(f) for f in files]
    samples = decode_frames([f for fs in listed for f in fs])
    counts = [len(fs) for fs in listed]
    edge = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return [samples[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], find_shots(samples, counts)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media binary (an AVI file)."""

    def run(batches):
        for b in slices_of(batches, SLICE):
            made = [payload(t) for t in b.column("text").to_pylist()]
            ids = b.column("doc_id").cast(pa.int64())
            for lo, hi in slices_by_bytes([len(p) for _, p in made], SLICE):
                files = to_files([p for _, p in made[lo:hi]])
                cols = [ids.slice(lo, hi - lo), pa.array([n for n, _ in made[lo:hi]], pa.int64()), pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


CLIP = pa.schema([("doc_id", pa.int64()), ("clip", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("n_frames", pa.int64()), ("mean", pa.int64())])


def clip_rows(media: DataFrame) -> DataFrame:
    """Timed clip rows doc_id, clip, start_ms, end_ms, n_frames, mean of rows with doc_id and media; a null media has none."""

    def run(batches):
        for b in batches:
            rows = [(i, m) for i, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True) if m is not None]
            for lo, hi in slices_by_bytes([len(m) for _, m in rows], SLICE):
                data, clips = from_files([m for _, m in rows[lo:hi]])
                out = []
                for (i, _), d, firsts, means in zip(rows[lo:hi], data, clips.firsts, clips.means, strict=True):
                    for k, (x, y, mean) in enumerate(zip(firsts, [*firsts[1:], len(d) // FRAME], means, strict=True)):
                        out.append((i, k, x * 1000 // FPS, y * 1000 // FPS, y - x, mean))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=CLIP)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip long, start_ms long, end_ms long, n_frames long, mean long")


DIGEST = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ]
)


def media_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op5: the files are made, read back and taken apart in one pass, so that they are never shuffled.
    feature: ``first frame:mean`` of every clip."""

    def run(batches):
        for b in slices_of(batches, SLICE):
            made = [payload(t) for t in b.column("text").to_pylist()]
            ids = b.column("doc_id").to_pylist()
            for lo, hi in slices_by_bytes([len(p) for _, p in made], SLICE):
                files = to_files([p for _, p in made[lo:hi]])
                data, clips = from_files(files)
                out = [
                    (i, n, len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-32:]), len(f), hashlib.sha256(f).hexdigest(), ",".join(f"{x}:{m}" for x, m in zip(firsts, means, strict=True)))
                    for i, (n, _), f, d, firsts, means in zip(ids[lo:hi], made[lo:hi], files, data, clips.firsts, clips.means, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DIGEST, strict=True)], schema=DIGEST)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)
