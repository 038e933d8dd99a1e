import hashlib
import zlib

import numpy as np
import pytest

from sketchloom.llm import media as m

from .conftest import ODD


@pytest.fixture(scope="module")
def payloads():
    rng = np.random.default_rng(3)
    made = [m.payload(t)[1] for t in (None, "", "x", "y" * 576, "é" * 300, "long " * 2000)]
    return [*made, rng.integers(0, 256, 576 * 40, dtype=np.uint8).tobytes(), b"\x00\xff" * 288, b"\xff" * 1152, b"\x00" * 576]


def test_round_trip(payloads):
    files = m.to_files(payloads)
    data, clips = m.from_files(files)
    assert data == payloads and all(x[0] == 0 for x in clips.firsts)
    assert [m.to_files([p])[0] for p in payloads] == files  # a file depends on its payload alone
    assert all(f[:4] == b"RIFF" and int.from_bytes(f[4:8], "little") == len(f) - 8 for f in files)


def scalar_decode(jpeg):
    """One frame, one bit at a time, straight from the standard's procedure."""
    table, a, b = m.parse_frame(jpeg)
    codes = {(c, n): v for v, (c, n) in m.huffman(table[:16], table[16:]).items()}
    bits = "".join(f"{x:08b}" for x in jpeg[a:b].replace(b"\xff\x00", b"\xff"))
    at, out = 0, np.zeros((m.SIDE, m.SIDE), int)
    for y in range(m.SIDE):
        for x in range(m.SIDE):
            n = 1
            while (int(bits[at : at + n], 2), n) not in codes:
                n += 1
            size, at = codes[int(bits[at : at + n], 2), n], at + n
            v = int(bits[at : at + size], 2) if size else 0
            at += size
            d = v if not size or v >> (size - 1) else v - (1 << size) + 1
            before = 128 if not x and not y else out[y - 1, 0] if not x else out[y, x - 1]
            out[y, x] = (before + d) & 255
    return out


def test_frames_by_the_bit(payloads):
    frames = m.encode_frames(np.frombuffer(payloads[6] + payloads[5][:576], np.uint8).reshape(-1, m.SIDE, m.SIDE))
    want = m.decode_frames(frames)
    for i in (0, 7, len(frames) - 1):
        assert (scalar_decode(frames[i]) == want[i]).all() and frames[i][:2] == b"\xff\xd8" and frames[i][-2:] == b"\xff\xd9"
    assert b"\xff" not in b"".join(f[len(m.jpeg_header()) : -2].replace(b"\xff\x00", b"") for f in frames)


def test_shots():
    dark, bright = np.full(576, 20, np.uint8), np.full(576, 200, np.uint8)
    frames = np.concatenate([np.tile(dark, 5), np.tile(bright, 4), np.tile(dark, 3)]).reshape(-1, 24, 24)
    clips = m.find_shots(np.concatenate([frames, frames[:2]]), [12, 2])
    assert clips.firsts == [[0, 5, 9], [0]] and clips.means == [[20, 200, 20], [20]]


def test_columns_and_clips(docs):
    frame = docs(ODD)
    made = m.media_column(frame)
    clips = m.clip_rows(made).collect()
    frames = {}
    for r in clips:
        assert r["end_ms"] - r["start_ms"] == r["n_frames"] * 1000 // m.FPS
        frames[r["doc_id"]] = frames.get(r["doc_id"], 0) + r["n_frames"]
    assert frames[5] == -(-150_000 // 576)
    rows = m.media_digest(frame).collect()
    assert len(rows) == len(ODD)
    texts = dict(ODD)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        pad = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
    assert m.media_digest(frame.where("false")).count() == 0


def test_refuses_other_files():
    with pytest.raises(ValueError):
        m.read_avi(b"RIFF\0\0\0\0WAVE")
    with pytest.raises(ValueError):
        m.read_avi(m.chunk(b"RIFF", b"AVI "))


def test_a_very_long_text(docs):
    text = "frames of a long text " * 500_000
    row = m.media_digest(docs([(1, text), (2, "x")])).where("doc_id = 1").first()
    assert row["n_bytes"] == len(text) and row["payload_bytes"] % m.FRAME == 0 and row["feature"]
