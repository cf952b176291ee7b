"""GIF round trips, foreign code streams, disposal and transparency."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from answerscore.llm import gif


@pytest.mark.parametrize("n", [64, 128, 64 * 247, 64 * 4096, 64 * 4096 + 64, 64 * 9000])
def test_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    frames = list(gif.decode(gif.encode(payload)))
    assert b"".join(f.samples.tobytes() for f in frames) == payload
    assert [f.start for f in frames] == [gif.DELAY * i for i in range(len(frames))]
    colours = np.frombuffer(gif._COLOURS, np.uint8).reshape(256, 3)
    assert len({tuple(c) for c in colours.tolist()}) == 256
    for f in frames:
        h = len(f.samples)
        assert (f.rgba[:h, :, :3] == colours[f.samples]).all() and not f.rgba[h:].any()


def compress(samples, least):
    """A plain LZW encoder with growing codes, as other writers have it."""
    clear, bits, n, out = 1 << least, 0, 0, bytearray()
    table, width, following = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2

    def put(code):
        nonlocal bits, n
        bits |= code << n
        n += width
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8

    put(clear)
    word = b""
    for s in samples:
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        put(table[word])
        if following < 4096:
            table[word + bytes([s])] = following
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        else:
            put(clear)
            table, width, following = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2
        word = bytes([s])
    put(table[word])
    put(clear + 1)
    return bytes(out) + bytes([bits & 255])


@pytest.mark.parametrize("least, n", [(2, 500), (4, 20000), (8, 60000)])
def test_growing_codes(least, n):
    samples = np.random.default_rng(n).integers(0, min(1 << least, 5), n).astype(np.uint8)
    assert (gif.lzw(compress(samples.tolist(), least), least, n) == samples).all()


@pytest.mark.parametrize("n", [64, 5000, 70000])
def test_written_streams_are_those_of_a_plain_encoder(n):
    for high in (3, 256):
        samples = np.random.default_rng(n).integers(0, high, n).astype(np.uint8)
        got, want = gif.compress(samples.tobytes()), compress(samples.tolist(), 8)
        assert got == want[: len(got)] and not any(want[len(got) :])
        assert (gif.lzw(got, 8, n) == samples).all() and len(gif.lzw(got, 8, 10)) == 10


def test_damaged_streams_are_an_error():
    good = np.array([1, 258, 259, 2, 3])  # a code may name the entry that it completes, but none behind it
    assert gif.expand(good, 258).tolist() == [1, 1, 1, 1, 1, 1, 2, 3]
    for bad in ([258], [1, 259], [1, 2, 300]):
        with pytest.raises(ValueError):
            gif.expand(np.array(bad), 258)


def test_full_table_without_a_clear_code():
    samples = np.random.default_rng(4).integers(0, 4, 60000).astype(np.uint8)
    clear, width, following, table, word, bits, n, out = 4, 3, 6, {bytes([i]): i for i in range(4)}, b"", 0, 0, bytearray()
    codes = [(clear, 3)]
    for s in samples.tolist():
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        codes.append((table[word], width))
        if following < 4096:
            table[word + bytes([s])] = following
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        word = bytes([s])
    for code, size in [*codes, (table[word], width), (clear + 1, width)]:
        bits |= code << n
        n += size
        while n >= 8:
            out.append(bits & 255)
            bits, n = bits >> 8, n - 8
    assert (gif.lzw(bytes(out) + bytes([bits & 255, 0]), 2, len(samples)) == samples).all()


def image(samples, w, h, left=0, top=0, disposal=0, clear=None, delay=3, palette=None):
    head = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
    head += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x80 | 1 if palette else 0) + (palette or b"")
    data = compress(samples, 2)
    return head + b"\x02" + bytes([len(data)]) + data + b"\0"


def layered():
    colours = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80 | 1, 0, 0) + colours
    data += image([1, 1, 1, 1], 2, 2) + image([2, 0], 2, 1, top=1, disposal=2, clear=0) + image([3], 1, 1, disposal=3) + image([0], 1, 1, left=1, palette=own) + b"\x3b"
    return data


def test_disposal_transparency_and_palettes():
    f = list(gif.decode(layered()))
    assert [x.start for x in f] == [0, 3, 6, 9]
    assert f[0].rgba[:, :, 0].tolist() == [[255, 255], [255, 255]]
    assert f[1].rgba[1].tolist() == [[0, 255, 0, 255], [255, 0, 0, 255]]  # clear pixels keep what is below
    assert f[2].rgba[1].tolist() == [[0, 0, 0, 0], [0, 0, 0, 0]] and f[2].rgba[0, 0].tolist() == [0, 0, 255, 255]
    assert f[3].rgba[0].tolist() == [[255, 0, 0, 255], [9, 9, 9, 255]]  # the frame before is restored


def test_stored_texts(spark):
    texts = [None, "", "é" * 40, "x" * 300_000, "x" * 300_000]
    rows = gif.features(gif.store(spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, media string"))).collect()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(gif.encode(payload)).hexdigest()
    assert len({r["feature"] for r in rows if r["doc_id"] > 2}) == 1
    assert gif.features(gif.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_frame_columns(spark):
    stored = gif.store(spark.createDataFrame([(1, "x" * 300_000)], "doc_id long, text string"))
    rows = gif.frame_columns(stored).orderBy("frame").collect()
    assert b"".join(r["samples"] for r in rows).rstrip(b"\0") == b"x" * 300_000
    assert sum(rows[0]["histogram"]) == rows[0]["width"] * rows[0]["height"] and rows[1]["start"] == gif.DELAY


def test_features_of_palettes_disposal_and_transparency(spark):
    r = gif.features(spark.createDataFrame([(1, 5, bytearray(layered()))], "doc_id long, n_bytes long, media binary")).first()

    def counts(*colours):
        out = [0] * 64
        for red, green, blue in colours:
            out[(red >> 6) * 16 + (green >> 6) * 4 + (blue >> 6)] += 1
        return out

    red, green, blue, grey = (255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9)
    want = [counts(red, red, red, red), counts(red, red, green, red), counts(blue, red), counts(red, grey)]
    assert [x["histogram"] for x in r["timed"]] == want and [(x["start"], x["delay"]) for x in r["timed"]] == [(0, 3), (3, 3), (6, 3), (9, 3)]
    assert r["feature"] == ",".join(map(str, np.sum(want, axis=0))) and (r["frames"], r["duration"], r["payload_bytes"]) == (4, 12, 8)
    assert r["payload_sha256"] == hashlib.sha256(bytes([1, 1, 1, 1, 2, 0, 3, 0])).hexdigest()
