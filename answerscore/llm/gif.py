"""Media columns: GIF animations, written and decoded.

:func:`encode` stores bytes as the samples of frames in 256 colours, compressed by LZW with growing code tables;
:func:`decode` reads any GIF87a/89a: it decodes the LZW code streams, applies local or global palettes, interlacing,
transparency and disposal rules, and returns timed frames with the composed picture.  How wide a code is depends only
on its number behind the last clear code, so bits are packed and unpacked by numpy, and Python runs once per code.

Colour histograms count the shown pixels of the composed picture in 64 ranges, two bits of red, green and blue each;
transparent pixels do not count.

Defined results: null and empty texts are stored as one row of zeros; payloads of any length are cut into frames of
``ROWS`` rows; repeated rows give equal values; ids are whole numbers; empty tables give empty results; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

WIDTH, ROWS, DELAY = 64, 4096, 10
_MOST = 4096  # codes of a table
_STEP = np.arange(256)
#: A colour of its own for each byte: three bits of red, three of green, two of blue.
_COLOURS = np.stack([(_STEP >> 5) * 255 // 7, (_STEP >> 2 & 7) * 255 // 7, (_STEP & 3) * 85], axis=1).astype(np.uint8).tobytes()


@functools.lru_cache(maxsize=64)
def code_widths(least: int, first: int, n: int) -> np.ndarray:
    """Bits of codes number ``first`` to ``first + n - 1`` behind a clear code, for samples of ``least`` bits."""
    held = (1 << least) + 2 + np.maximum(np.arange(first, first + n) - 1, 0)  # entries of the reader's table
    return np.clip(np.floor(np.log2(held)).astype(np.int64) + 1, least + 1, 12)


_WIDTHS = code_widths(8, 0, _MOST)


def compress(samples: bytes) -> bytes:
    """The LZW code stream of 8-bit samples, with a clear code whenever the table is full."""
    parts, codes, table, following = [], [], {}, 258
    find, emit = table.get, codes.append
    prefix = samples[0]
    for c in samples[1:]:
        key = prefix << 8 | c
        code = find(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        prefix = c
        if following < _MOST:
            table[key] = following
            following += 1
        else:
            emit(256)
            parts.append(codes)
            codes, table, following = [], {}, 258
            find, emit = table.get, codes.append
    parts.append([*codes, prefix, 257])
    bits = [np.array([0, 0, 0, 0, 0, 0, 0, 0, 1], np.uint8)]  # the first clear code
    place = np.arange(12)
    for part in parts:
        flat = np.array(part, np.int64)[:, None] >> place & 1
        bits.append(flat[place < _WIDTHS[: len(part), None]].astype(np.uint8))
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def _frame(samples: bytes) -> bytes:
    data = compress(samples)
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
    head = b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, DELAY, 0) + b"\0"  # the next frame begins on an empty picture
    return head + b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(samples) // WIDTH, 0) + b"\x08" + blocks + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF89a whose samples, frame by frame, are the bytes of ``payload`` (a positive multiple of 64)."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("payload must be a positive multiple of 64 bytes")
    height = min(ROWS, len(payload) // WIDTH)
    frames = [_frame(payload[i : i + WIDTH * ROWS]) for i in range(0, len(payload), WIDTH * ROWS)]
    return b"GIF89a" + struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0) + _COLOURS + b"".join(frames) + b"\x3b"


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks from ``at`` on, and the position behind their end."""
    view = np.frombuffer(data, np.uint8)[at:]
    heads = view[::256]
    short = np.flatnonzero(heads != 255)
    full = int(short[0]) if len(short) else len(heads)
    body = view[: full * 256].reshape(full, 256)[:, 1:].tobytes() if full * 256 <= len(view) else b""
    at += full * 256 if body or not full else 0
    parts = [body]
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def expand(codes: np.ndarray, base: int) -> np.ndarray:
    """The samples of the codes between two clear codes; ``base`` is the first code of the table that grows.

    Table entry ``base + m`` is the string of code number m and the sample behind it, that is, what stands in the output
    from that code on.  So each code is a sample or a copy of earlier output, and chains of copies are followed by
    doubling, for all codes and then for all samples at once.
    """
    n = len(codes)
    number = np.arange(n)
    copied = codes >= base
    source = np.where(copied, codes - base, number)
    if (source[copied] >= number[copied]).any() or (codes[~copied] >= base - 2).any():
        raise ValueError("damaged code stream")
    length, to = copied.astype(np.int64), source
    while (to[to] != to).any():
        length, to = length + length[to], to[to]
    length += 1
    start = np.cumsum(length) - length
    owner = np.repeat(number, length)
    at = np.arange(len(owner))
    source = start[source][owner] + at - start[owner]
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return codes[owner[source]].astype(np.uint8)


def lzw(data: bytes, least: int, wanted: int) -> np.ndarray:
    """The first ``wanted`` samples of a GIF code stream with ``least`` bits per sample."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(data + b"\0\0", np.uint8).astype(np.int32)
    wide, total = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16, 8 * len(data)  # 24 bits from each byte on hold any code that begins in it
    done: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    made = at = number = 0
    while at < total and made < wanted:
        widths = code_widths(least, min(number, _MOST), _MOST)[: (total - at) // (least + 1)]
        offsets = at + np.cumsum(widths) - widths
        n = int(np.searchsorted(offsets + widths, total, side="right"))
        if not n:
            break
        widths, offsets = widths[:n], offsets[:n]
        codes = (wide[offsets >> 3] >> (offsets & 7)) & ((1 << widths) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else n
        parts.append(codes[:n])
        if len(stop):
            done.append(expand(np.concatenate(parts), clear + 2))
            made += len(done[-1])
            if codes[n] == end:
                parts = []
                break
            at, number, parts = int(offsets[n] + widths[n]), 0, []
        else:
            at, number = int(offsets[-1] + widths[-1]), number + n
    if parts and made < wanted:
        done.append(expand(np.concatenate(parts), clear + 2))
    return np.concatenate([np.zeros(0, np.uint8), *done])[:wanted]


@dataclass
class Frame:
    """One shown frame: ``samples`` as stored, ``rgba`` the composed picture, its start and duration in 1/100 s."""

    samples: np.ndarray
    rgba: np.ndarray
    start: int
    delay: int
    disposal: int


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 128:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    screen = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index, clock = 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind, start = data[at + 1], at + 2
            body, at = _blocks(data, start)
            if kind == 0xF9:
                disposal, clear_index = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
                delay = int.from_bytes(body[1:3], "little")
            continue
        if data[at] != 0x2C:
            raise ValueError("damaged block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if local & 128:
            n = 3 << ((local & 7) + 1)
            palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        least = data[at]
        body, at = _blocks(data, at + 1)
        samples = lzw(body, least, w * h)
        if len(samples) < w * h:
            raise ValueError("short frame")
        samples = samples.reshape(h, w)
        if local & 64:
            rows = [y for s, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(s, h, step)]
            shown = np.empty_like(samples)
            shown[rows] = samples
            samples = shown
        if palette is None:
            raise ValueError("no palette")
        saved = screen.copy() if disposal == 3 else None
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(palette), :3] = palette
        colours[:, 3] = 255
        area = screen[top : top + h, left : left + w]
        seen = samples[: area.shape[0], : area.shape[1]]
        if clear_index is None:
            area[...] = colours[seen]
        else:
            opaque = seen != clear_index
            area[opaque] = colours[seen[opaque]]
        yield Frame(samples, screen.copy(), clock, delay, disposal)
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            screen[...] = saved
        clock += delay
        delay, disposal, clear_index = 0, 0, None


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of the shown pixels by two bits of red, green and blue each."""
    high = rgba.reshape(-1, 4) >> 6
    ranges = high[:, 0] << 4 | high[:, 1] << 2 | high[:, 2]
    shown = rgba.reshape(-1, 4)[:, 3] > 0
    return np.bincount(ranges if shown.all() else ranges[shown], minlength=64)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text, filled with zeros to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0"), len(raw)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text stored as a GIF."""
    schema = "doc_id long, n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in by_bytes(pc.binary_length(batch.column(1)).to_pylist()):  # bounds what is held besides the input
                part = batch.slice(at, end - at)
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def frame_columns(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, frame, start, delay, width, height, samples, histogram): one row per timed frame of each GIF."""
    schema = "doc_id long, frame int, start long, delay long, width int, height int, samples binary, histogram array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                for i, f in enumerate(decode(media.as_py()) if media.is_valid else ()):
                    h, w = f.samples.shape
                    values = [doc, i, f.start, f.delay, w, h, f.samples.tobytes(), histogram(f.rgba).tolist()]
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                    yield pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=[x.split()[0] for x in schema.split(", ")])

    return stored.select(F.col(id_col).cast("long"), media_col).mapInArrow(run, schema)


def features(stored: DataFrame) -> DataFrame:
    """One row per stored GIF: digests of what is read back and of the stored form, its colour histogram over all frames
    as ``feature``, and ``timed``: each frame's start, delay and histogram."""
    timed = pa.list_(pa.struct([("start", pa.int64()), ("delay", pa.int64()), ("histogram", pa.list_(pa.int64()))]))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, duration long, timed array<struct<start: long, delay: long, histogram: array<long>>>"
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "duration", "timed"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), timed]

    def one(media: bytes) -> tuple:
        counts, sha, n, shown, end, tail = np.zeros(64, np.int64), hashlib.sha256(), 0, [], 0, b""
        for f in decode(media):
            samples, own = f.samples.tobytes(), histogram(f.rgba)
            counts += own
            sha.update(samples)
            shown.append({"start": f.start, "delay": f.delay, "histogram": own.tolist()})
            n, end, tail = n + len(samples), f.start + f.delay, samples[-WIDTH:]
        return n, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, counts.tolist())), len(shown), end, shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*(one(x.as_py()) for x in batch.column(2)))) or [()] * len(kinds)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(made, kinds))], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
