"""GIF media columns: byte payloads stored as animations, and a decoder for timed frames.

``decode`` reads GIF87a and GIF89a streams: LZW code streams with growing code width, global and local palettes,
interlacing, transparency and the disposal methods none, keep, restore to background and restore to previous. Each frame
carries its delay, its own samples and the canvas as a viewer shows it at that time.

``encode`` stores a byte payload losslessly as 8-bit samples: frames of ``WIDTH`` samples a row and up to ``FRAME_ROWS`` rows, over
a palette whose red level is the sample. Its code streams grow a table of up to 4096 words, cleared when it is full. A row that the
canvas shows already is written in a transparent sample (a value that the payload lacks), and the frame before it is
kept for that; any other frame makes way for the background. So the payload is what the canvases show, one after the other.

Defined cases: a null text is an empty one; an empty text has a payload of one row of zeros; longer texts take as many frames as they
need. A payload with all 256 values has no transparent sample. Equal texts give equal values; rows are independent
of each other. Corrupt streams raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table

WIDTH, FRAME_ROWS = 64, 256
DELAY_CS = 10
#: The palette: red is the sample, green and blue are other orders of the levels.
PALETTE = bytes(v for i in range(256) for v in (i, i * 167 % 256, 255 - i))
_WORDS = 4096  # the most a table of codes holds


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: np.ndarray  # height x width palette indices
    canvas: np.ndarray  # screen height x width x RGBA, as shown


def _blocks(data: bytes) -> bytes:
    """Length-prefixed sub-blocks and their end mark."""
    whole, rest = divmod(len(data), 255)
    head = np.full((whole, 256), 255, np.uint8)
    head[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    tail = bytes([rest]) + data[whole * 255 :] if rest else b""
    return head.tobytes() + tail + b"\0"


def _widths(min_size: int, first: int, n: int) -> np.ndarray:
    """Bits of the codes ``first`` to ``first + n`` after a clear: as many as the table's next word needs, 12 at most."""
    have = (1 << min_size) + 1 + np.arange(first, first + n)
    return np.clip(np.frexp(have)[1], min_size + 1, 12).astype(np.int64)


_RUN = _WORDS - 257  # codes that an 8-bit table takes before it is cleared
_RUN_WIDTHS = np.append(_widths(8, 0, _RUN), 12)


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples (one at least), with a table that grows until it is full."""
    codes = [256]
    emit = codes.append
    table: dict[int, int] = {}
    longer, free = table.get, 258
    code = samples[0]
    for c in samples[1:]:
        key = code << 8 | c
        code = longer(key)
        if code is None:
            emit(key >> 8)
            if free < _WORDS:
                table[key] = free
                free += 1
            else:
                emit(256)
                table.clear()
                free = 258
            code = c
    codes += [code, 257]
    value = np.array(codes, np.int64)
    width = np.append(9, np.resize(_RUN_WIDTHS, len(value) - 1))
    at = np.cumsum(width) - width
    value <<= at & 7
    size = int(at[-1] + width[-1] + 7) >> 3
    out = np.zeros(size, np.int64)
    for k in range(3):  # a code lies in three bytes at most, and shares no bit with another
        out += np.bincount((at >> 3) + k, value >> 8 * k & 255, size + 2)[:size].astype(np.int64)
    return out.astype(np.uint8).tobytes()


def encode(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS) -> bytes:
    """A GIF89a holding ``payload``, whose length is a positive multiple of ``width``."""
    rows = len(payload) // width
    if not rows or len(payload) % width:
        raise ValueError("the payload must fill whole rows")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), PALETTE]
    samples = np.frombuffer(payload, np.uint8).reshape(rows, width)
    lacking = np.flatnonzero(np.bincount(samples.ravel(), minlength=256) == 0)
    shown = None  # what the canvas keeps of the frame before
    for first in range(0, rows, frame_rows):
        own, after = samples[first : first + frame_rows], samples[first + frame_rows : first + 2 * frame_rows]
        body = own
        if shown is not None:
            body = own.copy()
            body[(own == shown[: len(own)]).all(1)] = lacking[-1]
        keep = len(lacking) > 0 and bool((own[: len(after)] == after).all(1).any())
        flags = (1 if keep else 2) << 2 | (shown is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, DELAY_CS, int(lacking[-1]) if shown is not None else 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(own), 0) + b"\x08")
        out.append(_blocks(lzw_encode(body.tobytes())))
        shown = own if keep else None
    return b"".join(out) + b"\x3b"


@lru_cache
def _places(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and ends of the codes that come after a clear."""
    width = _widths(min_size, 0, _WORDS)
    return width, np.cumsum(width)


@lru_cache
def _single(clear: int) -> list[bytes]:
    return [*(bytes([i]) for i in range(clear)), b"", b""]


def _expanded(codes: list[int], words: list[bytes], prev: bytes) -> list[bytes]:
    """The words of codes; the table ``words`` grows by one for each of them but the first, as long as it may."""
    out = []
    emit, learn = out.append, words.append
    for k, code in enumerate(codes):
        if prev:
            break
        if code >= len(words):
            raise ValueError("corrupt code stream")
        prev = words[code]
        emit(prev)
    else:
        return out
    grows = _WORDS - len(words)
    for code in codes[k : k + grows]:
        try:
            word = words[code]
        except IndexError:
            if code != len(words):
                raise ValueError("corrupt code stream") from None
            word = prev + prev[:1]
        learn(prev + word[:1])
        emit(word)
        prev = word
    out += [words[c] for c in codes[k + grows :]]
    return out


def lzw_decode(data: bytes, min_size: int, pixels: int) -> np.ndarray:
    """Palette indices of a GIF code stream. Codes are cut out by whole arrays up to the next clear, words looked up one by one."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.ndarray((len(data) + 1,), "<u4", data + b"\0\0\0\0", strides=(1,))
    words, prev = _single(clear).copy(), b""
    out: list[bytes] = []
    at = made = since = 0  # bits read, samples made, codes since the last clear
    while made < pixels:
        left = len(data) * 8 - at
        most = min(_WORDS, left // (min_size + 1) + 1)
        if since:  # the table is full, or nearly so
            width = _widths(min_size, since, most)
            ends = np.cumsum(width)
        else:
            width, ends = (x[:most] for x in _places(min_size))
        n = int(np.searchsorted(ends, left, "right"))
        if not n:
            raise ValueError("the code stream ends early")
        width, ends = width[:n], ends[:n] + at
        starts = ends - width
        codes = (raw[starts >> 3] >> (starts & 7)) & ((1 << width) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(marks[0]) if len(marks) else n
        found = _expanded(codes[:stop].tolist(), words, prev)
        out += found
        made += sum(map(len, found))
        since += stop
        if stop == n:
            at, prev = int(ends[-1]), found[-1] if found else prev
        elif codes[stop] == end:
            break
        else:
            at, since, prev = int(ends[stop]), 0, b""
            words = _single(clear).copy()
    samples = np.frombuffer(b"".join(out), np.uint8)
    if len(samples) < pixels:
        raise ValueError("the code stream ends early")
    return samples[:pixels]


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(s, rows, k) for s, k in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> list[Frame]:
    return list(read_frames(data))


def read_frames(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order, each with the canvas shown at its time; one is held at once."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background = struct.unpack("<HHBB", data[6:12])
    at = 13
    shared = None
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    transparent: int | None = None

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = shared
        if flags & 0x80:
            n = 3 * (2 << (flags & 7))
            palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        if palette is None:
            raise ValueError("no palette")
        min_size = data[at]
        stream, at = sub_blocks(at + 1)
        samples = lzw_decode(stream, min_size, w * h).reshape(h, w)
        if flags & 0x40:
            straight = np.empty_like(samples)
            straight[_interlaced(h)] = samples
            samples = straight
        before = canvas.copy() if disposal == 3 else None
        view = canvas[top : top + h, left : left + w]
        seen = samples[: view.shape[0], : view.shape[1]]
        colours = np.full((256, 4), 255, np.uint8)
        colours[: len(palette), :3] = palette
        if transparent is None:
            view[...] = colours[seen]
        else:
            shown = seen != transparent
            view[shown] = colours[seen[shown]]
        yield Frame(left, top, w, h, delay * 10, disposal, transparent, samples, canvas.copy())
        if disposal == 2:
            view[...] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def histogram(frame: Frame, bins: int = 16) -> list[int]:
    """Pixels of the shown canvas by opaque red, green and blue level: ``3 * bins`` counts."""
    solid = frame.canvas[..., 3] == 255
    shown = frame.canvas.reshape(-1, 4) if solid.all() else frame.canvas[solid]
    return [n for c in range(3) for n in np.bincount(shown[:, c], minlength=256).reshape(bins, -1).sum(1).tolist()]


def payload_of(frame: Frame) -> bytes:
    """The part of a payload that a frame of ``encode`` shows: red levels of its rows."""
    return frame.canvas[: frame.height, :, 0].tobytes()


_FRAMES = "array<struct<at_ms:long,delay_ms:long,disposal:int,width:int,height:int,histogram:array<long>>>"


def stored(text: str | None) -> tuple[bytes, bytes, list[dict]]:
    """A text as a stored GIF, the payload read back from it, and its timed frames with their colour histograms."""
    media = encode(padded((text or "").encode()))
    parts, frames, at = [], [], 0
    for f in read_frames(media):
        parts.append(payload_of(f))
        frames.append({"at_ms": at, "delay_ms": f.delay_ms, "disposal": f.disposal, "width": f.width, "height": f.height, "histogram": histogram(f)})
        at += f.delay_ms
    return media, b"".join(parts), frames


def store_frames(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: the stored GIF (``media``), and its frames with times and colour histograms."""

    def run(ids, bodies):
        found = [stored(b) for b in bodies]
        return {"id": ids, "media": [m for m, _, _ in found], "frames": [f for _, _, f in found]}

    return map_columns(texts.select(F.col(id_col).cast("long"), text_col), run, f"id long, media binary, frames {_FRAMES}")


def padded(raw: bytes, unit: int = WIDTH) -> bytes:
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store, read back and describe every whole text."""

    def run(ids, texts):
        out = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames")}
        for i, text in zip(ids, texts):
            media, back, frames = stored(text)
            levels = np.sum([f["histogram"] for f in frames], axis=0)
            out["doc_id"].append(i)
            out["n_bytes"].append(len((text or "").encode()))
            out["payload_bytes"].append(len(back))
            out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
            out["tail_crc32"].append(zlib.crc32(back[-64:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(f"{len(frames)}x{frames[-1]['at_ms'] + frames[-1]['delay_ms']}ms:" + ",".join(map(str, levels.tolist())))
            out["frames"].append(frames)
        return out

    kind = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames {_FRAMES}"
    return map_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), run, kind)
