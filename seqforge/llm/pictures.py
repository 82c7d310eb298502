"""Grey pixels of picture files: PNG (all colour types and depths, interlaced or not) and portable maps (P5, P6)."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

#: Files of more pixels than this count as broken: a few bytes can claim any size.
MOST_PIXELS = 1 << 28
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by colour type
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Interlacing: first column, first row, column step, row step of each pass.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


class Broken(ValueError):
    """The bytes are not a picture of a known kind."""


def picture(data: bytes) -> np.ndarray | None:
    """height x width grey bytes; None where the file is broken or of another kind.

    Colours weigh 0.299, 0.587 and 0.114; transparency is ignored; 16 bits are cut to 8."""
    try:
        return _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _map(data)
    except (ValueError, struct.error, zlib.error, IndexError, KeyError):
        return None


def _grey(x: np.ndarray) -> np.ndarray:
    """rows x columns x channels of 8 bits as grey."""
    if x.shape[2] < 3:
        return x[..., 0]
    return np.rint(x[..., 0] * 0.299 + x[..., 1] * 0.587 + x[..., 2] * 0.114).astype(np.uint8)


def _map(data: bytes) -> np.ndarray:
    head = re.match(rb"P([56])(?:\s|#[^\n]*\n)+(\d{1,9})(?:\s|#[^\n]*\n)+(\d{1,9})(?:\s|#[^\n]*\n)+(\d{1,5})\s", data)
    if not head:
        raise Broken
    kind, width, height, most = (int(x) for x in head.groups())
    channels = 3 if kind == 6 else 1
    if not 0 < width * height <= MOST_PIXELS or not 0 < most < 65536:
        raise Broken
    kind = np.dtype("u1" if most < 256 else ">u2")
    body = np.frombuffer(data, "u1", offset=head.end())
    if len(body) < (size := width * height * channels * kind.itemsize):
        raise Broken
    x = body[:size].view(kind).reshape(height, width, channels).astype(np.float64)
    return _grey(np.clip(x * 255 / most, 0, 255).astype(np.uint8))


def _chunks(data: bytes):
    at = 8
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(data[at + 4 : at + 8 + size]):
            raise Broken
        yield name, body
        at += 12 + size


def _png(data: bytes) -> np.ndarray:
    chunks = list(_chunks(data))
    if not chunks or chunks[0][0] != b"IHDR":
        raise Broken
    width, height, depth, kind, packing, filtering, interlaced = struct.unpack(">IIBBBBB", chunks[0][1])
    if not 0 < width * height <= MOST_PIXELS or depth not in _DEPTHS[kind] or packing or filtering or interlaced > 1:
        raise Broken
    passes = _PASSES if interlaced else [(0, 0, 1, 1)]
    sizes = [(max(0, -(-(height - y) // dy)), max(0, -(-(width - x) // dx))) for x, y, dx, dy in passes]
    stride = lambda w: -(-w * depth * _CHANNELS[kind] // 8)
    total = sum(h * (1 + stride(w)) for h, w in sizes if h and w)
    plain = zlib.decompressobj()
    raw = plain.decompress(b"".join(body for name, body in chunks if name == b"IDAT"), total)
    if len(raw) < total:
        raise Broken
    out, at = np.zeros((height, width, _CHANNELS[kind]), np.uint8), 0
    for (x, y, dx, dy), (h, w) in zip(passes, sizes):
        if h and w:
            rows = np.frombuffer(raw, "u1", h * (1 + stride(w)), at).reshape(h, -1)
            at += rows.size
            out[y::dy, x::dx] = _samples(_unfiltered(rows, max(1, depth * _CHANNELS[kind] // 8)), w, depth, kind)
    if kind == 3:
        palette = np.frombuffer(dict(chunks)[b"PLTE"], "u1").reshape(-1, 3)
        if out.max() >= len(palette):
            raise Broken
        out = palette[out[..., 0]]
    return _grey(out)


def _samples(rows: np.ndarray, width: int, depth: int, kind: int) -> np.ndarray:
    """rows x width x channels of 8 bits; numbers of colours stay as they are."""
    channels = _CHANNELS[kind]
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    values = (bits << np.arange(depth - 1, -1, -1)).sum(2).astype(np.uint8)
    return (values if kind == 3 else values * (255 // (2**depth - 1)))[..., None]


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """The rows without their filter bytes; ``step``: bytes of a pixel."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for n, (kind, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:])):
        if kind == 0:
            out[n] = line
        elif kind == 1:  # the pixel before
            for k in range(step):
                out[n, k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:  # the pixel above
            out[n] = line + above
        elif kind in (3, 4):
            out[n] = _predicted(line.tolist(), above.tolist(), step, kind)
        else:
            raise Broken
        above = out[n]
    return out


def _predicted(line: list[int], above: list[int], step: int, kind: int) -> list[int]:
    """A row whose bytes are differences to the mean of left and above (3) or to the nearest of left, above and their corner (4)."""
    got = [0] * step + line
    up = [0] * step + above
    for k in range(step, len(got)):
        a, b = got[k - step], up[k]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = up[k - step]
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        got[k] = (got[k] + guess) & 255
    return got[step:]
