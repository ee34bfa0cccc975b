"""8-bit PNG images (grey, RGB, with or without alpha) as arrays of rows x columns x channels; numpy and zlib only."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class ImageError(ValueError):
    """Bytes that aren't an image this codec reads."""


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise ImageError("not a PNG image")
    at = 8
    while at + 12 <= len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ImageError(f"chunk {kind!r} is damaged")
        yield kind, body
        at += 12 + n


def dimensions(data: bytes) -> tuple[int, int, int]:
    """Height, width and channels, from the header alone."""
    kind, body = next(_chunks(data), (b"", b""))
    if kind != b"IHDR":
        raise ImageError("no header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise ImageError("only 8-bit images without palette or interlacing")
    return height, width, CHANNELS[colour]


def _paeth(a: int, b: int, c: int) -> int:
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def decode(data: bytes) -> np.ndarray:
    height, width, depth = dimensions(data)
    body = zlib.decompress(b"".join(b for k, b in _chunks(data) if k == b"IDAT"))
    if len(body) != height * (width * depth + 1):
        raise ImageError("the pixels don't fit the header")
    lines = np.frombuffer(body, np.uint8).reshape(height, width * depth + 1)
    out = np.zeros((height, width * depth), np.uint8)
    above = np.zeros(width * depth, np.uint8)
    for y in range(height):
        way, line = lines[y, 0], lines[y, 1:]
        if way == 0:
            row = line.copy()
        elif way == 2:
            row = line + above
        elif way == 1:
            row = np.cumsum(line.reshape(width, depth), axis=0, dtype=np.uint8).reshape(-1)
        elif way in (3, 4):
            done = bytearray(line.tobytes())
            up = above.tobytes()
            for i in range(len(done)):
                left, corner = (done[i - depth], up[i - depth]) if i >= depth else (0, 0)
                done[i] = (done[i] + ((left + up[i]) >> 1 if way == 3 else _paeth(left, up[i], corner))) & 255
            row = np.frombuffer(bytes(done), np.uint8)
        else:
            raise ImageError("unknown filter")
        out[y] = above = row
    return out.reshape(height, width, depth)


def encode(pixels: np.ndarray) -> bytes:
    height, width, depth = pixels.shape
    colour = {n: c for c, n in CHANNELS.items()}[depth]
    lines = np.zeros((height, width * depth + 1), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), 6)), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)
