"""PNG bytes to numpy arrays and back, by the published format: 8 bits a channel, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode(image: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3 or 4) array of bytes as PNG."""
    pixels = np.ascontiguousarray(image, np.uint8)
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    height, width, channels = pixels.shape
    kind = {v: k for k, v in _CHANNELS.items()}[channels]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a PNG; grey images have two axes. Other files raise ValueError."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("no PNG")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("a PNG of another kind")
    width, height, channels = head[0], head[1], _CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], above, channels)
    pixels = out.reshape(height, width, channels)
    return pixels[:, :, 0] if channels == 1 else pixels


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    line, up = bytearray(row.tobytes()), above.tobytes()
    for i in range(len(line)):
        left, high = line[i - step] if i >= step else 0, up[i]
        if kind == 3:
            line[i] = (line[i] + (left + high) // 2) & 255
        else:
            corner = up[i - step] if i >= step else 0
            guess = left + high - corner
            near = min(((abs(guess - left), 0, left), (abs(guess - high), 1, high), (abs(guess - corner), 2, corner)))[2]
            line[i] = (line[i] + near) & 255
    return np.frombuffer(bytes(line), np.uint8)
