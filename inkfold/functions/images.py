"""PNG images as arrays, and back, without an imaging library: eight bits a channel, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: The signature of PNG files, and channels by colour type (grey, RGB, palette, grey with alpha, RGBA).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode_png(pixels: np.ndarray) -> bytes:
    """Pixels (uint8, height x width, or height x width x 1 to 4 channels) as a PNG file."""
    pixels = pixels if pixels.ndim == 3 else pixels[:, :, None]
    h, w, c = pixels.shape
    kind = next(k for k, n in CHANNELS.items() if n == c and k != 3)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels).reshape(h, w * c)], axis=1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def _unfiltered(data: np.ndarray, h: int, stride: int, step: int) -> np.ndarray:
    """Rows without their filters: each byte was stored as the difference to bytes on its left and above."""
    rows = data.reshape(h, stride + 1)
    out = np.zeros((h + 1, stride + step), np.uint8)
    for y in range(h):
        kind, line, above = int(rows[y, 0]), rows[y, 1:], out[y]
        now = out[y + 1]
        if kind == 0:
            now[step:] = line
        elif kind == 2:
            now[step:] = line + above[step:]
        elif kind == 1:
            now[step:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        else:
            left, up, last = now.tolist(), above.tolist(), line.tolist()
            for i, v in enumerate(last, step):
                a, b, c = left[i - step], up[i], up[i - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                left[i] = (v + guess) & 255
            now[:] = left
    return out[1:, step:]


def decode_png(raw: bytes | None) -> np.ndarray | None:
    """RGB pixels (uint8, height x width x 3) of a PNG file; None for anything that cannot be read."""
    try:
        if not raw or not raw.startswith(SIGNATURE):
            return None
        at, body, palette, head = 8, b"", None, None
        while at < len(raw):
            (n,) = struct.unpack(">I", raw[at : at + 4])
            name, data = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
            if struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + data):
                return None
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", data)
            elif name == b"PLTE":
                palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
            elif name == b"IDAT":
                body += data
            at += 12 + n
        w, h, depth, kind, *_, interlaced = head
        if depth != 8 or interlaced or kind not in CHANNELS:
            return None
        step = CHANNELS[kind]
        pixels = _unfiltered(np.frombuffer(zlib.decompress(body), np.uint8), h, w * step, step).reshape(h, w, step)
        if kind == 3:
            return palette[pixels[:, :, 0]]
        return np.repeat(pixels[:, :, :1], 3, axis=2) if step < 3 else np.ascontiguousarray(pixels[:, :, :3])
    except (struct.error, zlib.error, ValueError, TypeError, IndexError):
        return None
