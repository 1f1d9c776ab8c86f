"""PNG files decoded by definition, against what Spark's image source reads."""

import struct
import zlib

import numpy as np

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Height x width x channels, samples scaled to 0..1 (palette colours looked up). No interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette = 8, b"", None
    width = height = depth = colour = 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
            if interlace:
                raise ValueError("interlaced PNG")
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
    n = CHANNELS[colour]
    step, stride = max(1, n * depth // 8), -(-width * n * depth // 8)
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, stride + 1)
    rows = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        above = rows[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], above, step)
    if depth == 16:
        samples = rows.view(">u2").astype(float)
    elif depth == 8:
        samples = rows.astype(float)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        samples = (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(float)
    samples = samples[:, : width * n].reshape(height, width, n)
    if palette is not None and colour == 3:
        return palette[samples[:, :, 0].astype(int)] / 255
    return samples / ((1 << depth) - 1)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    out = line.astype(int)
    up = above.astype(int)
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        corner = up[i - step] if i >= step else 0
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)
