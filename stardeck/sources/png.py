"""PNG files as planes of linear values.

Rows are unfiltered along the diagonals of the image, on which no byte depends on another, so each step is one numpy expression
whatever the filters are. Bytes are taken as shares of 255 to the power 2.4; what is not opaque is 0.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel of each colour type (fixed values of the format): grey, colour, palette, grey and alpha, colour and alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GAMMA, LONGEST = 2.4, 6000


def chunks(content: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, data) of each chunk; those of a wrong checksum are an error."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    out, at = [], 8
    while at + 12 <= len(content):
        n = struct.unpack_from(">I", content, at)[0]
        kind, data = content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", content, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"the checksum of chunk {kind.decode('latin-1')} is wrong")
        out.append((kind, data))
        at += 12 + n
    return out


def unfilter(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes, each filtered by its kind against what is `step` bytes to the left and against the row above."""
    height, length = raw.shape
    width = length // step
    todo = raw.reshape(height, width, step).astype(np.int32)
    out = np.zeros((height + 1, width + 1, step), np.int32)
    for d in range(width + height - 1):
        y = np.arange(max(0, d - width + 1), min(height - 1, d) + 1)
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        kind = kinds[y][:, None]
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        guess = np.where(kind == 1, left, np.where(kind == 2, up, np.where(kind == 3, (left + up) // 2, np.where(kind == 4, paeth, 0))))
        out[y + 1, x + 1] = (todo[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, length).astype(np.uint8)


def decode_bytes(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """((height, width, 3) of bytes, which pixels are opaque). 16-bit samples count by their upper byte."""
    parts = chunks(content)
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if interlaced:
        raise ValueError("interlaced PNG files are not supported")
    samples = SAMPLES[colour]
    length, step = -(-width * samples * bits // 8), max(1, samples * bits // 8)
    rows = np.frombuffer(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), np.uint8)[: height * (length + 1)].reshape(height, length + 1)
    data = unfilter(rows[:, 1:], rows[:, 0], step)
    if bits == 16:
        data = data[:, ::2]
    elif bits < 8:
        data = np.unpackbits(data, axis=1).reshape(height, -1, bits)
        data = (data @ (1 << np.arange(bits)[::-1]))[:, : width * samples].astype(np.uint8)
    pixels = data.reshape(height, width, samples)
    extra = dict(parts).get(b"tRNS")
    opaque = np.ones((height, width), bool)
    if colour == 3:
        palette = np.frombuffer(dict(parts)[b"PLTE"], np.uint8).reshape(-1, 3)
        alpha = np.full(len(palette), 255, np.uint8)
        if extra:
            alpha[: len(extra)] = np.frombuffer(extra, np.uint8)
        index = pixels[..., 0]
        return palette[index], alpha[index] == 255
    if colour in (4, 6):
        opaque = pixels[..., -1] == 255
        pixels = pixels[..., :-1]
    elif extra:
        clear = np.frombuffer(extra, ">u2") >> (8 if bits == 16 else 0)
        opaque = (pixels != clear).any(-1)
    if bits < 8 and colour == 0:
        pixels = pixels * (255 // ((1 << bits) - 1))
    return np.broadcast_to(pixels, (height, width, 3)), opaque


def shrunk(planes: np.ndarray, longest: int) -> np.ndarray:
    """(planes, height, width) whose longer side is at most `longest`: means of the pixels that fall into each of the fewer ones."""
    _, height, width = planes.shape
    if max(height, width) <= longest:
        return planes
    h, w = (max(1, n * longest // max(height, width)) for n in (height, width))
    rows, columns = (np.arange(n) * old // n for n, old in ((h, height), (w, width)))
    sums = np.add.reduceat(np.add.reduceat(planes.astype(np.int64), rows, 1), columns, 2)
    return sums // (np.diff(np.append(rows, height))[:, None] * np.diff(np.append(columns, width))[None])


def decode(content: bytes, longest: int = LONGEST) -> np.ndarray:
    """(3, height, width) of values 0 to 65535."""
    pixels, opaque = decode_bytes(content)
    linear = ((np.arange(256, dtype=np.float32) / np.float32(255)) ** np.float32(GAMMA) * np.float32(65535)).astype(np.int64)
    return shrunk(np.moveaxis(np.where(opaque[..., None], linear[pixels], 0), 2, 0), longest)
