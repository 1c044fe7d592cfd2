"""Stream filters: bounded inflate and PNG predictors. Other filters leave a stream as stored."""

from __future__ import annotations

import zlib

import numpy as np

from ..errors import LimitError, ParseError

_STEP = 1 << 16


def inflate(data: bytes, most: float) -> tuple[bytes, str | None]:
    """Decoded bytes and a warning if the data broke off; at most ``most`` bytes, checked while decoding."""
    if not data.strip(b"\r\n \t\0"):
        raise ParseError("Flate data is empty")
    z, out, size, at = zlib.decompressobj(), [], 0, 0
    try:
        while at < len(data) and not z.eof:
            part = z.decompress(data[at : at + _STEP], _STEP)
            at += _STEP
            while True:
                size += len(part)
                if size > most:
                    raise LimitError("max_stream", most)
                out.append(part)
                if not z.unconsumed_tail or z.eof:
                    break
                part = z.decompress(z.unconsumed_tail, _STEP)
        warning = None if z.eof else "Flate data ends early"
    except zlib.error as e:
        warning = f"damaged Flate data: {e}"
    return b"".join(out), warning


def unpredict(data: bytes, predictor: int, colors: int, bits: int, columns: int) -> bytes:
    if predictor < 10:
        return data
    pixel, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out, last = bytearray(), bytearray(row)
    for at in range(0, len(data), row + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        if kind == 1:
            size = len(line)
            whole = np.frombuffer(bytes(line) + bytes(-size % pixel), np.uint8).reshape(-1, pixel)
            line = bytearray(np.cumsum(whole, axis=0, dtype=np.uint8).tobytes()[:size])
        elif kind == 2:
            line = bytearray((np.frombuffer(line, np.uint8) + np.frombuffer(last, np.uint8, len(line))).tobytes())
        elif kind == 3:
            for i in range(len(line)):
                line[i] = (line[i] + ((line[i - pixel] if i >= pixel else 0) + last[i]) // 2) & 255
        elif kind == 4:
            for i in range(len(line)):
                a, b, c = (line[i - pixel], last[i], last[i - pixel]) if i >= pixel else (0, last[i], 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = (line[i] + near) & 255
        out += line
        last = line + bytes(row - len(line))
    return bytes(out)
