"""Values of the object model, text strings and dates."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from typing import NamedTuple

from ..errors import LimitError


class Name(str):
    __slots__ = ()


class Hex(bytes):
    """A string that was written in hexadecimal: binary unless it is UTF-16."""

    __slots__ = ()


class Ref(NamedTuple):
    number: int
    generation: int


class Stream:
    __slots__ = ("dict", "raw", "number", "generation")

    def __init__(self, dict_: dict, raw: bytes, number: int = 0, generation: int = 0):
        self.dict, self.raw, self.number, self.generation = dict_, raw, number, generation


# PDFDocEncoding's ranges that differ from Latin-1 (fixed values).
_DOC = {0x18 + i: c for i, c in enumerate("˘ˇˆ˙˝˛˚˜")} | {0x80 + i: c for i, c in enumerate("•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž")} | {0xA0: "€"} | dict.fromkeys((0, 0x7F, 0x9F, 0xAD), "�")
_DOC_TABLE = [_DOC.get(i, chr(i)) for i in range(256)]
_DOC_BACK = {c: i for i, c in enumerate(_DOC_TABLE) if c != "�"}


def utf16(data: bytes) -> str:
    """UTF-16BE after its mark; what is no character, and U+0000, becomes U+FFFD."""
    return data.decode("utf-16-be", "replace").replace("\0", "�")


def text_of(data: bytes) -> str:
    """A text string: UTF-16 by its mark, else UTF-8 if it is valid and has no NUL, else PDFDocEncoding."""
    if data[:2] == b"\xfe\xff":
        return utf16(data[2:])
    if b"\0" not in data:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            pass
    return "".join(map(_DOC_TABLE.__getitem__, data))


def doc_encode(text: str) -> bytes | None:
    """PDFDocEncoding, or None if a character has no code."""
    out = [_DOC_BACK.get(c) for c in text]
    return None if None in out else bytes(out)


_DATE = re.compile(rb"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:([Z+-])(\d\d)?'?(\d\d)?'?)?")


def seconds(data: bytes) -> int | None:
    """A date string in seconds from 1970, UTC; None if it is none or not after that."""
    if not (m := _DATE.match(data)):
        return None
    parts = [int(x) if x else d for x, d in zip(m.groups()[:6], (0, 1, 1, 0, 0, 0), strict=True)]
    try:
        t = dt.datetime(*parts[:5], min(parts[5], 59), tzinfo=dt.UTC).timestamp()
    except ValueError:
        return None
    if m[7] in (b"+", b"-"):
        off = int(m[8] or 0) * 3600 + int(m[9] or 0) * 60
        t += -off if m[7] == b"+" else off
    return int(t) if t > 0 else None


def tagged(v, most_depth: float, depth: int = 0):
    """The value in the tagged JSON shape of the objects table."""
    if depth > most_depth:
        raise LimitError("max_depth", most_depth)
    if isinstance(v, Stream):
        v = v.dict
    if isinstance(v, dict):
        return {"dict": {k: tagged(v[k], most_depth, depth + 1) for k in sorted(v)}}
    if isinstance(v, list):
        return [tagged(x, most_depth, depth + 1) for x in v]
    if isinstance(v, Name):
        return {"name": str(v)}
    if isinstance(v, Ref):
        return {"ref": v.number, "gen": v.generation}
    if isinstance(v, Hex):
        return text_of(v) if v[:2] == b"\xfe\xff" and len(v) % 2 == 0 else {"bin": base64.b64encode(v).decode()}
    if isinstance(v, bytes):
        if v[:2] == b"D:" and (t := seconds(v)):
            return {"date": t}
        return text_of(v)
    if isinstance(v, float) and v == int(v) and abs(v) < 2**31:
        return int(v)
    return v


def to_json(v, most_depth: float) -> str:
    return json.dumps(tagged(v, most_depth), ensure_ascii=False, separators=(",", ":"))


def name_of(v) -> str | None:
    """The value as text: names and strings, else None."""
    return str(v) if isinstance(v, Name) else text_of(v) if isinstance(v, bytes) else None


def number(v, default=None):
    return v if isinstance(v, (int, float)) and not isinstance(v, bool) else default
