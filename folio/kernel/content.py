"""Content streams: tokens, and the walk that shows text."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from ..errors import LimitError
from ..limits import FORM_COST, OPERANDS, SAVES
from .fonts import FALLBACK, Font
from .syntax import File, hexadecimal, literal, name, plain_number
from .values import Name, Ref, Stream, number, text_of

_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_WORD = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_IMAGE_END = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)")


class Token(NamedTuple):
    type: str
    raw: bytes
    value: object = None


def lex(data: bytes):
    """Tokens in order. An inline image's data is one token after its ID."""
    at, n = 0, len(data)
    while True:
        at = _SKIP.match(data, at).end()
        if at >= n:
            return
        c = data[at : at + 1]
        if c == b"(":
            s, at = literal(data, at + 1)
            yield Token("string", s, s)
        elif c == b"/":
            m = _WORD.match(data, at + 1)
            at = m.end() if m else at + 1
            v = name(m[0]) if m else Name("")
            yield Token("name", v.encode("utf-8", "surrogateescape"), v)
        elif c == b"<" and data[at + 1 : at + 2] == b"<":
            at += 2
            yield Token("dict_open", b"<<")
        elif c == b"<":
            s, at = hexadecimal(data, at + 1)
            yield Token("string", s, s)
        elif c == b">":
            at += 2 if data[at + 1 : at + 2] == b">" else 1
            yield Token("dict_close", b">>")
        elif c in b"[]":
            at += 1
            yield Token("array_open" if c == b"[" else "array_close", c)
        elif c in b"){}":
            at += 1
            yield Token("operator", c)
        else:
            m = _WORD.match(data, at)
            at = m.end()
            if (v := plain_number(m[0])) is not None:
                yield Token("number", m[0], v)
                continue
            yield Token("operator", m[0])
            if m[0] == b"ID":
                at += data[at : at + 1] in (b"\0", b"\t", b"\n", b"\f", b"\r", b" ")
                end = _IMAGE_END.search(data, max(0, at - 1))
                stop = max(at, end.start()) if end else n
                yield Token("inline_image", b"%d bytes" % (stop - at))
                at = end.end() if end else n


def tokens(data: bytes) -> list[tuple[str, str]]:
    return [(t.type, text_of(t.raw)) for t in lex(data)]


class Budget:
    """What a page may read: content, forms each time they are drawn, and character maps."""

    def __init__(self, most: float):
        self.most, self.used = most, 0

    def spend(self, n: int) -> None:
        self.used += n
        if self.used > self.most:
            raise LimitError("max_stream", self.most)


def page_content(file: File, page: dict, budget: Budget, warnings: list[str]) -> bytes:
    """The page's streams, one space after each."""
    v = file.get(page.get("Contents"))
    out = []
    for s in v if isinstance(v, list) else [v]:
        s = file.get(s)
        if isinstance(s, Stream):
            data, ok, w = file.decoded(s, budget.most)
            if w:
                warnings.append(w)
            budget.spend(len(data))
            if ok or not file.filters(s):
                out.append(data + b" ")
    return b"".join(out)


class Glyph(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    size: float
    text: str
    font: str
    ascent: float
    descent: float


def times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l)


_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class State:
    __slots__ = ("ctm", "font", "size", "tc", "tw", "th", "tl", "rise")

    def __init__(self):
        self.ctm, self.font, self.size, self.tc, self.tw, self.th, self.tl, self.rise = _UNIT, FALLBACK, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0

    def copy(self) -> State:
        new = State.__new__(State)
        for k in State.__slots__:
            setattr(new, k, getattr(self, k))
        return new


class Walk:
    """Runs a page's content and gathers glyphs and the raw text."""

    def __init__(self, file: File, page: dict, fonts: dict | None = None):
        self.file, self.page = file, page
        self.budget = Budget(file.limits.max_stream)
        self.warnings: list[str] = []
        self.glyphs: list[Glyph] = []
        self.raw: list[str] = []
        self.unmapped = 0
        self.fonts = {} if fonts is None else fonts
        self.forms: dict[int, tuple[Stream, bytes]] = {}
        self.drawing: set[int] = set()
        data = page_content(file, page, self.budget, self.warnings)
        self.run(data, file.dict_of(file.inherited(page, "Resources")), State(), 0)

    # -- raw layout

    def _break(self, char: str) -> None:
        last = self.raw[-1] if self.raw else "\n"
        if last.endswith("\n") or (char == " " and last.endswith(" ")):
            return
        self.raw.append(char)

    # -- operators

    def run(self, data: bytes, resources: dict, state: State, depth: int) -> None:
        tm = tlm = _UNIT
        saved: list[State] = []
        stack: list = []
        array: list | None = None
        nested = 0
        in_dict = 0
        num = lambda i: number(stack[i], 0) if -len(stack) <= i < len(stack) else 0
        for t in lex(data):
            if in_dict:
                in_dict += (t.type == "dict_open") - (t.type == "dict_close")
                continue
            if t.type == "dict_open":
                in_dict = 1
                continue
            if t.type == "array_open":
                if array is None:
                    array = []
                else:
                    nested += 1
                continue
            if t.type == "array_close":
                if nested:
                    nested -= 1
                elif array is not None:
                    stack.append(array)
                    array = None
                continue
            if array is not None:
                if not nested and t.type in ("number", "string"):
                    array.append(t.value)
                continue
            if t.type in ("number", "string", "name"):
                stack.append(t.value)
                if len(stack) > OPERANDS:
                    del stack[0]
                continue
            if t.type != "operator":
                continue
            op = t.raw
            if op == b"q":
                if len(saved) < SAVES:
                    saved.append(state.copy())
            elif op == b"Q":
                if saved:
                    state = saved.pop()
            elif op == b"cm":
                state.ctm = times(tuple(float(num(i)) for i in range(-6, 0)), state.ctm)
            elif op == b"BT":
                tm = tlm = _UNIT
            elif op == b"ET":
                self._break("\n")
            elif op == b"Do":
                if stack and isinstance(stack[-1], Name):
                    self.form(stack[-1], resources, state, depth)
            elif op[:1] in (b"'", b'"'):
                if op[:1] == b'"':
                    state.tw, state.tc = num(-3), num(-2)
                tm = tlm = times((1, 0, 0, 1, 0, -state.tl), tlm)
                self._break("\n")
                tm = self.show(stack[-1:], state, tm)
            elif op[:1] == b"T" and len(op) > 1:
                # The second byte alone tells: what follows it is not looked at.
                k = op[1:2]
                if k == b"f":
                    state.size = float(num(-1))
                    f = next((x for x in reversed(stack) if isinstance(x, Name)), None)
                    state.font = self.font(f, resources)
                elif k == b"c":
                    state.tc = num(-1)
                elif k == b"w":
                    state.tw = num(-1)
                elif k == b"z":
                    state.th = num(-1) / 100
                elif k == b"L":
                    state.tl = num(-1)
                elif k == b"s":
                    state.rise = num(-1)
                elif k in b"dD":
                    tx, ty = num(-2), num(-1)
                    if k == b"D":
                        state.tl = -ty
                    tm = tlm = times((1, 0, 0, 1, tx, ty), tlm)
                    self._break("\n" if ty else " ")
                elif k == b"m":
                    new = tuple(float(num(i)) for i in range(-6, 0))
                    self._break("\n" if abs(new[5] - tlm[5]) > 0.01 else " ")
                    tm = tlm = new
                elif k == b"*":
                    tm = tlm = times((1, 0, 0, 1, 0, -state.tl), tlm)
                    self._break("\n")
                elif k == b"j":
                    tm = self.show(stack[-1:], state, tm)
                elif k == b"J":
                    tm = self.show(stack[-1] if stack and isinstance(stack[-1], list) else [], state, tm)
            stack = []

    def font(self, key: Name | None, resources: dict) -> Font:
        fonts = self.file.dict_of(resources.get("Font"))
        v = fonts.get(key) if key is not None else None
        if v is None:
            return FALLBACK
        slot = v.number if isinstance(v, Ref) else id(v)
        if slot not in self.fonts:
            d = self.file.get(v)
            if not isinstance(d, dict):
                return FALLBACK
            self.fonts[slot] = Font(self.file, d, self.budget.spend)
        return self.fonts[slot]

    def form(self, key: Name, resources: dict, state: State, depth: int) -> None:
        v = self.file.dict_of(resources.get("XObject")).get(key)
        n = v.number if isinstance(v, Ref) else 0
        if n in self.forms:
            s, data = self.forms[n]
            self.budget.spend(len(data) + FORM_COST)
        else:
            s = self.file.get(v)
            if not isinstance(s, Stream) or self.file.get(s.dict.get("Subtype")) != "Form":
                return
            data, ok, w = self.file.decoded(s, self.budget.most)
            if w:
                self.warnings.append(w)
            self.budget.spend(len(data) + FORM_COST)
            data = data + b" " if ok else b""
            self.forms[n] = (s, data)
        if n in self.drawing or depth + 1 > min(self.file.limits.max_depth, 256):
            raise LimitError("max_depth", self.file.limits.max_depth, n in self.drawing)
        new = state.copy()
        m = self.file.get(s.dict.get("Matrix"))
        if isinstance(m, list) and len(m) == 6:
            new.ctm = times(tuple(float(number(self.file.get(x), 0)) for x in m), new.ctm)
        own = s.dict.get("Resources")
        self.drawing.add(n)
        try:
            self.run(data, self.file.dict_of(own) if own is not None else resources, new, depth + 1)
        finally:
            self.drawing.discard(n)

    def show(self, parts: list, state: State, tm: tuple) -> tuple:
        font = state.font
        for part in parts:
            if isinstance(part, (int, float)):
                tm = times((1, 0, 0, 1, -part / 1000 * state.size * state.th, 0), tm)
                if part < -200:
                    self._break(" ")
                continue
            if not isinstance(part, bytes):
                continue
            # Along a string only the origin moves: by each code's advance in the direction of the text.
            a, b, c, d, e, f = times(tm, state.ctm)
            size = abs(state.size) * math.hypot(c, d)
            size = size if math.isfinite(size) else 0.0
            x, y, moved = state.rise * c + e, state.rise * d + f, 0.0
            known, glyphs = font.shown, self.glyphs
            start = len(glyphs)
            for code, n in font.codes(part):
                said = known.get(code)
                if said is None:
                    text = font.text(code)
                    clean = "�" if text is None else "".join(" " if ord(ch) < 32 or ch == "\x7f" else ch for ch in text)
                    said = known[code] = (clean, font.width(code) * font.scale, text is None)
                text, width, missing = said
                self.unmapped += missing
                tx = (width * state.size + state.tc + (state.tw if n == 1 and code == 32 else 0)) * state.th
                x1, y1 = x + a * tx, y + b * tx
                glyphs.append(Glyph(x, y, x1, y1, size, text, font.name, font.ascent, font.descent))
                x, y, moved = x1, y1, moved + tx
            if not (math.isfinite(x) and math.isfinite(y)):
                glyphs[start:] = [g._replace(**{k: v for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 0.0), ("y1", 0.0)) if not math.isfinite(getattr(g, k))}) for g in glyphs[start:]]
            self.raw += [g.text for g in glyphs[start:]]
            tm = times((1, 0, 0, 1, moved, 0), tm)
        return tm

    def raw_text(self) -> str:
        return "".join(self.raw).rstrip(" \n")
