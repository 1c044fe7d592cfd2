"""Objects of a file: tokens, values, cross references, repair, object streams, encryption."""

from __future__ import annotations

import re

from ..errors import LimitError, ParseError, PasswordError, PdfError
from ..limits import PARSE_DEPTH, Limits
from . import crypt
from .filters import inflate, unpredict
from .values import Hex, Name, Ref, Stream, doc_encode, number

SPACE = b"\0\t\n\f\r "
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]*")
_NUMBER = re.compile(rb"[+-]?(?:\d+(?:\.\d*)?|\.\d+)$")
_REFERENCE = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_STRING = re.compile(rb"[()\\]")
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![A-Za-z])")


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from after its parenthesis; one that doesn't end is read to the end."""
    out, depth = [], 1
    while m := _STRING.search(data, at):
        out.append(data[at : m.start()])
        at = m.end()
        if m[0] == b"(":
            depth += 1
            out.append(b"(")
        elif m[0] == b")":
            depth -= 1
            if not depth:
                return b"".join(out), at
            out.append(b")")
        else:
            c = data[at : at + 1]
            if digits := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(bytes([int(digits[0], 8) & 255]))
                at = digits.end()
            elif c in (b"\r", b"\n"):
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            else:
                out.append(_ESCAPES.get(c, c))
                at += 1
    return b"".join([*out, data[at:]]), len(data)


def hexadecimal(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b">", at)
    end = len(data) if end < 0 else end
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1


def name(raw: bytes) -> Name:
    if b"#" in raw:
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)
    try:
        return Name(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return Name(raw.decode("latin-1"))


def plain_number(raw: bytes):
    """A number without exponent, or None."""
    if not _NUMBER.match(raw):
        return None
    v = float(raw) if b"." in raw else int(raw)
    return 0 if abs(v) > 1e38 else v


class Parser:
    """Values at places of a byte string. ``decrypt`` is applied to strings, if given."""

    def __init__(self, data: bytes, decrypt=None):
        self.data, self.decrypt = data, decrypt

    def skip(self, at: int) -> int:
        return _SKIP.match(self.data, at).end()

    def value(self, at: int, depth: int = 0):
        """(value, end). Keywords that are no value come back as a Keyword."""
        if depth > PARSE_DEPTH:
            raise ParseError("values are nested too deep")
        data, at = self.data, self.skip(at)
        c = data[at : at + 1]
        if c == b"/":
            end = _REGULAR.match(data, at + 1).end()
            return name(data[at + 1 : end]), end
        if c == b"(":
            s, end = literal(data, at + 1)
            return (self.decrypt(s) if self.decrypt else s), end
        if data[at : at + 2] == b"<<":
            return self.dictionary(at + 2, depth)
        if c == b"<":
            s, end = hexadecimal(data, at + 1)
            return Hex(self.decrypt(s) if self.decrypt else s), end
        if c == b"[":
            out, at = [], at + 1
            while True:
                at = self.skip(at)
                if data[at : at + 1] in (b"]", b""):
                    return out, at + 1
                v, end = self.value(at, depth + 1)
                if isinstance(v, Keyword):
                    if v in ("endobj", "stream", ">>"):
                        return out, at
                    v = None
                out.append(v)
                at = max(end, at + 1)
        if c.isdigit() and (m := _REFERENCE.match(data, at)):
            return Ref(int(m[1]), int(m[2])), m.end()
        end = _REGULAR.match(data, at).end()
        if end == at:
            if data[at : at + 2] == b">>":
                return Keyword(">>"), at + 2
            return Keyword(c.decode("latin-1")), at + 1
        raw = data[at:end]
        if (v := plain_number(raw)) is not None:
            return v, end
        word = raw.decode("latin-1")
        return {"true": True, "false": False, "null": None}.get(word, Keyword(word)), end

    def dictionary(self, at: int, depth: int) -> tuple[dict, int]:
        out: dict = {}
        while True:
            key, end = self.value(at, depth + 1)
            if isinstance(key, Keyword):
                if key == ">>":
                    return out, end
                if key in ("endobj", "stream", "") or end >= len(self.data):
                    return out, at
                at = end
                continue
            if not isinstance(key, Name):
                at = end
                continue
            v, end2 = self.value(end, depth + 1)
            if isinstance(v, Keyword):
                if v == ">>":
                    return out, end2
                v = None
            out[key] = v
            at = end2


class Keyword(str):
    __slots__ = ()


class File:
    """An open file: cross references at once, objects when asked for. All lengths and counts are held to ``limits``."""

    def __init__(self, data: bytes, limits: Limits = Limits(), passwords: tuple[str, ...] = ()):
        if len(data) > limits.max_size:
            raise LimitError("max_size", limits.max_size)
        start = data.find(b"%PDF-", 0, 1024)
        if start < 0:
            raise ParseError("not a PDF file: no header")
        self.data, self.limits, self.warnings = data, limits, []
        self.base = start
        m = re.compile(rb"%PDF-(\d\.\d)").match(data, start)
        self.version = m[1].decode() if m else "1.0"
        self.entries: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.cipher, self.encryption, self.permissions = None, "none", -1
        self._cache: dict = {}
        self._packed: dict = {}
        try:
            self._chain()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise ParseError("no catalog")
        except LimitError:
            raise
        except (PdfError, ValueError, IndexError, KeyError, TypeError, AttributeError) as e:
            self._repair(str(e))
        if self.trailer.get("Encrypt") is not None:
            self._unlock(passwords)
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise ParseError("no catalog")
        self.root = root
        v = root.get("Version")
        if isinstance(v, Name) and re.fullmatch(r"\d\.\d", v) and v > self.version:
            self.version = str(v)

    # -- cross references

    def _put(self, n: int, entry: tuple) -> None:
        if n not in self.entries:
            if len(self.entries) >= self.limits.max_objects:
                raise LimitError("max_objects", self.limits.max_objects)
            self.entries[n] = entry

    def _chain(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise ParseError("no startxref")
        todo, seen = [int(re.compile(rb"startxref\s*(\d+)").match(self.data, at)[1]) + self.base], set()
        while todo:
            at = todo.pop(0)
            if at in seen or at >= len(self.data):
                if at in seen:
                    continue
                raise ParseError("cross reference is out of the file")
            seen.add(at)
            at = _SKIP.match(self.data, at).end()
            d = self._table(at + 4) if self.data[at : at + 4] == b"xref" else self._stream_table(at)
            for k, v in d.items():
                self.trailer.setdefault(k, v)
            for k in ("XRefStm", "Prev"):
                if isinstance(d.get(k), (int, float)) and d[k] >= 0:
                    todo.append(int(d[k]) + self.base)

    def _table(self, at: int) -> dict:
        head, row = re.compile(rb"[\0\t\n\f\r ]*(\d+)[ \t]+(\d+)[ \t]*\r?\n?"), re.compile(rb"[\0\t\n\f\r ]*(\d{1,10}) (\d{1,5}) ([nf])")
        while m := head.match(self.data, at):
            first, n = int(m[1]), int(m[2])
            at = m.end()
            if first + n > 1 << 40:
                raise ParseError("cross reference counts are out of range")
            for i in range(n):
                e = row.match(self.data, at)
                if not e:
                    raise ParseError("damaged cross reference table")
                at = e.end()
                if e[3] == b"n" and int(e[1]):
                    self._put(first + i, ("at", int(e[1]) + self.base, int(e[2])))
        at = _SKIP.match(self.data, at).end()
        if self.data[at : at + 7] != b"trailer":
            raise ParseError("no trailer")
        d, _ = Parser(self.data).value(at + 7)
        if not isinstance(d, dict):
            raise ParseError("damaged trailer")
        return d

    def _stream_table(self, at: int) -> dict:
        s = self._read_at(at, None)
        if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
            raise ParseError("no cross reference there")
        data, _, _ = self.decoded(s, self.limits.max_stream)
        w = [max(0, min(8, int(x))) for x in s.dict["W"]]
        size = sum(w)
        index = s.dict.get("Index") or [0, s.dict.get("Size", 0)]
        place = 0
        for first, n in zip(index[::2], index[1::2], strict=False):
            for i in range(int(n)):
                if place + size > len(data) or not size:
                    return s.dict
                f = [int.from_bytes(data[place + sum(w[:k]) : place + sum(w[: k + 1])]) for k in range(3)]
                place += size
                kind = f[0] if w[0] else 1
                if kind == 1:
                    self._put(int(first) + i, ("at", f[1] + self.base, f[2]))
                elif kind == 2:
                    self._put(int(first) + i, ("in", f[1], f[2]))
        return s.dict

    def _repair(self, why: str) -> None:
        """Cross references from what looks like objects; the last of a number counts."""
        self.warnings.append(f"cross references rebuilt: {why}")
        self.entries, self._cache, self._packed, trailer = {}, {}, {}, {}
        found = {int(m[1]): ("at", m.start(), int(m[2])) for m in _OBJECT.finditer(self.data)}
        for n, e in sorted(found.items()):
            self._put(n, e)
        for m in re.finditer(rb"trailer", self.data):
            try:
                d, _ = Parser(self.data).value(m.end())
            except PdfError:
                continue
            if isinstance(d, dict):
                trailer |= d
        self.trailer = trailer
        for n in list(found):
            try:
                v = self._read_at(found[n][1], n)
            except PdfError:
                continue
            d = v.dict if isinstance(v, Stream) else v
            if isinstance(d, dict):
                if d.get("Type") == "Catalog" and not isinstance(self.get(trailer.get("Root")), dict):
                    trailer["Root"] = Ref(n, 0)
                if d.get("Type") == "XRef":
                    self.trailer = d | trailer
                    trailer = self.trailer
                if d.get("Type") == "ObjStm" and isinstance(v, Stream):
                    for i, k in enumerate(self._numbers(v)):
                        self._put(k, ("in", n, i))
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            for n in list(self.entries):
                v = self.get(Ref(n, 0))
                if isinstance(v, dict) and v.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(n, 0)
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise ParseError(f"not a readable PDF file: {why}")

    # -- objects

    def _read_at(self, at: int, want: int | None):
        m = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj").match(self.data, at)
        if not m or (want is not None and int(m[1]) != want):
            raise ParseError(f"object {want} is not where the cross reference says", object=want)
        n, g = int(m[1]), int(m[2])
        decrypt = (lambda s: self.cipher.decrypt(n, g, s)) if self.cipher else None
        v, end = Parser(self.data, decrypt).value(m.end())
        if isinstance(v, Keyword):
            v = None
        at = _SKIP.match(self.data, end).end()
        if isinstance(v, dict) and self.data[at : at + 6] == b"stream":
            at += 6
            at += 2 if self.data[at : at + 2] == b"\r\n" else 1 if self.data[at : at + 1] in (b"\n", b"\r") else 0
            size = self.get(v.get("Length")) if v.get("Length") != Ref(n, g) else None
            if not isinstance(size, int) or size < 0 or not re.compile(rb"[\0\t\n\f\r ]*endstream").match(self.data, at + size):
                stop = self.data.find(b"endstream", at)
                stop = len(self.data) if stop < 0 else stop
                size = stop - at
                if self.data[at + size - 2 : at + size] == b"\r\n":
                    size -= 2
                elif size and self.data[at + size - 1 : at + size] in (b"\n", b"\r"):
                    size -= 1
            return Stream(v, self.data[at : at + size], n, g)
        return v

    def _numbers(self, s: Stream) -> list[int]:
        data, _, _ = self.decoded(s, self.limits.max_stream)
        return [int(x) for x in data[: int(number(s.dict.get("First"), 0))].split()[: 2 * int(number(s.dict.get("N"), 0)) : 2]]

    def _from_stream(self, holder: int, n: int):
        if holder not in self._packed:
            s = self.object(holder)
            if not isinstance(s, Stream):
                raise ParseError(f"object stream {holder} is missing", object=n)
            data, _, _ = self.decoded(s, self.limits.max_stream)
            first = int(number(s.dict.get("First"), 0))
            head = [int(x) for x in data[:first].split()]
            self._packed[holder] = (data, {k: first + o for k, o in zip(head[::2], head[1::2], strict=False)})
        data, places = self._packed[holder]
        if n not in places:
            raise ParseError(f"object {n} is not in its object stream", object=n)
        v, _ = Parser(data).value(places[n])
        return None if isinstance(v, Keyword) else v

    def object(self, n: int):
        """The value of an object; None for one that doesn't exist; ParseError for a broken one."""
        if n in self._cache:
            return self._cache[n]
        e = self.entries.get(n)
        if e is None:
            return None
        self._cache[n] = None  # an object that refers to itself while it is read
        try:
            self._cache[n] = v = self._read_at(e[1], n) if e[0] == "at" else self._from_stream(e[1], n)
        except PdfError:
            del self._cache[n]
            raise
        return v

    def get(self, v):
        """The value with one reference followed."""
        for _ in range(16):
            if not isinstance(v, Ref):
                return v
            v = self.object(v.number)
        return None

    def dict_of(self, v) -> dict:
        v = self.get(v)
        return v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}

    # -- streams

    def filters(self, s: Stream) -> list[str]:
        f = self.get(s.dict.get("Filter"))
        return [str(x) for x in map(self.get, f if isinstance(f, list) else [f]) if isinstance(x, Name)]

    def stored(self, s: Stream) -> bytes:
        return self.cipher.decrypt(s.number, s.generation, s.raw) if self.cipher and s.number and s.dict.get("Type") != "XRef" else s.raw

    def decoded(self, s: Stream, most: float) -> tuple[bytes, bool, str | None]:
        """(bytes, whether decoded, warning). A filter that isn't Flate leaves the stored bytes."""
        data, names = self.stored(s), self.filters(s)
        if any(f not in ("FlateDecode", "Fl") for f in names):
            if len(data) > most:
                raise LimitError("max_stream", most)
            return data, False, None
        params = self.get(s.dict.get("DecodeParms"))
        params = params if isinstance(params, list) else [params]
        warning = None
        for i, _ in enumerate(names):
            data, w = inflate(data, most)
            warning = warning or w
            p = self.dict_of(params[i]) if i < len(params) else {}
            if p:
                whole = lambda k, d: max(1, min(1 << 20, int(number(self.get(p.get(k)), d))))  # noqa: E731,B023
                data = unpredict(data, int(number(self.get(p.get("Predictor")), 1)), whole("Colors", 1), whole("BitsPerComponent", 8), whole("Columns", 1))
        if len(data) > most:
            raise LimitError("max_stream", most)
        return data, True, warning

    # -- encryption

    def _unlock(self, passwords: tuple[str, ...]) -> None:
        d = self.dict_of(self.trailer["Encrypt"])
        v, r = int(number(self.get(d.get("V")), 0)), int(number(self.get(d.get("R")), 2))
        size = max(5, min(16, int(number(self.get(d.get("Length")), 40)) // 8)) if v >= 2 else 5
        method = {1: "rc4-40", 2: "rc4-128" if size > 5 else "rc4-40"}.get(v)
        if v == 4:
            name_ = self.dict_of(self.dict_of(d.get("CF")).get(self.get(d.get("StmF")) or "StdCF")).get("CFM")
            method, size = {"V2": "rc4-128", "AESV2": "aes-128"}.get(name_), 16
        self.encryption = method or ("aes-256" if v >= 5 else "none")
        if method is None:
            from ..errors import UnsupportedInput

            raise UnsupportedInput(f"encryption version {v} is not supported")
        o, u, p = bytes(self.get(d["O"]))[:32], bytes(self.get(d["U"])), int(self.get(d["P"]))
        ids = self.get(self.trailer.get("ID")) or [b""]
        file_id, meta = bytes(self.get(ids[0]) or b""), self.get(d.get("EncryptMetadata")) is not False
        self.permissions = p
        tries = [b""]
        for w in passwords:
            tries += [w.encode("utf-8"), *([x] if (x := doc_encode(w)) else [])]
        for w in dict.fromkeys(tries):
            for user in (w, crypt.user_from_owner(w, o, r, size)):
                key = crypt.file_key(user, o, p, file_id, r, size, meta)
                n = 32 if r < 3 else 16
                if crypt.user_entry(key, file_id, r)[:n] == u[:n]:
                    self.cipher = crypt.Cipher(key, method)
                    holder = self.trailer["Encrypt"]
                    kept = {holder.number: d} if isinstance(holder, Ref) else {}
                    self._cache, self._packed = kept, {}
                    return
        raise PasswordError("the password is wrong" if passwords else "the file needs a password")

    # -- pages

    def pages(self) -> list[tuple[int, dict]]:
        """(object number, dictionary) of the pages in order; loops end a branch."""
        out, seen, todo = [], set(), [(self.root.get("Pages"), 0)]
        while todo:
            v, depth = todo.pop()
            n = v.number if isinstance(v, Ref) else 0
            if n and n in seen:
                continue
            seen.add(n)
            d = self.get(v)
            if not isinstance(d, dict):
                continue
            if depth > self.limits.max_depth:
                raise LimitError("max_depth", self.limits.max_depth)
            kids = self.get(d.get("Kids"))
            if d.get("Type") == "Page" or not isinstance(kids, list):
                if d.get("Type") != "Pages":
                    out.append((n, d))
                    if len(out) > self.limits.max_pages:
                        raise LimitError("max_pages", self.limits.max_pages)
            else:
                todo += [(k, depth + 1) for k in reversed(kids)]
        return out

    def inherited(self, page: dict, key: str):
        """The entry of the page or the nearest ancestor that has the key at all."""
        for depth in range(int(min(self.limits.max_depth, 1e6)) + 1):
            if key in page:
                return self.get(page[key])
            page = self.get(page.get("Parent"))
            if not isinstance(page, dict):
                return None
        raise LimitError("max_depth", self.limits.max_depth)
