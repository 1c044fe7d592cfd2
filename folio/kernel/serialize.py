"""Values to bytes, and files from objects: numbering, cross references, trailer, id, encryption."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import re
import zlib
from xml.sax.saxutils import escape

from ..errors import InvalidArgument, LimitError, WriteError
from ..limits import COPY_DEPTH
from . import crypt
from .fonts import CORE, core_width
from .syntax import File
from .values import Hex, Name, Ref, Stream


def real(v: float) -> str:
    """A number with at most six decimals and no exponent."""
    if not math.isfinite(v):
        raise InvalidArgument("numbers must be finite")
    text = f"{v:.6f}".rstrip("0").rstrip(".")
    return "0" if text in ("", "-0") else text


_NAME_ODD = re.compile(rb"[^!-~]|[()<>\[\]{}/%#]")


def text_string(text: str) -> bytes:
    """Printable ASCII as it is, anything else as UTF-16BE with its mark."""
    return text.encode("ascii") if all(" " <= c <= "\x7f" for c in text) else b"\xfe\xff" + text.encode("utf-16-be", "surrogatepass")


def date_string(seconds: int) -> bytes:
    if not 0 <= seconds <= 32535215999:
        raise InvalidArgument("dates must be from 1970 to 3000")
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(seconds))).strftime("D:%Y%m%d%H%M%SZ").encode()


def serialize(v, encrypt=None, ref=None) -> bytes:
    """A value's bytes. encrypt: applied to strings; ref: gives the bytes of a reference."""
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, int):
        return str(v).encode()
    if isinstance(v, float):
        return real(v).encode()
    if isinstance(v, Name):
        return b"/" + _NAME_ODD.sub(lambda m: b"#%02X" % m[0][0], v.encode("utf-8", "surrogateescape"))
    if isinstance(v, Ref):
        return ref(v) if ref else b"%d %d R" % v
    if isinstance(v, str):
        v = text_string(v)
    if isinstance(v, dt.datetime):
        v = date_string(int(v.replace(tzinfo=v.tzinfo or dt.UTC).timestamp()))
    if isinstance(v, bytes):
        data = encrypt(v) if encrypt else bytes(v)
        if isinstance(v, Hex) or encrypt or data[:2] == b"\xfe\xff":
            return b"<" + data.hex().upper().encode() + b">"
        return b"(" + re.sub(rb"[()\\]", rb"\\\g<0>", data).replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"
    if isinstance(v, (list, tuple)):
        return b"[" + b" ".join(serialize(x, encrypt, ref) for x in v) + b"]"
    if isinstance(v, dict):
        return b"<<" + b"".join(serialize(Name(k)) + b" " + serialize(x, encrypt, ref) for k, x in sorted(v.items())) + b">>"
    raise WriteError(f"no such value: {type(v).__name__}")


A4 = (0, 0, 595.28, 841.89)


#: Times that can be written: from 1970 to the end of 3000, in seconds.
TIMES = (0, 32535215999)


class Builder:
    """A file being made. Objects are numbered as they are added; ``save`` gives the bytes."""

    def __init__(self, version: str = "1.7", media_box=A4, created: int | None = None, deterministic: bool = True):
        if not re.fullmatch(r"[12]\.[0-9]", version):
            raise InvalidArgument("version must look like 1.7", arg="version")
        self.version, self.media_box, self.deterministic = version, list(media_box), deterministic
        self.objects: list = [None, None]  # the catalog and the page tree
        self.pages: list[Ref] = []
        if created is not None and not TIMES[0] <= created <= TIMES[1]:
            raise InvalidArgument("created must be a time from 1970 to the end of 3000", arg="created")
        self.info: dict = {} if created is None else {"CreationDate": Hexless(date_string(created))}
        self.fonts: dict[str, Ref] = {}
        self.secret = None
        self.catalog: dict = {}

    def reserve(self) -> Ref:
        self.objects.append(None)
        return Ref(len(self.objects), 0)

    def put(self, ref: Ref, value) -> Ref:
        self.objects[ref.number - 1] = value
        return ref

    def add(self, value) -> Ref:
        return self.put(self.reserve(), value)

    def stream(self, data: bytes, dict_: dict | None = None, flate: bool = True) -> Ref:
        d = dict(dict_ or {})
        if flate:
            data = zlib.compress(data)
            d["Filter"] = Name("FlateDecode")
        return self.add(Stream(d, data))

    def core_font(self, name: str) -> Ref:
        if name not in CORE:
            raise InvalidArgument(f"no core font {name}", arg="font")
        if name not in self.fonts:
            self.fonts[name] = self.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(name)} | ({} if name in ("Symbol", "ZapfDingbats") else {"Encoding": Name("WinAnsiEncoding")}))
        return self.fonts[name]

    def page(self, content: bytes | None = None, resources: dict | None = None, media_box=None, **extra) -> Ref:
        d = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": list(media_box or self.media_box), "Resources": resources or {}} | extra
        if content is not None:
            d["Contents"] = self.stream(content)
        self.pages.append(ref := self.add(d))
        return ref

    def encrypt(self, user: str = "", owner: str = "", method: str = "aes128", permissions=None) -> None:
        """Before any object: strings and streams are encrypted when the file is saved."""
        if len(self.objects) > 2:
            raise InvalidArgument("encryption must be set before anything is added")
        if method not in ("aes128", "rc4128"):
            raise InvalidArgument("method must be aes128 or rc4128", arg="method")
        bits = -1 if permissions is None else ~sum(crypt.PERMISSIONS.values()) | sum(crypt.PERMISSIONS[p] for p in permissions)
        self.secret = (user.encode(), owner.encode(), method, bits & ~3)

    def describe(self, title: str | None = None, author: str | None = None, subject: str | None = None, keywords: str | None = None, creator: str | None = None, language: str | None = None, modified: int | None = None) -> None:
        """Metadata: in the information dictionary, for version 2 in an XMP packet instead; the language is the catalog's."""
        said = {k: v for k, v in {"Title": title, "Author": author, "Subject": subject, "Keywords": keywords, "Creator": creator}.items() if v is not None}
        if language is not None:
            self.catalog["Lang"] = text_string(language)
        if modified is not None:
            self.info["ModDate"] = Hexless(date_string(modified))
        if not self.version.startswith("2"):
            self.info |= {k: text_string(v) for k, v in said.items()}
        elif said:
            names = {"Title": "dc:title", "Author": "dc:creator", "Subject": "dc:description", "Keywords": "pdf:Keywords", "Creator": "xmp:CreatorTool"}
            body = "".join(f"<{names[k]}>{escape(v)}</{names[k]}>" for k, v in sorted(said.items()))
            packet = f'<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" xmlns:xmp="http://ns.adobe.com/xap/1.0/">{body}</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'
            self.catalog["Metadata"] = self.stream(packet.encode(), {"Type": Name("Metadata"), "Subtype": Name("XML")}, flate=False)

    def save(self) -> bytes:
        self.objects[0] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | self.catalog
        self.objects[1] = {"Type": Name("Pages"), "Kids": self.pages, "Count": len(self.pages)}
        trailer: dict = {"Root": Ref(1, 0)}
        if self.info:
            trailer["Info"] = self.add(self.info)
        file_id, cipher, hidden = bytes(16), None, 0
        if self.secret:
            user, owner, method, bits = self.secret
            file_id, r = os.urandom(16), 4 if method == "aes128" else 3
            o = crypt.owner_entry(owner, user, r, 16)
            key = crypt.file_key(user, o, bits, file_id, r, 16)
            d = {"Filter": Name("Standard"), "V": 4 if r == 4 else 2, "R": r, "Length": 128, "O": Hex(o), "U": Hex(crypt.user_entry(key, file_id, r)), "P": bits}
            if r == 4:
                d |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "AuthEvent": Name("DocOpen"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
            trailer["Encrypt"] = self.add(d)
            hidden = trailer["Encrypt"].number
            cipher = crypt.Cipher(key, "aes-128" if r == 4 else "rc4-128")
        elif not self.deterministic:
            file_id = os.urandom(16)
        out = [f"%PDF-{self.version}\n%".encode() + b"\xe2\xe3\xcf\xd3\n"]
        at, places = len(out[0]), []
        for n, v in enumerate(self.objects, 1):
            enc = (lambda s, n=n: cipher.encrypt(n, bytes(s))) if cipher and n != hidden else None
            if isinstance(v, Stream):
                data = cipher.encrypt(n, v.raw) if enc else v.raw
                body = serialize(v.dict | {"Length": len(data)}, enc) + b"\nstream\n" + data + b"\nendstream"
            else:
                body = serialize(v, enc)
            places.append(at)
            out.append(b"%d 0 obj\n" % n + body + b"\nendobj\n")
            at += len(out[-1])
        trailer |= {"Size": len(self.objects) + 1, "ID": [Hex(file_id)] * 2}
        table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        end = b"trailer\n" + serialize(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at
        if self.deterministic and not cipher:
            digest = hashlib.sha256(b"".join([*out, table, end])).digest()[:16]
            end = end.replace(bytes(16).hex().encode(), digest.hex().upper().encode())
        return b"".join([*out, table, end])


class Hexless(bytes):
    """A string to be written as a literal."""

    __slots__ = ()


# --- drawing ---------------------------------------------------------------------------------------------------------------------

#: Numbers that each drawing operation takes.
ARITY = {"save": 0, "restore": 0, "fill_rgb": 3, "stroke_rgb": 3, "line_width": 1, "move": 2, "line": 2, "curve": 6, "close": 0, "rect": 4, "paint": 2, "text": 5, "image": 5}
_PLAIN = {"save": "q", "restore": "Q", "fill_rgb": "rg", "stroke_rgb": "RG", "line_width": "w", "move": "m", "line": "l", "curve": "c", "close": "h", "rect": "re"}


def text_width(text: str, font: str = "Helvetica", size: float = 12) -> float:
    if font not in CORE:
        raise InvalidArgument(f"no core font {font}", arg="font")
    return sum(core_width(font, ord(bytes([b]).decode("cp1252", "replace"))) for b in text.encode("cp1252", "replace")) / 1000 * size


def content_of(ops: list[tuple[str, list[float], str | None]], fonts: dict[str, str], codes: dict[str, dict[int, int]] | None = None) -> bytes:
    """codes: two-byte codes of characters, of fonts that have them. Operations to a content stream. text: x, y, size, cos, sin with ``font\\ttext``; image: x, y, width, height, 0 with its name; paint: fill (0 none, 1 nonzero, 2 even-odd), stroke."""
    out: list[bytes] = []
    for op, nums, text in ops:
        if op not in ARITY or len(nums) != ARITY[op]:
            raise InvalidArgument(f"{op} takes {ARITY.get(op)} numbers", arg="op")
        n = [real(float(x)) for x in nums]
        if op in _PLAIN:
            out.append(" ".join([*n, _PLAIN[op]]).encode())
        elif op == "paint":
            fill, stroke = int(nums[0]), bool(nums[1])
            out.append({(0, False): b"n", (1, False): b"f", (2, False): b"f*", (0, True): b"S", (1, True): b"B", (2, True): b"B*"}[fill, stroke])
        elif op == "text":
            font, _, said = (text or "").partition("\t")
            turn = f"{n[3]} {n[4]} {real(-float(nums[4]))} {n[3]}"
            shown = Hex(b"".join(codes[font].get(ord(c), 0).to_bytes(2) for c in said)) if font in (codes or {}) else Hexless(said.encode("cp1252", "replace"))
            out.append(f"BT /{fonts[font]} {n[2]} Tf {turn} {n[0]} {n[1]} Tm ".encode() + serialize(shown) + b" Tj ET")
        else:
            out.append(f"q {n[2]} 0 0 {n[3]} {n[0]} {n[1]} cm /{text} Do Q".encode())
    return b"\n".join(out)


# --- copying ---------------------------------------------------------------------------------------------------------------------

def tree_nodes(f: File) -> set[int]:
    """Numbers of the page tree's nodes."""
    tree, todo = set(), [f.root.get("Pages")]
    while todo:
        v = todo.pop()
        d = f.get(v)
        if isinstance(d, dict) and isinstance(v, Ref) and v.number not in tree and isinstance(f.get(d.get("Kids")), list):
            tree.add(v.number)
            todo += f.get(d["Kids"])
    return tree


def page_entries(f: File, page: dict) -> dict:
    """A page's own entries and those it inherits, without its parent."""
    d = {k: v for k, v in page.items() if k != "Parent"}
    for key in ("Resources", "MediaBox", "CropBox", "Rotate"):
        if key not in d and (v := f.inherited(page, key)) is not None:
            d[key] = v.dict if isinstance(v, Stream) else v
    return d


def copy_pages(b: Builder, f: File, wanted: list[int], rotate: int = 0) -> None:
    """Appends pages (from 1, in this order, repeats allowed) with everything they use.

    Links to other pages point to their first copy in this call, or to null. Inheritable entries are put on the page.
    """
    pages = f.pages()
    for p in wanted:
        if not 1 <= p <= len(pages):
            raise InvalidArgument(f"no page {p}", arg="pages")
    refs = [b.reserve() for _ in wanted]
    target: dict[int, Ref | None] = {n: None for n, _ in pages if n}
    for p, ref in zip(wanted, refs, strict=True):
        n = pages[p - 1][0]
        if target.get(n) is None:
            target[n] = ref
    # Page tree nodes are never copied.
    tree = tree_nodes(f)
    queue: list[tuple[int, Ref]] = []

    def moved(v, depth: int):
        if depth > COPY_DEPTH:
            raise LimitError("copy_depth", COPY_DEPTH)
        if isinstance(v, Ref):
            if v.number in tree:
                return None
            if v.number not in target:
                target[v.number] = b.reserve()
                queue.append((v.number, target[v.number]))
            return target[v.number]
        if isinstance(v, dict):
            return {k: moved(x, depth + 1) for k, x in v.items()}
        if isinstance(v, list):
            return [moved(x, depth + 1) for x in v]
        return v

    chain = 0
    for p, ref in zip(wanted, refs, strict=True):
        _, page = pages[p - 1]
        new = moved(page_entries(f, page), 0) | {"Type": Name("Page"), "Parent": Ref(2, 0)}
        new.setdefault("MediaBox", b.media_box)
        if rotate:
            new["Rotate"] = (int(round((new.get("Rotate") or 0) / 90)) * 90 + rotate) % 360
        b.put(ref, new)
        b.pages.append(ref)
    while queue:
        chain += 1
        if chain > f.limits.max_objects:
            raise LimitError("max_objects", f.limits.max_objects)
        n, ref = queue.pop()
        v = f.object(n)
        b.put(ref, Stream(moved({k: x for k, x in v.dict.items() if k != "Length"}, 0), f.stored(v)) if isinstance(v, Stream) else moved(v, 0))
