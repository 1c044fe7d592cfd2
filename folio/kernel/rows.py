"""What each table says of one open file: generators of dictionaries, without Spark."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator

from ..errors import LimitError, ParseError, PdfError, UnsupportedInput, status
from ..layout import reading_text, words
from ..limits import COPY_DEPTH
from .content import Budget, Walk, page_content, tokens
from .crypt import PERMISSIONS
from .serialize import A4, page_entries, serialize, tree_nodes
from .syntax import File
from .values import Name, Ref, Stream, name_of, number, seconds, text_of, to_json, utf16

# Page layouts by their names, and font types by subtype.
LAYOUTS = {"SinglePage": "single_page", "OneColumn": "one_column", "TwoColumnLeft": "two_column_left", "TwoColumnRight": "two_column_right", "TwoPageLeft": "two_page_left", "TwoPageRight": "two_page_right"}
FONT_TYPES = {"Type1": "type1", "MMType1": "type1", "TrueType": "truetype", "Type3": "type3"}


def _time(t: int | None) -> dt.datetime | None:
    return None if not t else dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=t)


def _date(f: File, v) -> dt.datetime | None:
    v = f.get(v)
    return _time(seconds(v)) if isinstance(v, bytes) else None


def _wanted(f: File, pages: list[int] | None) -> Iterator[tuple[int, dict]]:
    every = f.pages()
    for i in pages if pages is not None else range(1, len(every) + 1):
        if 1 <= i <= len(every):
            yield i, every[i - 1][1]


def objects(f: File, stored: bool = True) -> Iterator[dict]:
    """Every object; the catalog again as number 0 and the information dictionary as -1."""
    for n in sorted(f.entries):
        generation = f.entries[n][2] if f.entries[n][0] == "at" else 0
        row = {"number": n, "generation": generation}
        try:
            v = f.object(n)
            d = v.dict if isinstance(v, Stream) else v
            if isinstance(d, dict):
                row |= {"type": name_of(f.get(d.get("Type"))), "subtype": name_of(f.get(d.get("Subtype")))}
            row["value"] = to_json(v, f.limits.max_depth)
            if isinstance(v, Stream):
                row |= {"length": len(v.raw), "filter": f.filters(v), "stored": f.stored(v) if stored else None}
            yield row | {"status": status()}
        except PdfError as e:
            yield row | {"status": status(e)}
    for n, v in ((0, f.root), (-1, f.get(f.trailer.get("Info")))):
        if isinstance(v, dict):
            yield {"number": n, "generation": 0, "type": "Catalog" if n == 0 else "Info", "value": to_json(v, f.limits.max_depth), "status": status()}


def decoded(f: File, decode: bool = True, number_: int | None = None) -> Iterator[dict]:
    """Streams' bytes, decoded if all their filters are known."""
    for n in sorted(f.entries) if number_ is None else [number_]:
        try:
            v = f.object(n)
            if not isinstance(v, Stream):
                continue
            data, ok, warning = f.decoded(v, f.limits.max_stream) if decode else (f.stored(v), not f.filters(v), None)
            yield {"number": n, "data": data, "decoded": ok, "filter": f.filters(v), "status": status(None, [warning] if warning else [])}
        except PdfError as e:
            yield {"number": n, "status": status(e)}


def _to_nul(v) -> str | None:
    """Text up to a NUL, as a file's own fields are read."""
    if not isinstance(v, bytes):
        return None
    return (v[2:].decode("utf-16-be", "replace") if v[:2] == b"\xfe\xff" else text_of(v.split(b"\0", 1)[0])).split("\0", 1)[0]


def meta(f: File) -> Iterator[dict]:
    info = f.dict_of(f.trailer.get("Info"))
    ids = f.get(f.trailer.get("ID"))
    bits = f.permissions
    row = {k.lower(): _to_nul(f.get(info.get(k))) for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")}
    yield row | {"version": f.version, "pages": len(f.pages()), "language": _to_nul(f.get(f.root.get("Lang"))), "created": _date(f, info.get("CreationDate")), "modified": _date(f, info.get("ModDate")), "id": [bytes(x).hex() for x in map(f.get, ids) if isinstance(x, bytes)] if isinstance(ids, list) else [], "encryption": f.encryption, "permissions": [k for k, m in PERMISSIONS.items() if bits & m], "status": status(None, f.warnings)}


def info(f: File) -> Iterator[dict]:
    d = f.dict_of(f.trailer.get("Info"))
    keys = {k: utf16(v[2:]) if v[:2] == b"\xfe\xff" else text_of(v) if isinstance(v, bytes) else str(v) for k, v in ((k, f.get(v)) for k, v in d.items()) if isinstance(v, (bytes, Name)) and k not in ("CreationDate", "ModDate")}
    linear = False
    for n in sorted(f.entries)[:3]:
        try:
            v = f.object(n)
        except PdfError:
            continue
        linear = linear or (isinstance(v, dict) and "Linearized" in v)
    xmp, v = "", f.root.get("Metadata")
    if isinstance(v, Ref) and isinstance(s := f.get(v), Stream):
        try:
            data, ok, _ = f.decoded(s, f.limits.max_stream)
            xmp = data.replace(b"\0", b"").decode("utf-8", "replace") if ok or not f.filters(s) else ""
        except LimitError:
            raise
        except PdfError:
            xmp = ""
    layout = f.get(f.root.get("PageLayout"))
    yield {"version": f.version, "pages": len(f.pages()), "encrypted": f.encryption != "none", "linearized": linear, "keys": list(keys.items()), "created": _date(f, d.get("CreationDate")), "modified": _date(f, d.get("ModDate")), "metadata": xmp, "locked": False, "attachments": any(True for _ in attachments(f)), "layout": LAYOUTS.get(str(layout), "no_layout") if isinstance(layout, Name) else "no_layout", "status": status(None, f.warnings)}


def box(f: File, v) -> list[float] | None:
    """Four numbers, corners put in order; None otherwise."""
    v = f.get(v)
    v = [number(f.get(x)) for x in v] if isinstance(v, list) and len(v) == 4 else [None]
    return None if None in v else [float(min(v[0], v[2])), float(min(v[1], v[3])), float(max(v[0], v[2])), float(max(v[1], v[3]))]


def pages(f: File, pages: list[int] | None = None) -> Iterator[dict]:
    """Boxes and rotations as they are written and inherited; clipping and rounding are left to the caller's columns."""
    for i, d in _wanted(f, pages):
        try:
            media = box(f, f.inherited(d, "MediaBox"))
            contents = f.get(d.get("Contents"))
            crop = f.inherited(d, "CropBox")
            yield {"page": i, "media_box": media, "crop_raw": box(f, crop), "rotate_raw": float(number(f.inherited(d, "Rotate"), 0)), "streams": len(contents) if isinstance(contents, list) else int(isinstance(contents, Stream)), "status": status()}
        except PdfError as e:
            yield {"page": i, "status": status(e)}


def page_tokens(f: File, pages: list[int] | None = None) -> Iterator[dict]:
    for i, d in _wanted(f, pages):
        warnings: list[str] = []
        try:
            for pos, (kind, value) in enumerate(tokens(page_content(f, d, Budget(f.limits.max_stream), warnings)), 1):
                yield {"page": i, "pos": pos, "type": kind, "value": value, "status": status(None, warnings)}
        except LimitError as e:
            yield {"page": i, "status": status(e)}


def _walks(f: File, pages: list[int] | None) -> Iterator[tuple[int, dict, Walk | None, dict]]:
    fonts: dict = {}
    for i, d in _wanted(f, pages):
        try:
            w = Walk(f, d, fonts)
            yield i, d, w, status(None, w.warnings)
        except LimitError as e:
            yield i, d, None, status(e)
        except PdfError as e:
            yield i, d, None, status(None, [str(e)])


def page_text(f: File, pages: list[int] | None = None, layout: str = "reading") -> Iterator[dict]:
    for i, _, w, said in _walks(f, pages):
        text = "" if w is None else w.raw_text() if layout == "raw" else reading_text(w.glyphs)
        yield {"page": i, "text": None if said["status"] == "error" else text, "unmapped": w.unmapped if w else 0, "status": said}


def glyphs(f: File, pages: list[int] | None = None) -> Iterator[dict]:
    for i, _, w, said in _walks(f, pages):
        if w is None and said["status"] == "error":
            yield {"page": i, "status": said}
        for seq, g in enumerate(w.glyphs if w else (), 1):
            yield {"page": i, "seq": seq, **dict(zip(g._fields, g)), "status": said}  # noqa: B905


def page_words(f: File, pages: list[int] | None = None) -> Iterator[dict]:
    for i, d, w, said in _walks(f, pages):
        if w is None and said["status"] == "error":
            yield {"page": i, "status": said}
        media = box(f, f.inherited(d, "MediaBox")) or [0, 0, 612.0, 792.0]
        for seq, x in enumerate(words(w.glyphs, media[3]) if w else (), 1):
            yield {"page": i, "seq": seq, **x, "status": said}


def _font_file(f: File, holder: dict) -> tuple[str, str | None]:
    d = f.dict_of(holder.get("FontDescriptor"))
    key = next((k for k in ("FontFile", "FontFile2", "FontFile3") if k in d), "")
    return key, name_of(f.get(f.dict_of(d.get(key)).get("Subtype"))) if key else None


def fonts(f: File) -> Iterator[dict]:
    """Every font dictionary but descendants: name, type, whether embedded, and the finer type that viewers report."""
    for n in sorted(f.entries):
        try:
            d = f.object(n)
            if not isinstance(d, dict) or f.get(d.get("Type")) != "Font":
                continue
            sub = name_of(f.get(d.get("Subtype")))
            if sub in ("CIDFontType0", "CIDFontType2"):
                continue
            kids = f.get(d.get("DescendantFonts"))
            holder = (f.dict_of(kids[0]) if isinstance(kids, list) and kids else {}) if sub == "Type0" else d
            key, inner = _font_file(f, holder)
            cid = sub == "Type0"
            kind = ("cid_truetype" if name_of(f.get(holder.get("Subtype"))) == "CIDFontType2" else "cid_type0") if cid else FONT_TYPES.get(sub or "", "unknown")
            fine = kind
            if kind not in ("type3", "unknown"):
                if key == "FontFile2" and cid:
                    fine = "cid_truetype"
                elif key == "FontFile3" and inner in ("Type1C", "CIDFontType0C"):
                    fine = "cid_type0c" if cid else "type1c"
                elif key == "FontFile3" and inner == "OpenType":
                    fine = {"type1": "type1c_ot", "truetype": "truetype_ot", "cid_type0": "cid_type0c_ot", "cid_truetype": "cid_truetype_ot"}[kind]
            yield {"object": n, "name": name_of(f.get(d.get("BaseFont"))), "type": sub, "embedded": sub == "Type3" or bool(key), "poppler_type": fine, "status": status()}
        except PdfError as e:
            yield {"object": n, "status": status(e)}


def images(f: File, pages: list[int] | None = None) -> Iterator[dict]:
    """Indirect image objects in the resources of each page, by name."""
    for i, d in _wanted(f, pages):
        res = f.dict_of(f.dict_of(f.inherited(d, "Resources")).get("XObject"))
        for key in sorted(res):
            v = res[key]
            try:
                s = f.get(v)
                if not isinstance(v, Ref) or not isinstance(s, Stream) or f.get(s.dict.get("Subtype")) != "Image":
                    continue
                whole = lambda k, s=s: int(x) if (x := number(f.get(s.dict.get(k)))) is not None and abs(x) < 2**31 else None
                space = f.get(s.dict.get("ColorSpace"))
                space = f.get(space[0]) if isinstance(space, list) and space else space
                yield {"page": i, "object": v.number, "name": str(key), "width": whole("Width"), "height": whole("Height"), "bits": whole("BitsPerComponent"), "color_space": name_of(space), "filter": (f.filters(s) or [None])[-1], "status": status()}
            except PdfError as e:
                yield {"page": i, "object": v.number if isinstance(v, Ref) else None, "name": str(key), "status": status(e)}


def image_data(f: File, native: bool = False) -> Iterator[dict]:
    """Every image that a page names; one that can't be read is a row with its failure."""
    for n in sorted({r["object"] for r in images(f) if r["object"]}):
        try:
            yield image(f, n, native)
        except PdfError as e:
            yield {"object": n, "status": status(e)}


def image(f: File, n: int, native: bool = False) -> dict:
    """An image's samples, or its pixels packed as 0xAABBGGRR by rows."""
    s = f.object(n)
    if not isinstance(s, Stream):
        raise ParseError(f"object {n} is no image", object=n)
    data, ok, _ = f.decoded(s, f.limits.max_stream)
    w, h = (int(number(f.get(s.dict.get(k)), 0)) for k in ("Width", "Height"))
    out = {"object": n, "width": w, "height": h, "data": data, "decoded": ok or not f.filters(s)}
    if native:
        space = f.get(s.dict.get("ColorSpace"))
        if isinstance(space, list) and f.get(space[0]) == "ICCBased":
            channels = int(number(f.get(f.dict_of(space[1]).get("N")), 0))
        else:
            channels = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3}.get(str(space[0] if isinstance(space, list) else space), 0)
        if not out["decoded"] or channels not in (1, 3) or number(f.get(s.dict.get("BitsPerComponent"))) != 8:
            raise UnsupportedInput("only decoded 8-bit grey and RGB images have pixels")
        if len(data) < w * h * channels:
            raise ParseError("image has too few samples", object=n)
        import numpy as np

        x = np.frombuffer(data, np.uint8, w * h * channels).reshape(-1, channels).astype(np.uint32)
        r, g, b = (x[:, min(i, channels - 1)] for i in range(3))
        out["pixels"] = (0xFF000000 | b << 16 | g << 8 | r).view(np.int32).tolist()
    return out


def toc(f: File) -> Iterator[dict]:
    """The outline flat: items in reading order with parent and depth. Each item once; bounded by depth and count."""
    seen: set[int] = set()
    todo: list[tuple] = [(f.dict_of(f.root.get("Outlines")).get("First"), None, 0, 1)]
    item = 0
    while todo:
        v, parent, depth, ordinal = todo.pop()
        d = f.get(v)
        n = v.number if isinstance(v, Ref) else id(d)
        if not isinstance(d, dict) or n in seen or depth > f.limits.max_depth or len(seen) >= f.limits.max_objects:
            continue
        seen.add(n)
        item += 1
        title = f.get(d.get("Title"))
        yield {"item": item, "parent": parent, "depth": depth, "ord": ordinal, "title": text_of(title) if isinstance(title, bytes) else "", "is_open": (number(f.get(d.get("Count")), 0)) > 0}
        todo.append((d.get("Next"), parent, depth, ordinal + 1))
        todo.append((d.get("First"), item, depth + 1, 1))


def attachments(f: File) -> Iterator[dict]:
    seen: set[int] = set()
    todo: list[tuple] = [(f.dict_of(f.root.get("Names")).get("EmbeddedFiles"), 0)]
    k = 0
    while todo:
        v, depth = todo.pop()
        d = f.get(v)
        n = v.number if isinstance(v, Ref) else 0
        if not isinstance(d, dict) or (n and n in seen) or depth > f.limits.max_depth:
            continue
        seen.add(n)
        names = f.get(d.get("Names"))
        if isinstance(names, list):
            for key, spec in zip(names[::2], names[1::2], strict=False):
                spec = f.dict_of(spec)
                ef = f.dict_of(spec.get("EF"))
                s = f.get(ef.get("UF") or ef.get("F"))
                said = next((x for x in (f.get(spec.get("UF")), f.get(spec.get("F")), f.get(key)) if isinstance(x, bytes)), b"")
                k += 1
                row = {"ord": k, "name": text_of(said), "description": text_of(x) if isinstance(x := f.get(spec.get("Desc")), bytes) else None}
                if isinstance(s, Stream):
                    params = f.dict_of(s.dict.get("Params"))
                    row |= {"mime": name_of(f.get(s.dict.get("Subtype"))), "created": _date(f, params.get("CreationDate")), "modified": _date(f, params.get("ModDate")), "data": f.decoded(s, f.limits.max_stream)[0]}
                yield row
        kids = f.get(d.get("Kids"))
        todo += [(x, depth + 1) for x in reversed(kids)] if isinstance(kids, list) else []


def bodies(f: File) -> Iterator[dict]:
    """Objects ready to be written into another file, references left open: a value's bytes are pieces with a reference between each two (refs; None is the new page tree). links: the references in the order of the value's entries.

    kind: page (with its inherited entries), object, or tree for nodes of the page tree, which are never written.
    """
    token = os.urandom(16).hex().encode()

    def row(v, **more) -> dict:
        refs: list[int | None] = []
        links: list[int] = []

        def open_(r: Ref) -> bytes:
            refs.append(None if r.generation < 0 else r.number)
            return token

        def linked(x, depth: int = 0) -> None:
            if depth > COPY_DEPTH:
                raise LimitError("copy_depth", COPY_DEPTH)
            if isinstance(x, Ref):
                if x.generation >= 0:
                    links.append(x.number)
            elif isinstance(x, (dict, list)):
                for y in x.values() if isinstance(x, dict) else x:
                    linked(y, depth + 1)

        data = None
        if isinstance(v, Stream):
            data = f.stored(v)
            v = {k: x for k, x in v.dict.items() if k != "Length"} | {"Length": len(data)}
        linked(v)
        return {"pieces": serialize(v, None, open_).split(token), "refs": refs, "links": links, "stream": data, "status": status()} | more

    pages, tree = f.pages(), tree_nodes(f)
    for i, (n, page) in enumerate(pages, 1):
        d = page_entries(f, page) | {"Type": Name("Page"), "Parent": Ref(2, -1)}
        d.setdefault("MediaBox", list(A4))
        yield row(d, kind="page", page=i, number=n)
    numbers = {n for n, _ in pages}
    for n in sorted(tree):
        yield {"kind": "tree", "number": n, "status": status()}
    for n in sorted(f.entries):
        if n in tree or n in numbers:
            continue
        try:
            yield row(f.object(n), kind="object", number=n)
        except PdfError as e:
            yield {"kind": "object", "number": n, "status": status(e)}
