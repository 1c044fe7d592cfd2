"""Images and TrueType fonts as objects of a written file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

from ..errors import FontError, UnsupportedInput
from .fonts import WIN
from .values import Name, Ref, Stream


def png(data: bytes) -> Stream:
    """A PNG without alpha or interlace: its compressed rows are kept as they are, under the same predictors."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise UnsupportedInput("no PNG")
    at, head, palette, idat = 8, None, None, []
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise UnsupportedInput("damaged PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    if head is None or not idat:
        raise UnsupportedInput("PNG has no image")
    width, height, bits, colour, _, _, interlace = head
    if colour not in (0, 2, 3) or interlace or (colour == 3 and not palette):
        raise UnsupportedInput("only PNG images without alpha and interlace can be placed")
    space = [Name("Indexed"), Name("DeviceRGB"), len(palette) // 3 - 1, palette] if colour == 3 else Name("DeviceGray" if colour == 0 else "DeviceRGB")
    parms = {"Predictor": 15, "Colors": 3 if colour == 2 else 1, "BitsPerComponent": bits, "Columns": width}
    return _image(width, height, bits, space, b"".join(idat), Filter=Name("FlateDecode"), DecodeParms=parms)


def jpeg(data: bytes) -> Stream:
    """A JPEG as it is; its frame header gives the size and channels."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        kind, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            bits, height, width, channels = struct.unpack(">BHHB", data[at + 4 : at + 10])
            spaces = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}
            if channels not in spaces:
                break
            return _image(width, height, bits, Name(spaces[channels]), data, Filter=Name("DCTDecode"))
        at += 2 + n
    raise UnsupportedInput("no JPEG that can be placed")


def samples(rows: Sequence, width: int, height: int, channels: int) -> Stream:
    """Values from 0 to 1, top row first and channels fastest, as 8-bit samples rounded half to even."""
    import numpy as np

    x = np.asarray(rows, dtype=np.float64).reshape(height * width * channels)
    if channels not in (1, 3) or not np.isfinite(x).all():
        raise UnsupportedInput("grey or RGB values that are finite can be placed")
    data = np.rint(np.clip(x, 0, 1) * 255).astype(np.uint8).tobytes()
    return _image(width, height, 8, Name("DeviceGray" if channels == 1 else "DeviceRGB"), zlib.compress(data), Filter=Name("FlateDecode"))


def _image(width: int, height: int, bits: int, space, data: bytes, **more) -> Stream:
    return Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": bits, "ColorSpace": space, "Interpolate": True} | more, data)


def image(data: bytes) -> Stream:
    return jpeg(data) if data[:2] == b"\xff\xd8" else png(data)


class TrueType:
    """What a simple font needs of a TrueType file: names of its tables, glyphs of characters, and advances."""

    def __init__(self, data: bytes):
        if data[:4] not in (b"\0\1\0\0", b"true"):
            raise FontError("not a TrueType font")
        try:
            self.data = data
            self.tables = {t: (o, n) for t, _, o, n in struct.iter_unpack(">4sIII", data[12 : 12 + 16 * struct.unpack(">H", data[4:6])[0]])}
            head, hhea = self._at(b"head"), self._at(b"hhea")
            self.units = struct.unpack(">H", head[18:20])[0]
            self.box = struct.unpack(">4h", head[36:44])
            self.ascent, self.descent = struct.unpack(">2h", hhea[4:8])
            n, hmtx = struct.unpack(">H", hhea[34:36])[0], self._at(b"hmtx")
            self.advance = [struct.unpack(">H", hmtx[4 * i : 4 * i + 2])[0] for i in range(n)]
            self.glyph = self._characters()
            self.name = self._name()
        except (struct.error, KeyError, IndexError) as e:
            raise FontError(f"damaged TrueType font: {e}") from None

    def _at(self, tag: bytes) -> bytes:
        o, n = self.tables[tag]
        return self.data[o : o + n]

    def _characters(self) -> dict[int, int]:
        cmap = self._at(b"cmap")
        for platform, encoding, at in struct.iter_unpack(">HHI", cmap[4 : 4 + 8 * struct.unpack(">H", cmap[2:4])[0]]):
            if (platform, encoding) not in ((3, 1), (0, 3), (0, 4)) or struct.unpack(">H", cmap[at : at + 2])[0] != 4:
                continue
            n = struct.unpack(">H", cmap[at + 6 : at + 8])[0] // 2
            read = lambda o, f="H": struct.unpack(f">{n}{f}", cmap[at + o : at + o + 2 * n])  # noqa: B023,E731
            ends, starts, deltas, offsets = read(14), read(16 + 2 * n), read(16 + 4 * n, "h"), read(16 + 6 * n)
            out = {}
            for i, (a, b, d, o) in enumerate(zip(starts, ends, deltas, offsets, strict=True)):
                for c in range(a, min(b, 0xFFFE) + 1):
                    if o:
                        place = at + 16 + 6 * n + 2 * i + o + 2 * (c - a)
                        g = struct.unpack(">H", cmap[place : place + 2])[0]
                        g = (g + d) & 0xFFFF if g else 0
                    else:
                        g = (c + d) & 0xFFFF
                    if g:
                        out[c] = g
            return out
        raise FontError("the font has no map of Unicode characters")

    def _name(self) -> str:
        table = self._at(b"name")
        count, strings = struct.unpack(">HH", table[2:6])
        for platform, _, _, what, n, o in struct.iter_unpack(">6H", table[6 : 6 + 12 * count]):
            if what == 6:
                raw = table[strings + o : strings + o + n]
                return raw.decode("utf-16-be" if platform in (0, 3) else "latin-1").replace(" ", "")
        return "Font"

    def width(self, point: int) -> float:
        return self.advance[min(self.glyph.get(point, 0), len(self.advance) - 1)] * 1000 / self.units


def add_truetype(b, data: bytes) -> tuple[Ref, TrueType]:
    """The font embedded whole, for text of code page 1252."""
    f = TrueType(data)
    per = lambda v: round(v * 1000 / f.units)
    file = b.stream(data, {"Length1": len(data)})
    desc = b.add({"Type": Name("FontDescriptor"), "FontName": Name(f.name), "Flags": 32, "FontBBox": [per(v) for v in f.box], "ItalicAngle": 0, "Ascent": per(f.ascent), "Descent": per(f.descent), "CapHeight": per(f.ascent), "StemV": 80, "FontFile2": file})
    widths = [round(f.width(WIN[c])) if WIN[c] else 0 for c in range(32, 256)]
    return b.add({"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name(f.name), "Encoding": Name("WinAnsiEncoding"), "FirstChar": 32, "LastChar": 255, "Widths": widths, "FontDescriptor": desc}), f


# --- subsets ---------------------------------------------------------------------------------------------------------------------

#: Flags of a composite glyph's parts (fixed values): words for arguments, a scale, more parts, two scales, a matrix.
_WORDS, _SCALE, _MORE, _SCALES, _MATRIX = 1, 8, 32, 64, 128
#: Tables that a font program in a file needs besides its glyphs.
_KEPT = (b"cvt ", b"fpgm", b"head", b"hhea", b"hmtx", b"maxp", b"prep")


class Subset:
    """The glyphs of a TrueType font that some characters need, with numbers of their own from 0, which is the one for characters that it lacks."""

    def __init__(self, font: TrueType, characters: set[int]):
        try:
            wide = struct.unpack(">h", font._at(b"head")[50:52])[0]
            n = struct.unpack(">H", font._at(b"maxp")[4:6])[0]
            loca = font._at(b"loca")
            self.starts = struct.unpack(f">{n + 1}I", loca[: 4 * (n + 1)]) if wide else tuple(2 * x for x in struct.unpack(f">{n + 1}H", loca[: 2 * (n + 1)]))
            self.font, self.outlines = font, font._at(b"glyf")
            self.old = [0]
            self.new = {0: 0}
            self.codes = {}
            for c in sorted(characters):
                if g := font.glyph.get(c, 0):
                    self.codes[c] = self._take(g)
            # What a composite is made of is taken too, and so on.
            at = 0
            while at < len(self.old):
                for _, part in self._parts(self.old[at]):
                    self._take(part)
                at += 1
        except (struct.error, KeyError, IndexError) as e:
            raise FontError(f"damaged TrueType font: {e}") from None

    def _take(self, glyph: int) -> int:
        if glyph not in self.new:
            self.new[glyph] = len(self.old)
            self.old.append(glyph)
        return self.new[glyph]

    def _outline(self, glyph: int) -> bytes:
        return self.outlines[self.starts[glyph] : self.starts[glyph + 1]]

    def _parts(self, glyph: int) -> list[tuple[int, int]]:
        """(place of its number, glyph) of each part of a composite glyph."""
        data, out = self._outline(glyph), []
        if len(data) < 10 or struct.unpack(">h", data[:2])[0] >= 0:
            return out
        at = 10
        while True:
            flags, part = struct.unpack(">HH", data[at : at + 4])
            out.append((at + 2, part))
            at += 4 + (4 if flags & _WORDS else 2) + (2 if flags & _SCALE else 4 if flags & _SCALES else 8 if flags & _MATRIX else 0)
            if not flags & _MORE:
                return out

    def program(self) -> bytes:
        """The font file: its glyphs under their new numbers."""
        glyf, loca, hmtx = bytearray(), [0], bytearray()
        n_metrics = struct.unpack(">H", self.font._at(b"hhea")[34:36])[0]
        metrics = self.font._at(b"hmtx")
        for g in self.old:
            data = bytearray(self._outline(g))
            for place, part in self._parts(g):
                data[place : place + 2] = struct.pack(">H", self.new[part])
            glyf += data + b"\0" * (-len(data) % 4)
            loca.append(len(glyf))
            bearing = metrics[4 * g + 2 : 4 * g + 4] if g < n_metrics else metrics[4 * n_metrics + 2 * (g - n_metrics) :][:2]
            hmtx += struct.pack(">H", self.font.advance[min(g, len(self.font.advance) - 1)]) + (bearing or b"\0\0")
        head, hhea, maxp = bytearray(self.font._at(b"head")), bytearray(self.font._at(b"hhea")), bytearray(self.font._at(b"maxp"))
        head[8:12], head[50:52] = bytes(4), struct.pack(">h", 1)
        hhea[34:36] = maxp[4:6] = struct.pack(">H", len(self.old))
        tables = {t: self.font._at(t) for t in _KEPT if t in self.font.tables} | {b"glyf": bytes(glyf), b"loca": struct.pack(f">{len(loca)}I", *loca), b"hmtx": bytes(hmtx), b"head": bytes(head), b"hhea": bytes(hhea), b"maxp": bytes(maxp)}
        return _font_file(tables)


def _sum(data: bytes) -> int:
    data += b"\0" * (-len(data) % 4)
    return sum(struct.unpack(f">{len(data) // 4}I", data)) & 0xFFFFFFFF


def _font_file(tables: dict[bytes, bytes]) -> bytes:
    """Tables with their directory and sums."""
    n = len(tables)
    log = n.bit_length() - 1
    at, entries, body = 12 + 16 * n, [], []
    for tag, data in sorted(tables.items()):
        entries.append(struct.pack(">4sIII", tag, _sum(data), at, len(data)))
        body.append(data + b"\0" * (-len(data) % 4))
        at += len(body[-1])
    out = bytearray(struct.pack(">4sHHHH", b"\0\1\0\0", n, 16 << log, log, 16 * n - (16 << log)) + b"".join(entries) + b"".join(body))
    head = struct.unpack(">I", next(e for e in entries if e[:4] == b"head")[8:12])[0]
    out[head + 8 : head + 12] = struct.pack(">I", (0xB1B0AFBA - _sum(bytes(out))) & 0xFFFFFFFF)
    return bytes(out)


def add_subset(b, data: bytes, characters: set[int]) -> tuple[Ref, Subset]:
    """A font for any characters, embedded as the glyphs that these need: two-byte codes are the glyphs' numbers, and a map back to Unicode."""
    f = TrueType(data)
    s = Subset(f, characters)
    per = lambda v: round(v * 1000 / f.units)
    program = s.program()
    # Six letters that follow from the glyphs mark a subset.
    tag, left = "", zlib.crc32(struct.pack(f">{len(s.old)}H", *s.old))
    for _ in range(6):
        left, letter = divmod(left, 26)
        tag += chr(65 + letter)
    name = Name(f"{tag}+{f.name}")
    file = b.stream(program, {"Length1": len(program)})
    desc = b.add({"Type": Name("FontDescriptor"), "FontName": name, "Flags": 4, "FontBBox": [per(v) for v in f.box], "ItalicAngle": 0, "Ascent": per(f.ascent), "Descent": per(f.descent), "CapHeight": per(f.ascent), "StemV": 80, "FontFile2": file})
    widths = [per(f.advance[min(g, len(f.advance) - 1)]) for g in s.old]
    kid = b.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": name, "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "FontDescriptor": desc, "CIDToGIDMap": Name("Identity"), "DW": 1000, "W": [0, widths]})
    lines = [b"<%04X> <%s>" % (code, chr(c).encode("utf-16-be").hex().upper().encode()) for c, code in sorted(s.codes.items(), key=lambda x: x[1])]
    # A block of a map holds at most a hundred lines.
    blocks = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(part), b"\n".join(part)) for part in (lines[i : i + 100] for i in range(0, len(lines), 100)))
    to_unicode = b.stream(b"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /Adobe-Identity-UCS def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n" + blocks + b"endcmap\nend\nend")
    return b.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": name, "Encoding": Name("Identity-H"), "DescendantFonts": [kid], "ToUnicode": to_unicode}), s
