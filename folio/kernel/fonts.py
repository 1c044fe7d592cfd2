"""Fonts: encodings, glyph names, character maps, widths."""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right

from ..errors import LimitError
from ..limits import MAP_RANGES
from .syntax import File, Keyword, Parser
from .values import Name, Stream, number

# Glyph names of signs, whose names follow no rule.
_SIGNS = dict(zip("space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde quoteright quoteleft exclamdown cent sterling currency yen brokenbar section dieresis copyright ordfeminine guillemotleft logicalnot registered macron degree plusminus acute mu paragraph periodcentered cedilla ordmasculine guillemotright onequarter onehalf threequarters questiondown multiply divide quotesinglbase quotedblbase quotedblleft quotedblright ellipsis dagger daggerdbl bullet endash emdash perthousand guilsinglleft guilsinglright fraction florin trademark fi fl Euro minus dotlessi AE ae OE oe Oslash oslash germandbls Eth eth Thorn thorn Lslash lslash circumflex tilde breve dotaccent ring hungarumlaut ogonek caron infinity notequal lessequal greaterequal partialdiff summation product pi integral radical approxequal lozenge ff ffi ffl nbspace".split(), " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~’‘¡¢£¤¥¦§¨©ª«¬®¯°±´µ¶·¸º»¼½¾¿×÷‚„“”…†‡•–—‰‹›⁄ƒ™ﬁﬂ€\u00adıÆæŒœØøßÐðÞþŁłˆ˜˘˙˚˝˛ˇ∞≠≤≥∂∑∏π∫√≈◊ﬀﬃﬄ\u00a0", strict=True))
# Fixed values of the public glyph list: mathematics and fractions; arrows and shapes; other marks and letters.
_SIGNS |= dict(zip("angle angleleft angleright asteriskmath circlemultiply circleplus congruent dotmath element notelement suchthat emptyset equivalence existential universal gradient intersection union logicaland logicalor notsubset orthogonal perpendicular propersubset propersuperset proportional reflexsubset reflexsuperset revlogicalnot similar therefore integraltp integralbt aleph Ifraktur Rfraktur weierstrass estimated prescription oneeighth threeeighths fiveeighths seveneighths onethird twothirds".split(), "\u2220\u2329\u232A\u2217\u2297\u2295\u2245\u22C5\u2208\u2209\u220B\u2205\u2261\u2203\u2200\u2207\u2229\u222A\u2227\u2228\u2284\u221F\u22A5\u2282\u2283\u221D\u2286\u2287\u2310\u223C\u2234\u2320\u2321\u2135\u2111\u211C\u2118\u212E\u211E\u215B\u215C\u215D\u215E\u2153\u2154", strict=True))
_SIGNS |= dict(zip("arrowleft arrowup arrowright arrowdown arrowboth arrowupdn arrowupdnbse carriagereturn arrowdblleft arrowdblup arrowdblright arrowdbldown arrowdblboth house upblock dnblock block lfblock rtblock ltshade shade dkshade filledbox H22073 H18543 H18551 filledrect triagup triagrt triagdn triaglf circle H18533 invbullet invcircle openbullet smileface invsmileface sun female male spade club heart diamond musicalnote musicalnotedbl".split(), "\u2190\u2191\u2192\u2193\u2194\u2195\u21A8\u21B5\u21D0\u21D1\u21D2\u21D3\u21D4\u2302\u2580\u2584\u2588\u258C\u2590\u2591\u2592\u2593\u25A0\u25A1\u25AA\u25AB\u25AC\u25B2\u25BA\u25BC\u25C4\u25CB\u25CF\u25D8\u25D9\u25E6\u263A\u263B\u263C\u2640\u2642\u2660\u2663\u2665\u2666\u266A\u266B", strict=True))
_SIGNS |= dict(zip("figuredash exclamdbl quotereversed onedotenleader twodotenleader minute second underscoredbl colonmonetary franc lira peseta dong gravecomb acutecomb tildecomb hookabovecomb dotbelowcomb tonos dieresistonos anoteleia Dcroat dcroat Hbar hbar IJ ij kgreenlandic Ldot ldot napostrophe Eng eng Tbar tbar longs theta1 Upsilon1 phi1 omega1 sigma1".split(), "\u2012\u203C\u201B\u2024\u2025\u2032\u2033\u2017\u20A1\u20A3\u20A4\u20A7\u20AB\u0300\u0301\u0303\u0309\u0323\u0384\u0385\u0387\u0110\u0111\u0126\u0127\u0132\u0133\u0138\u013F\u0140\u0149\u014A\u014B\u0166\u0167\u017F\u03D1\u03D2\u03D5\u03D6\u03C2", strict=True))
# Names that stand one after the other in the private use area, from these code points.
_PRIVATE = {
    0xF6BE: "dotlessj LL ll",
    0xF6C3: "commaaccent",
    0xF6C9: "Acute Caron Dieresis DieresisAcute DieresisGrave Grave Hungarumlaut Macron cyrBreve cyrFlex dblGrave cyrbreve cyrflex dblgrave dieresisacute dieresisgrave copyrightserif registerserif trademarkserif onefitted rupiah threequartersemdash",
    0xF6DF: "centinferior centsuperior commainferior commasuperior dollarinferior dollarsuperior hypheninferior hyphensuperior periodinferior periodsuperior asuperior bsuperior dsuperior esuperior isuperior lsuperior msuperior osuperior rsuperior ssuperior tsuperior",
    0xF6F4: "Brevesmall Caronsmall Circumflexsmall Dotaccentsmall Hungarumlautsmall Lslashsmall OEsmall Ogoneksmall Ringsmall Scaronsmall Tildesmall Zcaronsmall",
    0xF8E5: "radicalex arrowvertex arrowhorizex registersans copyrightsans trademarksans parenlefttp parenleftex parenleftbt bracketlefttp bracketleftex bracketleftbt bracelefttp braceleftmid braceleftbt braceex integralex parenrighttp parenrightex parenrightbt bracketrighttp bracketrightex bracketrightbt bracerighttp bracerightmid bracerightbt",
}
_SIGNS |= {name: chr(first + i) for first, names in _PRIVATE.items() for i, name in enumerate(names.split())}
# Numbered names of box drawing, SF010000 and so on with two gaps.
_BOXES = dict(zip([*range(1, 12), *range(19, 29), *range(36, 55)], "\u250C\u2514\u2510\u2518\u253C\u252C\u2534\u251C\u2524\u2500\u2502\u2561\u2562\u2556\u2555\u2563\u2551\u2557\u255D\u255C\u255B\u255E\u255F\u255A\u2554\u2569\u2566\u2560\u2550\u256C\u2567\u2568\u2564\u2565\u2559\u2558\u2552\u2553\u256B\u256A", strict=True))
# Numbered names of Cyrillic, Arabic, Hebrew and others; first and last number of a run, its first code point.
_NUMBERED = [
    (208, 208, 0x2015), (299, 300, 0x200E), (301, 301, 0x200D),
    (10017, 10022, 0x410), (10023, 10023, 0x401), (10024, 10049, 0x416), (10050, 10050, 0x490), (10051, 10061, 0x402), (10062, 10062, 0x40E), (10063, 10064, 0xF6C4), (10065, 10070, 0x430), (10071, 10071, 0x451),
    (10072, 10097, 0x436), (10098, 10098, 0x491), (10099, 10109, 0x452), (10110, 10110, 0x45E), (10145, 10145, 0x40F), (10146, 10146, 0x462), (10147, 10147, 0x472), (10148, 10148, 0x474), (10192, 10192, 0xF6C6),
    (10193, 10193, 0x45F), (10194, 10194, 0x463), (10195, 10195, 0x473), (10196, 10196, 0x475), (10831, 10832, 0xF6C7), (10846, 10846, 0x4D9),
    (57381, 57381, 0x66A), (57388, 57388, 0x60C), (57392, 57401, 0x660), (57403, 57403, 0x61B), (57407, 57407, 0x61F), (57409, 57434, 0x621), (57440, 57446, 0x640), (57448, 57458, 0x648), (57470, 57470, 0x647),
    (57505, 57505, 0x6A4), (57506, 57506, 0x67E), (57507, 57507, 0x686), (57508, 57508, 0x698), (57509, 57509, 0x6AF), (57511, 57511, 0x679), (57512, 57512, 0x688), (57513, 57513, 0x691), (57514, 57514, 0x6BA),
    (57519, 57519, 0x6D2), (57534, 57534, 0x6D5), (57636, 57636, 0x20AA), (57645, 57645, 0x5BE), (57658, 57658, 0x5C3), (57664, 57690, 0x5D0), (57694, 57695, 0xFB2A), (57700, 57700, 0xFB4B), (57705, 57705, 0xFB1F),
    (57716, 57718, 0x5F0), (57723, 57723, 0xFB35), (57793, 57795, 0x5B4), (57796, 57796, 0x5BB), (57797, 57797, 0x5B8), (57798, 57798, 0x5B7), (57799, 57799, 0x5B0), (57800, 57800, 0x5B2), (57801, 57801, 0x5B1),
    (57802, 57802, 0x5B3), (57803, 57803, 0x5C2), (57804, 57804, 0x5C1), (57806, 57806, 0x5B9), (57807, 57807, 0x5BC), (57839, 57839, 0x5BD), (57841, 57841, 0x5BF), (57842, 57842, 0x5C0), (57929, 57929, 0x2BC),
    (61248, 61248, 0x2105), (61289, 61289, 0x2113), (61352, 61352, 0x2116), (61573, 61575, 0x202C), (61664, 61664, 0x200C), (63167, 63167, 0x66D), (64937, 64937, 0x2BD),
]
_DIGITS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True))
_ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "macron": "\u0304", "breve": "\u0306", "dotaccent": "\u0307", "dieresis": "\u0308", "ring": "\u030a", "hungarumlaut": "\u030b", "caron": "\u030c", "cedilla": "\u0327", "ogonek": "\u0328", "commaaccent": "\u0327", "horn": "\u031b", "tonos": "\u0301"}
_GREEK = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Sigma Tau Upsilon Phi Chi Psi Omega".split()


def _accented(base: str) -> int:
    """A letter with one or two accents named after it. The comma under an S is Unicode's own, under other letters its cedilla."""
    for accent, mark in _ACCENTS.items():
        if base.endswith(accent) and (letter := code_point(base[: -len(accent)])) and unicodedata.category(chr(letter))[0] == "L":
            if accent == "commaaccent" and chr(letter) in "Ss":
                mark = "\u0326"
            if len(c := unicodedata.normalize("NFC", chr(letter) + mark)) == 1:
                return ord(c)
    return 0


def _variant(base: str) -> int:
    """Small capitals and old-style figures, which stand in the private use area at their Latin-1 letter's place; raised and lowered figures and brackets."""
    for tail in ("small", "oldstyle"):
        if base.endswith(tail) and 0 < (point := code_point(base[: -len(tail)].lower())) < 256:
            return 0xF700 + point
    if m := re.fullmatch(r"(\w+?)(superior|inferior)", base):
        said = {"parenleft": "LEFT PARENTHESIS", "parenright": "RIGHT PARENTHESIS", "n": "LATIN SMALL LETTER N"}.get(m[1], m[1].upper() if m[1] in _DIGITS else None)
        return ord(unicodedata.lookup(f"{'SUPERSCRIPT' if m[2] == 'superior' else 'SUBSCRIPT'} {said}")) if said and (m[1] != "n" or m[2] == "superior") else 0
    return 0


@functools.lru_cache(1 << 14)
def code_point(glyph: str) -> int:
    """The code point of a glyph name; 0 for an unknown one. A suffix after ``.`` or ``_`` is left off."""
    base = re.split(r"[._]", glyph, maxsplit=1)[0]
    if base in _SIGNS:
        return ord(_SIGNS[base])
    if base in _DIGITS:
        return ord(_DIGITS[base])
    if len(base) == 1 and base.isascii() and base.isalpha():
        return ord(base)
    if base.capitalize() in _GREEK:
        return ord(unicodedata.lookup(f"GREEK {'CAPITAL' if base[0].isupper() else 'SMALL'} LETTER {'LAMDA' if base.lower() == 'lambda' else base.upper()}"))
    if m := re.fullmatch(r"afii([0-9]{3,5})", base):
        return next((to + int(m[1]) - lo for lo, hi, to in _NUMBERED if lo <= int(m[1]) <= hi), 0)
    if m := re.fullmatch(r"SF([0-9]{2})0000", base):
        return ord(_BOXES.get(int(m[1]), "\0"))
    if 2 < len(base) < 30 and (point := _accented(base) or _variant(base)):
        return point
    if m := re.match(r"uni([0-9A-Fa-f]{4})", base) or re.fullmatch(r"u([0-9A-Fa-f]{4,6})", base):
        v = int(m[1], 16)
        return v if v < 0x110000 and not 0xD800 <= v < 0xE000 else 0
    return 0


def _codec(name: str) -> list[int]:
    """Code points by code of a single-byte encoding; 0 where it has none."""
    out = []
    for i in range(256):
        c = bytes([i]).decode(name, "replace")
        out.append(0 if i < 32 or c == "�" or 0x7F <= ord(c) < 0xA0 else ord(c))
    return out


WIN = _codec("cp1252")
MAC = _codec("mac_roman")
MAC[0xDB] = ord("¤")
# StandardEncoding: ASCII but for two quotes, then these codes (fixed values).
STANDARD = [i if 32 <= i < 127 else 0 for i in range(256)]
STANDARD[0x27], STANDARD[0x60] = ord("’"), ord("‘")
for _at, _chars in ((0xA1, "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ"), (0xB1, "–†‡·"), (0xB6, "¶•‚„”»…‰"), (0xBF, "¿"), (0xC1, "`´ˆ˜¯˘˙¨"), (0xCA, "˚¸"), (0xCD, "˝˛ˇ—"), (0xE1, "Æ"), (0xE3, "ª"), (0xE8, "ŁØŒº"), (0xF1, "æ"), (0xF5, "ı"), (0xF8, "łøœß")):
    STANDARD[_at : _at + len(_chars)] = map(ord, _chars)

# Advance widths of the core fonts for codes 32 to 126, in thousandths (fixed values of the published metrics). Accented letters have their letter's width.
_HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
_HELVETICA_BOLD = [278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584]
_TIMES = [250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, *[500] * 10, 278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541]
_TIMES_BOLD = [250, 333, 555, 500, 500, 1000, 833, 278, 333, 333, 500, 570, 250, 333, 250, 278, *[500] * 10, 333, 333, 570, 570, 570, 500, 930, 722, 667, 722, 722, 667, 611, 778, 778, 389, 500, 778, 667, 944, 722, 778, 611, 778, 722, 556, 667, 722, 722, 1000, 722, 722, 667, 333, 278, 333, 581, 500, 333, 500, 556, 444, 556, 444, 333, 500, 556, 278, 333, 556, 278, 833, 556, 500, 556, 556, 444, 389, 333, 556, 500, 722, 500, 500, 444, 394, 220, 394, 520]
_TIMES_ITALIC = [250, 333, 420, 500, 500, 833, 778, 214, 333, 333, 500, 675, 250, 333, 250, 278, *[500] * 10, 333, 333, 675, 675, 675, 500, 920, 611, 611, 667, 722, 611, 611, 722, 722, 333, 444, 667, 556, 833, 667, 722, 611, 722, 611, 500, 556, 722, 611, 833, 611, 556, 556, 389, 278, 389, 422, 500, 333, 500, 500, 444, 500, 444, 278, 500, 500, 278, 278, 444, 278, 722, 500, 500, 500, 500, 389, 389, 278, 500, 444, 667, 444, 444, 389, 400, 275, 400, 541]
_TIMES_BOLD_ITALIC = [250, 389, 555, 500, 500, 833, 778, 278, 333, 333, 500, 570, 250, 333, 250, 278, *[500] * 10, 333, 333, 570, 570, 570, 500, 832, 667, 667, 667, 722, 667, 667, 722, 778, 389, 500, 667, 611, 889, 722, 722, 611, 722, 667, 556, 611, 722, 667, 889, 667, 611, 611, 333, 278, 333, 570, 500, 333, 500, 500, 444, 500, 444, 333, 500, 556, 278, 278, 500, 278, 778, 556, 500, 500, 500, 389, 389, 278, 556, 444, 667, 500, 444, 389, 348, 220, 348, 570]
# Widths of signs, and of letters that aren't a letter with an accent: Helvetica, its bold, Times, its bold, its italic, its bold italic (fixed values of the same metrics).
_OTHER_WIDTHS = [
    ("€ƒ†‡–¢£¤¥§«»", 556, 556, 500, 500, 500, 500), ("‚‘’", 222, 278, 333, 333, 333, 333), ("„“”", 333, 500, 444, 500, 556, 500), ("…—", 1000, 1000, 1000, 1000, 889, 1000),
    ("ˆ˜¨¯´¸‹›", 333, 333, 333, 333, 333, 333), ("‰", 1000, 1000, 1000, 1000, 1000, 1000), ("•", 350, 350, 350, 350, 350, 350), ("°", 400, 400, 400, 400, 400, 400), ("™", 1000, 1000, 980, 1000, 980, 1000),
    ("¡", 333, 333, 333, 333, 389, 389), ("¦", 260, 280, 200, 220, 275, 220), ("©®", 737, 737, 760, 747, 760, 747), ("ª", 370, 370, 276, 300, 276, 266), ("¬", 584, 584, 564, 570, 675, 606),
    ("±×÷", 584, 584, 564, 570, 675, 570), ("²³¹", 333, 333, 300, 300, 300, 300), ("µ", 556, 611, 500, 556, 500, 576), ("¶", 537, 556, 453, 540, 523, 500), ("·", 278, 278, 250, 250, 250, 250),
    ("º", 365, 365, 310, 330, 310, 300), ("¼½¾", 834, 834, 750, 750, 750, 750), ("¿", 611, 611, 444, 500, 500, 500), ("\xa0", 278, 278, 250, 250, 250, 250), ("\xad", 333, 333, 333, 333, 333, 333),
    ("Œ", 1000, 1000, 889, 1000, 944, 944), ("œ", 944, 944, 722, 722, 667, 722), ("Æ", 1000, 1000, 889, 1000, 889, 944), ("æ", 889, 889, 667, 722, 667, 722), ("Ð", 722, 722, 722, 722, 722, 722),
    ("ð", 556, 611, 500, 500, 500, 500), ("Ø", 778, 778, 722, 778, 722, 722), ("ø", 611, 611, 500, 500, 500, 500), ("Þ", 667, 667, 556, 611, 611, 611), ("þ", 556, 611, 500, 556, 500, 500), ("ß", 611, 611, 500, 556, 500, 500),
]
#: Families of the core fonts: widths, ascent, descent.
CORE = {f: ([600] * 95, 0.629, -0.157) for f in ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique")}
CORE |= {f: (_HELVETICA_BOLD if "Bold" in f else _HELVETICA, 0.718, -0.207) for f in ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique")}
CORE |= {f: (w, 0.683, -0.217) for f, w in (("Times-Roman", _TIMES), ("Times-Bold", _TIMES_BOLD), ("Times-Italic", _TIMES_ITALIC), ("Times-BoldItalic", _TIMES_BOLD_ITALIC))}
CORE |= {f: ([500] * 95, 1.010, -0.293) for f in ("Symbol", "ZapfDingbats")}


def core_name(base: str | None) -> str | None:
    base = re.sub(r"^[A-Z]{6}\+", "", base or "")
    return base if base in CORE else None


_SIGN_WIDTHS = [{ord(c): row[1 + i] for row in _OTHER_WIDTHS for c in row[0]} for i in range(6)]


@functools.lru_cache(64)
def core_widths(font: str, points: tuple[int, ...]) -> tuple[float, ...]:
    """The widths of an encoding's code points; the same few encodings come again in every file."""
    return tuple(float(core_width(font, p)) for p in points)


def core_width(font: str, point: int) -> int:
    """The width of a code point in a core font: its own, or that of its letter without accent (under an accent Helvetica's i is as wide as its bold one); half an em where there is neither. Courier: 600."""
    widths = CORE[font][0]
    if font.startswith("Courier"):
        return 600
    if 32 <= point < 127:
        return widths[point - 32]
    family = ("Helvetica", "Times").index(font.split("-")[0]) if font[:1] in "HT" else None
    if family is None:
        return 500
    bold, slanted = "Bold" in font, family and "Italic" in font
    found = _SIGN_WIDTHS[2 * family + bold + 2 * bool(slanted)].get(point)
    if found is not None:
        return found
    base = unicodedata.normalize("NFD", chr(point))[:1] if point else ""
    if base == "i":
        return 278
    return widths[ord(base) - 32] if base and 32 <= ord(base) < 127 else 500 if family else 556


class CharMap:
    """A ToUnicode map: ranges (low, high, bytes) to texts; the last code point advances along a range."""

    def __init__(self):
        self.ranges: list[tuple[int, int, str | list[str]]] = []
        self.lows: list[int] = []
        self.code_bytes, self.identity = 0, False

    def lookup(self, code: int) -> str | None:
        i = bisect_right(self.lows, code) - 1
        for j in range(i, max(-1, i - 10), -1):
            lo, hi, to = self.ranges[j]
            if lo <= code <= hi:
                if isinstance(to, list):
                    return to[code - lo] if code - lo < len(to) else None
                last = ord(to[-1]) + code - lo if to else 0
                return (to[:-1] + chr(last))[:8] if to and last < 0x110000 else None
        return chr(code) if self.identity and not 0xD800 <= code < 0xE000 else "�" if self.identity else None


def _points(b: bytes) -> str:
    return b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")


def parse_map(data: bytes) -> CharMap:
    out, stack, at, p, spaces = CharMap(), [], 0, Parser(data), False
    while True:
        v, at = p.value(at)
        if not isinstance(v, Keyword):
            stack.append(v)
            if len(stack) > 4 * MAP_RANGES:
                raise LimitError("max_stream", MAP_RANGES)
            continue
        if v == "" and at >= len(data):
            break
        if v == "endcodespacerange" and not spaces and stack and isinstance(stack[0], bytes):
            out.code_bytes, spaces = len(stack[0]), True
        elif v == "endbfchar":
            for a, b in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out.ranges.append((int.from_bytes(a), int.from_bytes(a), _points(b)))
        elif v == "endbfrange":
            for a, b, c in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                if isinstance(a, bytes) and isinstance(b, bytes) and isinstance(c, (bytes, list)):
                    out.ranges.append((int.from_bytes(a), int.from_bytes(b), _points(c) if isinstance(c, bytes) else [_points(x) for x in c if isinstance(x, bytes)]))
        if len(out.ranges) > MAP_RANGES:
            raise LimitError("max_stream", MAP_RANGES)
        stack = []
    out.ranges.sort(key=lambda r: r[0])
    out.lows = [r[0] for r in out.ranges]
    out.identity = not out.ranges and b"Identity-UCS2" in data
    return out


class Font:
    """What the text walk needs of a font dictionary: codes of a string, their texts, widths, and the line's extent."""

    def __init__(self, file: File | None, d: dict | None, spend=None):
        get = file.get if file else (lambda v: v)
        self.d = d = d or {}
        self.subtype = get(d.get("Subtype"))
        base = get(d.get("BaseFont"))
        self.name = re.sub(r"^[A-Z]{6}\+", "", str(base)) if isinstance(base, Name) else ""
        self.two = self.subtype == "Type0"
        self.map: CharMap | None = None
        self.shown: dict[int, tuple[str, float, bool]] = {}  # text, advance and whether it is unmapped, of codes met
        self.scale = 0.001
        if d and (m := get(d.get("ToUnicode"))) is not None:
            if isinstance(m, Stream):
                data, ok, _ = file.decoded(m, file.limits.max_stream)
                if spend:
                    spend(len(data))
                if ok or not file.filters(m):
                    self.map = parse_map(data)
            elif isinstance(m, Name) and "Identity" in m:
                self.map = CharMap()
                self.map.identity = True
        holder = d
        if self.two:
            kids = get(d.get("DescendantFonts"))
            holder = (file.dict_of(kids[0]) if isinstance(kids, list) and kids else {}) if file else {}
        desc = file.dict_of(holder.get("FontDescriptor")) if file else {}
        core = core_name(str(base) if isinstance(base, Name) else None)
        self.points = self._encoding(file, d)
        self.ascent, self.descent = self._extent(get, desc, core, d)
        if self.two:
            self._cid_widths(file, holder)
        else:
            self._simple_widths(file, d, desc, core)

    def _encoding(self, file, d) -> list[int]:
        get = file.get if file else (lambda v: v)
        e = get(d.get("Encoding"))
        tables = {"WinAnsiEncoding": WIN, "MacRomanEncoding": MAC, "StandardEncoding": STANDARD}
        if isinstance(e, Name):
            return tables.get(str(e), STANDARD)
        if not isinstance(e, dict):
            return STANDARD
        out = list(tables.get(str(get(e.get("BaseEncoding"))), STANDARD))
        code = 0
        for x in get(e.get("Differences")) or []:
            x = get(x)
            if isinstance(x, Name):
                if 0 <= code < 256:
                    out[code] = code_point(str(x))
                code += 1
            elif number(x) is not None:
                code = int(x)
        return out

    def _extent(self, get, desc, core, d) -> tuple[float, float]:
        up, down = (CORE[core][1:] if core else (0.8, -0.2))
        a, b = number(get(desc.get("Ascent"))), number(get(desc.get("Descent")))
        if self.subtype == "Type3":
            box, matrix = get(d.get("FontBBox")), get(d.get("FontMatrix"))
            m = number(get(matrix[3]), 0.001) if isinstance(matrix, list) and len(matrix) == 6 else 0.001
            if isinstance(box, list) and len(box) == 4:
                a, b = ((number(get(box[i]), 0) * m * 1000) for i in (3, 1))
        return a / 1000 if a and a > 0 else up, b / 1000 if b and b < 0 else down

    def _simple_widths(self, file, d, desc, core) -> None:
        get = file.get if file else (lambda v: v)
        given, missing = get(d.get("Widths")), number(get(desc.get("MissingWidth")))
        if self.subtype == "Type3":
            matrix = get(d.get("FontMatrix"))
            self.scale = abs(number(get(matrix[0]), 0.001)) if isinstance(matrix, list) and len(matrix) == 6 else 0.001
        if isinstance(given, list):
            self.widths = [float(missing or 0)] * 256
            first = int(number(get(d.get("FirstChar")), 0))
            for i, w in enumerate(given[:256]):
                if 0 <= first + i < 256:
                    self.widths[first + i] = float(number(get(w), 0))
        elif core:
            self.widths = list(core_widths(core, tuple(self.points)))
        else:
            self.widths = [float(missing if missing is not None else 500)] * 256

    def _cid_widths(self, file, holder) -> None:
        self.default = float(number(file.get(holder.get("DW")), 1000))
        self.cid: dict[int, float] = {}
        self.runs: list[tuple[int, int, float]] = []
        w, i = file.get(holder.get("W")) or [], 0
        while isinstance(w, list) and i + 1 < len(w):
            a, b = file.get(w[i]), file.get(w[i + 1])
            if isinstance(b, list):
                self.cid.update({int(number(a, 0)) + k: float(number(file.get(x), 0)) for k, x in enumerate(b[:MAP_RANGES])})
                i += 2
            else:
                if i + 2 < len(w):
                    self.runs.append((int(number(a, 0)), int(number(b, 0)), float(number(file.get(w[i + 2]), 0))))
                i += 3
            if len(self.cid) > MAP_RANGES:
                raise LimitError("max_objects", MAP_RANGES)

    def codes(self, s: bytes) -> list[tuple[int, int]]:
        """(code, bytes) of the string's characters."""
        if not self.two:
            return [(c, 1) for c in s]
        n = self.map.code_bytes if self.map and self.map.code_bytes else 2
        return [(int.from_bytes(s[i : i + n]), len(s[i : i + n])) for i in range(0, len(s), n)]

    def text(self, code: int) -> str | None:
        if self.map and (t := self.map.lookup(code)) is not None:
            return t
        if not self.two and code < 256 and self.points[code]:
            return chr(self.points[code])
        return None

    def width(self, code: int) -> float:
        if not self.two:
            return self.widths[code] if code < 256 else 0.0
        if code in self.cid:
            return self.cid[code]
        return next((w for a, b, w in self.runs if a <= code <= b), self.default)


FALLBACK = Font(None, None)
