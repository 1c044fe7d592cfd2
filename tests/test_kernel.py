import zlib

import pytest

from folio.errors import InvalidArgument, LimitError, ParseError, PasswordError
from folio.functions.scalars import paper_size
from folio.kernel import crypt, rows
from folio.kernel.content import Walk, tokens
from folio.kernel.fonts import code_point
from folio.kernel.serialize import Builder, copy_pages, serialize, text_width
from folio.kernel.syntax import File, Parser
from folio.kernel.values import Name, Ref, Stream, seconds, text_of
from folio.layout import reading_text, words
from folio.limits import Limits
from folio.plans.synth import pdf, shown


def walk(content: bytes, **options) -> Walk:
    f = File(pdf(content, **options))
    return Walk(f, f.pages()[0][1])


def test_tokens_of_a_mixed_stream():
    got = tokens(b"BT /F1 12 Tf [(a) -5 <4142>] TJ << /K 1 >> BDC ET")
    assert [t for t, _ in got] == ["operator", "name", "number", "operator", "array_open", "string", "number", "string", "array_close", "operator", "dict_open", "name", "number", "dict_close", "operator", "operator"]
    assert [got[i][1] for i in (1, 2, 5, 7)] == ["F1", "12", "a", "AB"]


def test_escapes_and_comments():
    got = tokens(b"(a\\tb\\\\g\\(h\\)i\\101\\7j(k)l) /A#20B % a comment\n(m\\\nn) (o\\\r\np) <41 4>")
    assert [v for _, v in got] == ["a\tb\\g(h)iA\aj(k)l", "A B", "mn", "op", "A@"]


def test_inline_image_is_one_token():
    assert tokens(b"BI /W 1 /H 1 ID \0\1\2 EI Q")[-2:] == [("inline_image", "3 bytes"), ("operator", "Q")]
    assert tokens(b"BI /W 1 /H 1 ID xyz ")[-1] == ("inline_image", "4 bytes")


def test_layouts():
    w = walk(b"BT /F1 12 Tf 72 600 Td (second) Tj ET BT /F1 12 Tf 72 700 Td (first) Tj ET BT /F1 12 Tf 200 700 Td (right) Tj ET")
    assert reading_text(w.glyphs) == "first right\nsecond"
    assert w.raw_text() == "second\nfirst\nright"


def test_gaps_and_line_operators():
    w = walk(b"BT /F1 12 Tf 72 700 Td [(Hel) -20 (lo) -900 (World)] TJ ET")
    assert reading_text(w.glyphs) == w.raw_text() == "Hello World"
    w = walk(b"BT /F1 12 Tf 14 TL 72 700 Td (one) Tj T* (two) Tj (three) ' 0 0 (four) \" ET")
    assert reading_text(w.glyphs) == "one\ntwo\nthree\nfour"


def test_words_have_boxes():
    got = words(walk(shown("Hello from here."), font="Helvetica").glyphs, 792)
    assert [(w["text"], w["space"]) for w in got] == [("Hello", True), ("from", True), ("here.", False)]
    assert (got[0]["x"], got[0]["y"]) == (72, 63)


def test_operands_beyond_the_bound_drop_the_oldest():
    w = walk(b"BT /F1 12 Tf 72 700 Td (a) Tj " + b"9 " * 98 + b"0 -14 Td (b) Tj ET")
    assert w.raw_text() == "a\nb"


def test_unmapped_codes_count():
    w = walk(b"BT /F1 12 Tf 72 700 Td (a\\tb) Tj ET")
    assert (reading_text(w.glyphs), w.unmapped) == ("a�b", 1)


def test_glyph_names():
    assert [chr(code_point(n)) for n in ("Aring", "uni263A", "u1F600", "eacute.sc", "F", "space", "germandbls")] == ["Å", "☺", "😀", "é", "F", " ", "ß"]
    assert code_point("g123") == 0
    # Of every rule some names, with the code points that the public glyph list gives.
    listed = {
        "AEacute": 0x1FC, "oslashacute": 0x1FF, "Aringacute": 0x1FA, "ohorn": 0x1A1, "Scommaaccent": 0x218, "tcommaaccent": 0x163, "Gcommaaccent": 0x122, "Idotaccent": 0x130, "dcroat": 0x111, "Alphatonos": 0x386, "iotadieresistonos": 0x390, "Upsilondieresis": 0x3AB,
        "delta": 0x3B4, "Delta": 0x394, "omega": 0x3C9, "Omega": 0x3A9, "Mu": 0x39C, "mu": 0xB5, "lambda": 0x3BB, "sigma1": 0x3C2, "Asmall": 0xF761, "AEsmall": 0xF7E6, "Acutesmall": 0xF7B4, "Ydieresissmall": 0xF7FF, "Scaronsmall": 0xF6FD, "exclamdownsmall": 0xF7A1,
        "nineoldstyle": 0xF739, "centoldstyle": 0xF7A2, "twosuperior": 0xB2, "zerosuperior": 0x2070, "sixinferior": 0x2086, "parenleftinferior": 0x208D, "nsuperior": 0x207F, "tsuperior": 0xF6F3, "bracerightbt": 0xF8FE, "threequartersemdash": 0xF6DE, "dblgrave": 0xF6D6,
        "afii10017": 0x410, "afii10049": 0x42F, "afii10071": 0x451, "afii10097": 0x44F, "afii57434": 0x63A, "afii57690": 0x5EA, "afii00208": 0x2015, "afii299": 0x200E, "afii64937": 0x2BD, "SF010000": 0x250C, "SF280000": 0x255B, "SF540000": 0x256A,
        "arrowdblright": 0x21D2, "musicalnotedbl": 0x266B, "seveneighths": 0x215E, "weierstrass": 0x2118, "hbar": 0x127, "minus": 0xAD,
    }
    assert {n: code_point(n) for n in listed} == listed
    assert not any(map(code_point, ("afii10111", "SF120000", "small", "superior", "ninferior", "xyzacute", "a" * 200 + "acute")))


def test_forms_are_bounded():
    def more(b, res):
        form = b.reserve()
        b.put(form, Stream({"Subtype": Name("Form"), "Resources": {"XObject": {"F": form}}}, b"/F Do"))
        res["XObject"] = {"F": form}

    f = File(pdf(b"/F Do", more=more))
    with pytest.raises(LimitError) as e:
        Walk(f, f.pages()[0][1])
    assert e.value.fields["limit"] == "max_depth" and e.value.fields["cycle"]


def test_page_budget():
    data = pdf(shown("x" * 500))
    f = File(data, Limits(max_stream=1000))
    assert reading_text(Walk(f, f.pages()[0][1]).glyphs)
    f = File(data, Limits(max_stream=100))
    with pytest.raises(LimitError):
        Walk(f, f.pages()[0][1])


def test_flate_bomb_stops():
    f = File(pdf(b" " * (1 << 24), flate=True), Limits(max_stream=1e6))
    with pytest.raises(LimitError):
        list(Walk(f, f.pages()[0][1]).glyphs)


def test_object_limit_is_exact():
    data = pdf(b"")
    n = len(File(data).entries)
    assert File(data, Limits(max_objects=n))
    with pytest.raises(LimitError):
        File(data, Limits(max_objects=n - 1))


def test_pages_are_independent():
    f = File(pdf(shown("one"), b" " * 5000, shown("three"), flate=True), Limits(max_stream=1000))
    got = list(rows.page_text(f))
    assert [r["text"] for r in got] == ["one", None, "three"]
    assert got[1]["status"]["class"] == "limit_error"


def test_repair():
    data = pdf(shown("text"))
    for bad in (data.replace(b"startxref", b"startxxxx"), data[: data.rfind(b"xref\n0")], data.replace(b"xref\n0 ", b"xref\n9 ")):
        f = File(bad)
        assert f.warnings and reading_text(Walk(f, f.pages()[0][1]).glyphs) == "text"
    for bad in (b"", b"no file", b"%PDF-1.4\nnothing"):
        with pytest.raises(ParseError):
            File(bad)


def test_cross_reference_streams_and_object_streams():
    inner = b"<</Type/Catalog/Pages 2 0 R>> <</Type/Pages/Kids[3 0 R]/Count 1>> <</Type/Page/MediaBox[0 0 9 9]>>"
    offs = [0, inner.find(b"<</Type/Pages"), inner.find(b"<</Type/Page/")]
    head = b" ".join(b"%d %d" % (i + 1, o) for i, o in enumerate(offs)) + b" "
    body = zlib.compress(head + inner)
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj <</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>\nstream\n" % (len(head), len(body)) + body + b"\nendstream endobj\n"
    at5 = len(out)
    rows_ = b"".join(bytes([2]) + (4).to_bytes(2) + bytes([i]) for i in range(3)) + bytes([1]) + at4.to_bytes(2) + b"\0" + bytes([1]) + at5.to_bytes(2) + b"\0"
    out += b"5 0 obj <</Type/XRef/W[1 2 1]/Index[1 5]/Size 6/Root 1 0 R/Length %d>>\nstream\n" % len(rows_) + rows_ + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at5
    f = File(out)
    assert not f.warnings and len(f.pages()) == 1


def test_text_strings_and_dates():
    assert text_of(bytes([0x80, 0x20, 0xA0, 0x20, 0xE9])) == "• € é"
    assert text_of("é".encode()) == "é" and text_of(b"\xfe\xff\0A\0B") == "AB"
    assert seconds(b"D:20240702030405+02'00") == 1719882245
    assert seconds(b"19700101000000Z") is None
    assert Builder(created=32535215999).info and Builder(created=0).info
    for wrong in (-1, 32535216000):
        with pytest.raises(InvalidArgument):
            Builder(created=wrong)


@pytest.mark.parametrize("method", ["aes128", "rc4128"])
def test_encryption(method):
    b = Builder()
    b.encrypt("user", "owner", method, ["print", "copy"])
    b.info["Title"] = "Tïtle"
    font = b.core_font("Courier")
    b.page(shown("secret"), {"Font": {"F1": font}})
    data = b.save()
    for word in ("user", "owner"):
        f = File(data, passwords=(word,))
        m = next(rows.meta(f))
        assert reading_text(Walk(f, f.pages()[0][1]).glyphs) == "secret"
        assert (m["title"], m["permissions"]) == ("Tïtle", ["print", "copy"])
    with pytest.raises(PasswordError):
        File(data)
    with pytest.raises(PasswordError):
        File(data, passwords=("wrong",))


def test_published_cipher_vectors():
    key = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
    assert crypt._encrypt_block(crypt._schedule(key), bytes.fromhex("3243f6a8885a308d313198a2e0370734")).hex() == "3925841d02dc09fbdc118597196a0b32"
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_values_round_trip():
    for v in (None, True, 3, -2.5, Name("A B"), "plain", "ünïcode", [1, [2, Name("x")]], {"K": {"L": [Ref(3, 0)]}}):
        got, _ = Parser(serialize(v)).value(0)
        assert (text_of(got) if isinstance(got, bytes) else got) == v


def test_writer_is_deterministic():
    assert pdf(shown("x")) == pdf(shown("x")) != pdf(shown("y"))
    f = File(pdf(shown("x")))
    assert len(f.trailer["ID"][0]) == 16 and f.trailer["ID"][0] != bytes(16)


def test_copies_keep_links_within_and_drop_others():
    def more(b, res):
        res["Note"] = {"P": Ref(5, 0)}

    b = Builder()
    copy_pages(b, File(pdf(shown("one"), shown("two"), more=more)), [2, 1, 2], 90)
    f = File(b.save())
    assert [reading_text(Walk(f, p).glyphs) for _, p in f.pages()] == ["two", "one", "two"]
    assert all(p["Rotate"] == 90 for _, p in f.pages())
    with pytest.raises(InvalidArgument):
        copy_pages(Builder(), f, [4])


def test_copy_of_a_long_chain():
    def chain(n):
        def more(b, res):
            refs = [b.reserve() for _ in range(n)]
            for a, c in zip(refs, [*refs[1:], None], strict=True):
                b.put(a, {"Next": c})
            res["Chain"] = refs[0]

        return pdf(b"", more=more)

    b = Builder()
    copy_pages(b, File(chain(1000)), [1])
    assert len(File(b.save()).entries) > 1000


def test_widths_and_paper():
    assert text_width("Hello", "Helvetica", 10) == pytest.approx(22.78)
    assert text_width("abc", "Courier", 10) == pytest.approx(18)
    assert [paper_size(n) for n in ("a4", "A5", "b5")] == [(595.28, 841.89), (419.53, 595.28), (498.9, 708.66)]
    with pytest.raises(InvalidArgument):
        paper_size("a99")


def test_limits_are_checked():
    for bad in (0, -1, 1.5, True, "x"):
        with pytest.raises(InvalidArgument):
            Limits(max_pages=bad)


def test_placed_images_and_fonts():
    import struct

    from folio.errors import FontError, UnsupportedInput
    from folio.operators.write import build

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows_ = b"".join(b"\0" + bytes([i, i + 1, i + 2, 9, 8, 7]) for i in range(2))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows_)) + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xc0\0\x11\x08\0\x05\0\x07\x03" + bytes(20)
    ops = [(1, 1, "image", [0, 0, 10, 10, 0], "a"), (1, 2, "image", [0, 0, 10, 10, 0], "b"), (2, 1, "image", [0, 0, 5, 5, 0], "a")]
    f = File(build(ops, images={"a": png, "b": jpeg}))
    found = list(rows.images(f))
    assert [(r["page"], r["name"], r["width"], r["height"], r["filter"]) for r in found] == [(1, "a", 2, 2, "FlateDecode"), (1, "b", 7, 5, "DCTDecode"), (2, "a", 2, 2, "FlateDecode")]
    assert found[0]["object"] == found[2]["object"]
    got = rows.image(f, found[0]["object"], native=True)
    assert got["data"] == bytes([0, 1, 2, 9, 8, 7, 1, 2, 3, 9, 8, 7]) and got["pixels"][0] & 0xFFFFFFFF == 0xFF020100
    with pytest.raises(UnsupportedInput):
        rows.image(f, found[1]["object"], native=True)
    with pytest.raises(InvalidArgument):
        build(ops)
    with pytest.raises(FontError):
        build([(1, 1, "text", [0, 0, 12, 1, 0], "x\tt")], fonts={"x": b"none"})


def test_truetype_font():
    from pathlib import Path

    from folio.operators.write import build

    path = Path("/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf")
    if not path.exists():
        pytest.skip("no font file here")
    f = File(build([(1, 1, "text", [72, 700, 12, 1, 0], "sans\tWörld fit")], fonts={"sans": path.read_bytes()}))
    w = Walk(f, f.pages()[0][1])
    assert reading_text(w.glyphs) == "Wörld fit"
    assert next(rows.fonts(f)) | {"status": None, "object": None} == {"object": None, "name": "DejaVuSans", "type": "TrueType", "embedded": True, "poppler_type": "truetype", "status": None}


def test_sample_values():
    from folio.kernel.embed import samples

    assert zlib.decompress(samples([0, 0.5, 1.5, -1], 2, 2, 1).raw) == bytes([0, 128, 255, 0])


def test_metadata_in_both_versions():
    from folio.operators.write import build

    ops = [(1, 1, "text", [72, 700, 12, 1, 0], "Courier\tx")]
    old = File(build(ops, meta={"title": "Tïtle", "author": "A", "language": "de", "modified": 86400}))
    m = next(rows.meta(old))
    assert (m["title"], m["author"], m["language"], m["modified"].timestamp()) == ("Tïtle", "A", "de", 86400)
    new = File(build(ops, version="2.0", meta={"title": "T & U"}))
    assert next(rows.meta(new))["title"] is None and "<dc:title>T &amp; U</dc:title>" in next(rows.info(new))["metadata"]


def test_operators_of_text_go_by_their_second_byte():
    f = File(pdf(b"BT /F1 12 Tfx 72 720 Tdd (a) Tjj T ET"))
    assert "".join(g.text for g in Walk(f, f.pages()[0][1], {}).glyphs) == "a"


@pytest.mark.parametrize("font, text, width", [("Helvetica", "Hello", 2278), ("Helvetica-Bold", "Hello", 2445), ("Times-Roman", "Hello", 2222), ("Times-Bold", "Hello", 2278), ("Times-Italic", "Hello", 2222), ("Times-BoldItalic", "Hello", 2278), ("Courier-Bold", "Hello", 3000), ("Helvetica", "íé“€”", 278 + 556 + 333 + 556 + 333), ("Times-Italic", "A—Æß", 611 + 889 + 889 + 500), ("Times-BoldItalic", "Éµ¿", 667 + 576 + 500), ("Helvetica-Oblique", "î", 278)])
def test_widths_of_core_fonts(font, text, width):
    """Sums of the published metrics."""
    assert text_width(text, font, 1000) == width
