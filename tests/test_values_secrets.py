"""Formatted values, passwords of files, failure summaries and subsets of fonts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.functions.values import formatted
from folio.kernel.embed import Subset, TrueType, add_subset
from folio.kernel.serialize import Builder
from folio.operators import documents as D
from folio.operators import write as W
from folio.plans import synth as S

FONT = Path("/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf")


def test_formatted_values(spark):
    cases = [('{"name":"Page"}', "/Page"), ('{"ref":7,"gen":2}', "7 2 R"), ('{"bin":"q80="}', "<abcd>"), ('{"bin":""}', "<>"), ('"a}}b {\\"name\\":\\"x\\"}"', '"a}}b {\\"name\\":\\"x\\"}"'), ("1.5", "1.5"), ("true", "true"), ("null", "null"), ('{"date":5}', "5"), ("[]", "[]"), ('{"dict":{}}', "{}"),
             ('{"dict":{"name":"v","K":[{"ref":1,"gen":0},{"dict":{"X":{"name":"Y"}}}],"N":null}}', '{K [1 0 R, {X /Y}], N null, name "v"}'), ("[[[[[[1]]]]]]", "[[[[[...]]]]]"), (None, None)]
    rows = spark.createDataFrame(list(enumerate(x for x, _ in cases)), "i int, v string").select("i", formatted(F.parse_json("v")).alias("t"))
    assert {r["i"]: r["t"] for r in rows.collect()} == {i: t for i, (_, t) in enumerate(cases)}


def locked(user: str, text: str) -> bytes:
    b = Builder("1.6", S.LETTER)
    b.encrypt(user, "owner" + user)
    b.page(S.shown(text), {"Font": {"F1": b.core_font("Courier")}})
    return b.save()


def test_a_password_for_each_file(spark):
    files = spark.createDataFrame([(i, locked(f"pw{i}", f"text {i}")) for i in range(4)] + [(9, S.pdf(S.shown("open")))], "file_id int, content binary")
    secrets = spark.createDataFrame([(0, "pw0", 1), (1, "wrong", 1), (1, "ownerpw1", 2), (1, None, 0), (2, "wrong", 1)], "file_id int, password string, ord int")
    held = D.with_secrets(files, secrets)
    got = {r["file_id"]: (r["text"], r["status"]["class"]) for r in D.page_text(held).collect()}
    assert got == {0: ("text 0", None), 1: ("text 1", None), 2: (None, "password_error"), 3: (None, "password_error"), 9: ("open", None)}
    got = {r["file_id"]: r["text"] for r in D.page_text(held, passwords=("pw2", "pw3")).collect()}
    assert got == {0: "text 0", 1: "text 1", 2: "text 2", 3: "text 3", 9: "open"}
    plan = D.page_text(held)._jdf.queryExecution().toString()
    assert "pw0" not in plan and "ownerpw1" not in plan


def test_encryption_by_rows(spark):
    files = spark.createDataFrame([(i, S.pdf(S.shown(f"text {i}"), info={"Title": b"T%d" % i})) for i in range(3)] + [(3, b"none"), (4, S.pdf(b""))], "file_id int, content binary")
    secrets = spark.createDataFrame([(0, "u0", "o0", "aes128", ["print"]), (1, "", "o1", "rc4128", None), (3, "u", "o", None, None), (4, "u", "o", "des", None)], "file_id int, user string, owner string, method string, permissions array<string>")
    made = W.encrypt(files, secrets).cache()
    assert {r["file_id"]: r["status"]["class"] for r in made.collect()} == {0: None, 1: None, 2: None, 3: "parse_error", 4: "invalid_argument"}
    ok = made.where("content is not null").select("file_id", "content")
    meta = {r["file_id"]: (r["encryption"], r["title"], r["permissions"]) for r in D.meta(ok, passwords=("u0",)).collect()}
    assert meta[0][:2] == ("aes-128", "T0") and meta[0][2] == ["print"] and meta[1][:2] == ("rc4-128", "T1") and meta[2][:2] == ("none", "T2")
    text = {r["file_id"]: (r["text"], r["status"]["class"]) for r in D.page_text(ok).collect()}
    assert text == {0: (None, "password_error"), 1: ("text 1", None), 2: ("text 2", None)}
    assert {r["file_id"]: r["text"] for r in D.page_text(D.with_secrets(ok, secrets.select("file_id", F.col("owner").alias("password"), F.lit(1).alias("ord")))).collect()} == {0: "text 0", 1: "text 1", 2: "text 2"}


def test_failures_and_observation(spark):
    files = spark.createDataFrame([(1, S.pdf(b"")), (2, b"none"), (3, None)], "file_id int, content binary")
    table, seen = D.observed(D.page_text(files), "text")
    rows = table.collect()
    assert len(rows) == 3 and {k: seen.get[k] for k in ("rows", "failed", "parse_errors", "invalid_arguments")} == {"rows": 3, "failed": 2, "parse_errors": 1, "invalid_arguments": 1}
    told = {r["file_id"]: (r["n"], r["class"]) for r in D.failures(D.page_text(files)).collect()}
    assert told == {2: (1, "parse_error"), 3: (1, "invalid_argument")}
    many = spark.createDataFrame([(1, 5, "parse_error"), (1, 3, "limit_error"), (1, 9, None), (2, 1, None)], "file_id int, number bigint, class string").select("file_id", "number", F.struct("class", F.lit("m").alias("message")).alias("status"))
    assert [tuple(r) for r in D.failures(many).collect()] == [(1, 2, [3, 5], "limit_error", "m")]


@pytest.mark.skipif(not FONT.exists(), reason="no TrueType font")
def test_subset_of_a_font(spark):
    """Greek, Cyrillic, composites and a character beyond the first plane's Latin come back, and the file is a fraction of the font."""
    data = FONT.read_bytes()
    text = "Ωμέγα Ж ǻ ệ ŝ A"
    made = W.build([(1, 1, "text", [72, 700, 12, 1, 0], f"D\t{text}"), (1, 2, "text", [72, 600, 12, 1, 0], "D\tno \U0010ffff glyph")], fonts={"D": data})
    assert len(made) < len(data) / 10
    got = D.page_text(spark.createDataFrame([(1, made)], "file_id int, content binary")).collect()
    assert got[0]["text"].split("\n")[0] == text
    fonts = D.font_table(spark.createDataFrame([(1, made)], "file_id int, content binary")).collect()
    assert [(r["type"], r["embedded"]) for r in fonts] == [("Type0", True)] and fonts[0]["name"][6] == "+"
    # A font whose texts are Western only is embedded whole, as before.
    assert len(W.build([(1, 1, "text", [72, 700, 12, 1, 0], "D\tplain")], fonts={"D": data})) > len(made)


@pytest.mark.skipif(not FONT.exists(), reason="no TrueType font")
def test_subset_program():
    """Every glyph of the subset has the outline, parts and advance of its original."""
    font = TrueType(FONT.read_bytes())
    s = Subset(font, {ord(c) for c in "ệǻÅAé"})
    program = s.program()
    again = TrueType.__new__(TrueType)
    again.data = program
    import struct

    again.tables = {t: (o, n) for t, _, o, n in struct.iter_unpack(">4sIII", program[12 : 12 + 16 * struct.unpack(">H", program[4:6])[0]])}
    starts = struct.unpack(f">{len(s.old) + 1}I", again._at(b"loca"))
    advance = [struct.unpack(">H", again._at(b"hmtx")[4 * i : 4 * i + 2])[0] for i in range(len(s.old))]
    assert len(s.old) > len(s.codes) + 1 and sum(struct.unpack(f">{len(program) // 4}I", program)) & 0xFFFFFFFF == 0xB1B0AFBA
    for new, old in enumerate(s.old):
        got, want = again._at(b"glyf")[starts[new] : starts[new + 1]], s._outline(old)
        places = {p for at, _ in s._parts(old) for p in (at, at + 1)}
        assert all(a == b for i, (a, b) in enumerate(zip(got, want)) if i not in places) and len(got) - len(want) in range(4)
        assert advance[new] == font.advance[min(old, len(font.advance) - 1)]
        assert all(struct.unpack(">H", got[at : at + 2])[0] == s.new[part] for at, part in s._parts(old))
    b = Builder()
    assert add_subset(b, FONT.read_bytes(), {65, 0x1F600})[1].codes.keys() == {65}


def test_output_names(spark):
    from folio.errors import InvalidArgument
    from folio.functions.scalars import output_name, safe_outputs

    paths = ["/a/x.pdf", "/a/x.PDF", "/a/x.pdf.pdf", "/a/xpdf", "/a/x.pdf\n", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [tuple(r) for r in df.select(output_name(F.col("path"), "subset"), output_name(F.col("path"), "combine"), output_name(F.col("path"), "split", F.lit(3))).collect()]
    stems = ["/a/x", "/a/x", "/a/x.pdf", "/a/xpdf", "/a/x.pdf\n"]
    assert got == [(f"{s}_output.pdf", f"{s}_combined.pdf", f"{s}_3.pdf") for s in stems] + [(None,) * 3]
    told = safe_outputs(spark.createDataFrame([("/o",), ("/i",), ("/t",), ("/t",), (None,)], "output string"), spark.createDataFrame([("/i",), ("/i",), (None,)], "path string"))
    assert sorted(((r["output"] or "", r["clash"]) for r in told.collect()), key=str) == sorted([("/o", None), ("/i", "output must not overwrite an input"), ("/t", "several files would go there"), ("/t", "several files would go there"), ("", "output is needed for a file from memory")], key=str)
    with pytest.raises(InvalidArgument):
        output_name(F.col("path"), "split")
