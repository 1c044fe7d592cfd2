"""Driver queries of the PDF engine and their SQL, by name: tables become PDFs, the operator reads or writes them, and SQL over the table says what must come out."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.values import formatted
from ..kernel.fonts import CORE
from ..kernel.serialize import Builder, date_string
from ..kernel.values import Hex, Name, Stream
from ..limits import Limits
from ..operators import documents as D
from ..operators import draw as P
from ..operators import graph as G
from ..operators import native as N
from ..operators import write as W
from ..sources import pdf as pdf_source
from ..sources import sink
from ..sources.store import shared_folder
from . import synth as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return S.files(_table(spark, sf, "nation"), lambda r: S.pdf(S.shown(r["n_name"])), "n_nationkey")


def _regions(spark: SparkSession, sf: str, pages: int = 3) -> DataFrame:
    """A file for each region: its pages say the name, the key and numbers."""
    return S.files(_table(spark, sf, "region"), lambda r: S.pdf(S.shown(r["r_name"]), S.shown(f"key {r['r_regionkey']}"), *(S.shown(f"page {i}") for i in range(3, pages + 1))), "r_regionkey")


# --- text ------------------------------------------------------------------------------------------------------------------------

_PT = "SELECT n_nationkey::BIGINT AS file_id, 1::INT AS page, n_name AS text FROM nation"


@query(_PT)
def page_text_reading(spark, sf):
    return D.page_text(_nations(spark, sf)).select("file_id", "page", "text")


def _two_lines(spark, sf):
    n, r = _table(spark, sf, "nation"), _table(spark, sf, "region")
    both = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return S.files(both, lambda x: S.pdf(S.shown(x["n_name"], y=600) + b" " + S.shown(x["r_name"], y=700)), "n_nationkey")


@query("SELECT n_nationkey::BIGINT AS file_id, n_name || chr(10) || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def page_text_raw(spark, sf):
    return D.page_text(_two_lines(spark, sf), "raw").select("file_id", "text")


@query("SELECT n_nationkey::BIGINT AS file_id, r_name || chr(10) || n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def reading_order(spark, sf):
    return D.page_text(_two_lines(spark, sf)).select("file_id", "text")


_THREE = "(SELECT r_regionkey::BIGINT AS file_id, unnest([1, 2, 3])::INT AS page, unnest([r_name, 'key ' || r_regionkey, 'page 3']) AS text FROM region)"


@query(f"SELECT * FROM {_THREE}")
def page_text_multi(spark, sf):
    return D.page_text(_regions(spark, sf)).select("file_id", "page", "text")


@query(f"SELECT * FROM {_THREE} WHERE page IN (1, 3)")
def page_text_pages(spark, sf):
    return D.page_text(_regions(spark, sf), pages=[1, 3]).select("file_id", "page", "text")


@query("SELECT n_nationkey::BIGINT AS file_id, 1::INT AS page, n_name || chr(10) AS text FROM nation")
def pdf_text(spark, sf):
    return D.pdf_text(_nations(spark, sf))


@query("SELECT n_nationkey::BIGINT AS file_id, n_name || chr(65533) AS text, 1::INT AS unmapped FROM nation")
def unmapped_count(spark, sf):
    f = S.files(_table(spark, sf, "nation"), lambda r: S.pdf(b"BT /F1 12 Tf 72 720 Td (" + r["n_name"].encode() + b"\\201) Tj ET"), "n_nationkey")
    return D.page_text(f).select("file_id", "text", "unmapped")


_TOKENS = """SELECT n_nationkey::BIGINT AS file_id, k::INT AS pos,
  list_extract(['operator','name','number','operator','number','number','operator','string','operator','operator'], k) AS type,
  list_extract(['BT','F1','12','Tf','72','720','Td',n_name,'Tj','ET'], k) AS value
FROM (SELECT n_nationkey, n_name, unnest(range(1, 11)) AS k FROM nation)"""


@query(_TOKENS)
def tokens(spark, sf):
    return D.tokens(_nations(spark, sf)).select("file_id", "pos", "type", "value")


@query(f"SELECT type, count(*)::BIGINT AS n FROM ({_TOKENS}) GROUP BY type")
def token_counts(spark, sf):
    return D.tokens(_nations(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey::BIGINT AS file_id, i::INT AS seq, round(72 + 7.2::DOUBLE * (i - 1), 6)::DOUBLE AS x0, substr(n_name, i, 1) AS text
FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1))::INT AS i FROM nation)""")
def glyphs(spark, sf):
    return D.glyphs(_nations(spark, sf)).select("file_id", "seq", F.round("x0", 6).alias("x0"), "text")


_WORDS = """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
u AS (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM t),
v AS (SELECT p_partkey, i, w[i] AS text, len(w) AS n, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0) AS start FROM u)
SELECT p_partkey::BIGINT AS file_id, i::INT AS seq, round_even(7.2 * length(text), 0)::INT AS width, 9::INT AS height, round_even(72 + 7.2 * start, 0)::INT AS x, 64::INT AS y, i < n AS space, text{} FROM v"""


def _parts(spark, sf):
    return S.files(_table(spark, sf, "part").select("p_partkey", "p_name"), lambda r: S.pdf(S.shown(r["p_name"])), "p_partkey")


@query(_WORDS.format(""))
def words(spark, sf):
    return D.data(_parts(spark, sf)).drop("page", "status")


@query(_WORDS.format(", 'Courier' AS font_name, 12.0::DOUBLE AS font_size"))
def words_font_info(spark, sf):
    return D.data(_parts(spark, sf), font_info=True).drop("page", "status")


@query("SELECT c_custkey::BIGINT AS file_id, length(c_name) * 6.0::DOUBLE AS width FROM customer")
def text_width(spark, sf):
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"), scalars.text_width(F.col("c_name"), "Courier", 10).alias("width"))


def _encoded(kind: str):
    """A file's text shown in another way: through a form, a two-byte font, differences, gaps, or after an inline image."""
    def make(r: dict) -> bytes:
        name = r["n_name"]
        if kind == "form":
            def more(b: Builder, res: dict) -> None:
                res["XObject"] = {"Fm1": b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 612, 792], "Matrix": [1, 0, 0, 1, 0, 10]}, S.shown(name)))}

            return S.pdf(b"q /Fm1 Do Q", more=more)
        if kind == "type0":
            def more(b: Builder, res: dict) -> None:
                rows = b"".join(b"<%04X> <%04X>\n" % (i + 1, ord(c)) for i, c in enumerate(name))
                cmap = b.add(Stream({}, b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n%d beginbfchar\n%sendbfchar" % (len(name), rows)))
                kid = b.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("X"), "DW": 600})
                res["Font"]["F2"] = b.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-H"), "DescendantFonts": [kid], "ToUnicode": cmap})

            codes = b"".join(b"%04X" % (i + 1) for i in range(len(name)))
            return S.pdf(b"BT /F2 12 Tf 72 720 Td <" + codes + b"> Tj ET", more=more)
        if kind == "differences":
            glyph = {"_": "underscore"} | dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))

            def more(b: Builder, res: dict) -> None:
                res["Font"]["F2"] = b.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": {"Differences": [1, *(Name(glyph.get(c, c)) for c in name)]}})

            return S.pdf(b"BT /F2 12 Tf 72 720 Td <" + bytes(range(1, len(name) + 1)).hex().encode() + b"> Tj ET", more=more)
        if kind == "glyph_rules":
            k = r["n_nationkey"]
            digit = "zero one two three four five six seven eight nine".split()[k % 10]

            def more(b: Builder, res: dict) -> None:
                named = (f"afii{10072 + k}", f"{chr(65 + k)}small", f"{digit}oldstyle", f"{digit}inferior", "Scommaaccent", "upsilondieresistonos")
                res["Font"]["F2"] = b.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": {"Differences": [1, *map(Name, named)]}})

            return S.pdf(b"BT /F2 12 Tf 72 720 Td <010203040506> Tj ET", more=more)
        if kind == "gaps":
            a, b = name[:3].encode(), name[3:].encode()
            return S.pdf(b"BT /F1 12 Tf 72 720 Td [(" + a + b") -20 (" + b + b") -900 (end)] TJ ET")
        return S.pdf(b"BI /W 1 /H 1 /BPC 8 /CS /G ID x EI " + S.shown(name))

    return lambda spark, sf: D.page_text(S.files(_table(spark, sf, "nation"), make, "n_nationkey")).select("file_id", "page", "text")


for _name, _kind, _tail in (("form_xobject", "form", ""), ("type0_cmap", "type0", ""), ("differences", "differences", ""), ("glyph_rules", "glyph_rules", None), ("tj_gaps", "gaps", " || ' end'"), ("inline_image", "image", "")):
    QUERIES[_name] = _encoded(_kind)
    ORACLE_SQL[_name] = f"SELECT n_nationkey::BIGINT AS file_id, 1::INT AS page, n_name{_tail} AS text FROM nation"
# Names that follow the rules of the public glyph list: Cyrillic by number, small capitals, old-style and lowered figures, accents.
ORACLE_SQL["glyph_rules"] = "SELECT n_nationkey::BIGINT AS file_id, 1::INT AS page, chr((1078 + n_nationkey)::INT) || chr((63329 + n_nationkey)::INT) || chr((63280 + n_nationkey % 10)::INT) || chr((8320 + n_nationkey % 10)::INT) || chr(536) || chr(944) AS text FROM nation"


@query("SELECT doc_id, text FROM documents")
def documents_roundtrip(spark, sf):
    """Every document written, a line of text for each of its lines, and read back."""
    made = S.files(_table(spark, sf, "documents").select("doc_id", "text"), lambda r: S.pdf(b"\n".join(S.shown(x, y=20000 - 14 * i) for i, x in enumerate((r["text"] or "").split("\n")))), "doc_id")
    return D.page_text(made, "raw").select(F.col("file_id").alias("doc_id"), "text")


# --- documents, pages, objects ---------------------------------------------------------------------------------------------------

def _sized(kind: str):
    def make(r: dict) -> bytes:
        n, k = r["p_size"], r["p_partkey"]
        if kind == "inherit":
            return S.pdf(b"", tree={"MediaBox": [0, 0, 100 + n, 200 + n], "Rotate": 90 * (k % 4)})
        if kind == "crop":
            return S.pdf(b"", media_box=[0, 0, 100, 100], page={"CropBox": [-10, n, 200, 90]})
        return S.pdf(b"", media_box=[n, 10, 10 + 2 * n, 200 + n], page={"Rotate": (k % 9 - 4) * 90})

    return lambda spark, sf: S.files(_table(spark, sf, "part").select("p_partkey", "p_size"), make, "p_partkey")


_PAGES = """SELECT p_partkey::BIGINT AS file_id, 1::INT AS page, abs(10 + p_size)::DOUBLE AS width, (190 + p_size)::DOUBLE AS height,
 (((p_partkey % 9 - 4) % 4 + 4) % 4 * 90)::INT AS rotate FROM part"""


@query(_PAGES)
def pages(spark, sf):
    return D.pages(_sized("plain")(spark, sf)).select("file_id", "page", "width", "height", "rotate")


@query("SELECT p_partkey::BIGINT AS file_id, (((p_partkey % 9 - 4) % 4 + 4) % 4 * 90)::INT AS rotate FROM part")
def rotate_normalise(spark, sf):
    return D.pages(_sized("plain")(spark, sf)).select("file_id", "rotate")


@query("SELECT p_partkey::BIGINT AS file_id, (100 + p_size)::DOUBLE AS width, (200 + p_size)::DOUBLE AS height, (p_partkey % 4 * 90)::INT AS rotate FROM part")
def pages_inherit(spark, sf):
    return D.pages(_sized("inherit")(spark, sf)).select("file_id", "width", "height", "rotate")


@query("SELECT p_partkey::BIGINT AS file_id, 100.0::DOUBLE AS width, (90 - least(p_size, 90))::DOUBLE AS height FROM part")
def crop_clip(spark, sf):
    return D.pages(_sized("crop")(spark, sf)).select("file_id", "width", "height")


@query("""SELECT p_partkey::BIGINT AS file_id, 1::INT AS page, 10.0::DOUBLE AS top, greatest(p_size, 10 + 2 * p_size)::DOUBLE AS "right", (200 + p_size)::DOUBLE AS bottom,
 least(p_size, 10 + 2 * p_size)::DOUBLE AS "left", (10 + p_size)::DOUBLE AS width, (190 + p_size)::DOUBLE AS height FROM part""")
def pagesize(spark, sf):
    return D.pagesize(_sized("plain")(spark, sf))


def _deep_tree(r: dict) -> bytes:
    """Three pages below two levels of the tree: one inherits all, one has a box of its own and a crop box by reference, one stands above the others' node."""
    n, k = r["p_size"], r["p_partkey"]
    b = Builder("1.4", S.LETTER)
    top, low, *leaves = (b.reserve() for _ in range(5))
    crop = b.add([n, 1, 0, b.add(2 * n)])
    page = {"Type": Name("Page"), "Contents": b.stream(b"")}
    b.put(leaves[0], page | {"Parent": low})
    b.put(leaves[1], page | {"Parent": low, "MediaBox": [5, 5, 5 + n, 6 + n], "CropBox": crop})
    b.put(leaves[2], page | {"Parent": top, "Rotate": None})
    b.put(low, {"Type": Name("Pages"), "Parent": top, "Kids": leaves[:2], "Count": 2, "Rotate": 90 * (k % 4)})
    b.put(top, {"Type": Name("Pages"), "Kids": b.add([leaves[2], low, low]), "Count": 3, "MediaBox": [0, 0, 100 + n, 200 + n]})
    b.catalog["Pages"] = top
    return b.save()


@query("""SELECT p_partkey::BIGINT AS file_id, unnest([1, 2, 3])::INT AS page, unnest([100 + p_size, 100 + p_size, p_size])::DOUBLE AS width, unnest([200 + p_size, 200 + p_size, 1 + p_size])::DOUBLE AS height,
 unnest([NULL, NULL, greatest(1, 2 * p_size)])::DOUBLE AS crop_top, unnest([0, 90 * (p_partkey % 4), 90 * (p_partkey % 4)])::DOUBLE AS rotate, 1::INT AS streams FROM part""")
def graph_pages(spark, sf):
    """The pages of every part's file from the objects table alone: the tree level by level, attributes by a recursive query."""
    files = S.files(_table(spark, sf, "part").select("p_partkey", "p_size"), _deep_tree, "p_partkey")
    box = F.col("media_box")
    return G.raw_pages(D.objects(files)).select("file_id", "page", (box[2] - box[0]).alias("width"), (box[3] - box[1]).alias("height"), F.get("crop_raw", F.lit(3)).alias("crop_top"), F.col("rotate_raw").alias("rotate"), "streams")


def _name_tree(r: dict) -> bytes:
    """A name tree with inner nodes, pairs above them, an odd last key, names by UF and by key alone, and a node that leads back to the top."""
    def more(b: Builder, res: dict) -> None:
        top, left, right = b.reserve(), b.reserve(), b.reserve()
        data = b.add(Stream({"Subtype": Name("text/plain")}, r["c_name"].encode()))
        spec = b.add({"Type": Name("Filespec"), "F": "old", "UF": r["c_name"], "Desc": r["c_mktsegment"], "EF": {"F": data}})
        b.put(left, {"Names": ["k1", spec, "odd"], "Kids": [top]})
        b.put(right, {"Names": b.add([f"key {r['c_custkey']}", {"EF": {"UF": data}}])})
        b.put(top, {"Names": ["k0", {"F": "first"}], "Kids": [left, right, left]})
        b.catalog["Names"] = b.add({"EmbeddedFiles": top})

    return S.pdf(b"", more=more)


@query("""SELECT c_custkey::BIGINT AS file_id, unnest([1, 2, 3])::INT AS ord, unnest(['first', c_name, 'key ' || c_custkey]) AS name, unnest([NULL, c_mktsegment, NULL]) AS description,
 unnest([NULL, 'text/plain', 'text/plain']) AS mime, unnest([NULL, c_name, c_name]) AS data FROM customer""")
def graph_attachments(spark, sf):
    """Embedded files of every customer's file, by a walk over the objects table."""
    c = _table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files = S.files(c, _name_tree, "c_custkey")
    return G.attachments(D.objects(files), D.streams(files)).select("file_id", "ord", "name", "description", "mime", F.decode("data", "UTF-8").alias("data"))


def _many(spark, sf):
    return S.files(_table(spark, sf, "nation"), lambda r: S.pdf(*[S.shown(r["n_name"])] * (1 + r["n_nationkey"] % 4)), "n_nationkey")


@query("SELECT n_nationkey::BIGINT AS file_id, (1 + n_nationkey % 4)::BIGINT AS length FROM nation")
def page_count(spark, sf):
    return D.length(_many(spark, sf))


@query("""SELECT file_id, number::BIGINT AS number, coalesce(type, '') AS type, coalesce(length, -1)::BIGINT AS length FROM (
 SELECT n_nationkey::BIGINT AS file_id, unnest([-1, 0, 1, 2, 3, 4, 5, 6]) AS number, unnest(['Info', 'Catalog', 'Catalog', 'Pages', 'Font', NULL, 'Page', NULL]) AS type,
        unnest([NULL, NULL, NULL, NULL, NULL, 31 + length(n_name), NULL, NULL]) AS length FROM nation)""")
def objects(spark, sf):
    f = S.files(_table(spark, sf, "nation"), lambda r: S.pdf(S.shown(r["n_name"]), info={"Title": r["n_name"]}), "n_nationkey")
    return D.objects(f).select("file_id", "number", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("length", F.lit(-1)).cast("long").alias("length"))


@query("SELECT n_nationkey::BIGINT AS file_id, n_name AS title, n_regionkey::INT AS key, 'Courier' AS font FROM nation")
def object_value(spark, sf):
    f = S.files(_table(spark, sf, "nation"), lambda r: S.pdf(b"", info={"Title": r["n_name"], "Key": r["n_regionkey"]}), "n_nationkey")
    o = D.objects(f)
    info, font = o.where("number = -1"), o.where("type = 'Font'").select("file_id", F.expr("variant_get(value, '$.dict.BaseFont.name', 'string')").alias("font"))
    return info.select("file_id", F.expr("variant_get(value, '$.dict.Title', 'string')").alias("title"), F.expr("variant_get(value, '$.dict.Key', 'int')").alias("key")).join(font, "file_id")


@query("SELECT n_nationkey::BIGINT AS file_id, count(*)::BIGINT AS n FROM (SELECT n_nationkey, unnest(range(5)) FROM nation) GROUP BY 1")
def object_refs(spark, sf):
    return D.refs(D.objects(_nations(spark, sf))).groupBy("file_id").agg(F.count("*").alias("n"))


def _stream(flate: bool):
    def run(spark, sf):
        f = S.files(_table(spark, sf, "nation"), lambda r: S.pdf(S.shown(r["n_name"]), flate=flate), "n_nationkey")
        return D.streams(f).select("file_id", F.decode("data", "UTF-8").alias("text"), "decoded", F.array_join("filter", ",").alias("filter"))

    return run


for _name, _flate in (("stream_decoded", True), ("stream_stored", False)):
    QUERIES[_name] = _stream(_flate)
    ORACLE_SQL[_name] = f"SELECT n_nationkey::BIGINT AS file_id, 'BT /F1 12 Tf 72 720 Td (' || n_name || ') Tj ET' AS text, true AS decoded, '{'FlateDecode' if _flate else ''}' AS filter FROM nation"


def _described(spark, sf):
    o = _table(spark, sf, "orders").select("o_orderkey", F.unix_timestamp("o_orderdate").alias("t"), "o_orderpriority")
    return S.files(o, lambda r: S.pdf(b"", info={"Title": f"order {r['o_orderkey']}", "Subject": r["o_orderpriority"], "CreationDate": date_string(r["t"])}), "o_orderkey")


@query("SELECT o_orderkey::BIGINT AS file_id, 'order ' || o_orderkey AS title, o_orderpriority AS subject, date_trunc('second', o_orderdate)::TIMESTAMP AS created, '1.4' AS version, 'none' AS encryption, 8::INT AS n_permissions FROM orders")
def meta(spark, sf):
    return D.meta(_described(spark, sf)).select("file_id", "title", "subject", F.col("created").cast("timestamp_ntz").alias("created"), "version", "encryption", F.size("permissions").alias("n_permissions"))


@query("SELECT n_nationkey::BIGINT AS file_id, 1::BIGINT AS pages, false AS encrypted, false AS linearized, n_name AS author, 'no_layout' AS layout, false AS attachments FROM nation")
def info(spark, sf):
    f = S.files(_table(spark, sf, "nation"), lambda r: S.pdf(b"", info={"Author": r["n_name"]}), "n_nationkey")
    return D.info(f).select("file_id", "pages", "encrypted", "linearized", F.col("keys")["Author"].alias("author"), "layout", "attachments")


@query("SELECT o_orderkey::BIGINT AS file_id, unnest(['Subject', 'Title']) AS key, unnest([o_orderpriority, 'order ' || o_orderkey]) AS value FROM orders")
def info_keys(spark, sf):
    return D.info(_described(spark, sf)).select("file_id", F.explode("keys").alias("key", "value"))


_BITS = {"print": 0, "modify": 1, "copy": 2, "annotate": 3, "forms": 4, "reading": 5, "assemble": 6, "print_high": 7}


def _locked(method: str):
    def make(r: dict) -> bytes:
        b = Builder("1.6", S.LETTER)
        k = r["n_nationkey"] * 7 % 256
        b.encrypt("", "owner", method, [n for n, i in _BITS.items() if k >> i & 1])
        f = b.core_font("Courier")
        b.page(S.shown(r["n_name"]), {"Font": {"F1": f}})
        return b.save()

    return lambda spark, sf: S.files(_table(spark, sf, "nation"), make, "n_nationkey")


@query("SELECT n_nationkey::BIGINT AS file_id, name FROM nation, (SELECT unnest(['print','modify','copy','annotate','forms','reading','assemble','print_high']) AS name, unnest(range(8)) AS i) WHERE (n_nationkey * 7 % 256) >> i::INT & 1 = 1")
def permissions(spark, sf):
    return D.meta(_locked("aes128")(spark, sf)).select("file_id", F.explode("permissions").alias("name"))


for _name, _method, _says in (("encrypted_text", "aes128", "aes-128"), ("encrypted_text_rc4", "rc4128", "rc4-128")):
    def _run(spark, sf, method=_method):
        f = _locked(method)(spark, sf)
        return D.page_text(f).select("file_id", "text").join(D.meta(f).select("file_id", "encryption"), "file_id")

    QUERIES[_name] = _run
    ORACLE_SQL[_name] = f"SELECT n_nationkey::BIGINT AS file_id, n_name AS text, '{_says}' AS encryption FROM nation"


#: A name, subtype, descriptor's key and the file's subtype for each kind of font, and what it is called.
_FONTS = [("T1", "Type1", "", "", "type1"), ("T1File", "Type1", "FontFile", "", "type1"), ("T1C", "Type1", "FontFile3", "Type1C", "type1c"), ("T1OT", "Type1", "FontFile3", "OpenType", "type1c_ot"), ("MM", "MMType1", "", "", "type1"), ("TT", "TrueType", "", "", "truetype"), ("TTFile2", "TrueType", "FontFile2", "", "truetype"), ("TTOT", "TrueType", "FontFile3", "OpenType", "truetype_ot"), ("Odd", "Foo", "", "", "unknown"), ("CID2", "CIDFontType2", "", "", "cid_truetype"), ("CID0", "CIDFontType0", "", "", "cid_type0"), ("CID0File2", "CIDFontType0", "FontFile2", "", "cid_truetype"), ("CID0C", "CIDFontType0", "FontFile3", "CIDFontType0C", "cid_type0c"), ("CID2OT", "CIDFontType2", "FontFile3", "OpenType", "cid_truetype_ot")]
_FONT_ROWS = ", ".join(f"('{n}', '{'Type0' if s.startswith('CID') else s}', {str(bool(k)).lower()}, '{t}')" for n, s, k, _, t in _FONTS)


def _fonts(spark, sf):
    def make(r: dict) -> bytes:
        def more(b: Builder, res: dict) -> None:
            for name, sub, key, inner, _ in _FONTS:
                extra = {}
                if key:
                    data = b.add(Stream({"Subtype": Name(inner)} if inner else {}, b"\0\1\2\3"))
                    extra = {"FontDescriptor": b.add({"Type": Name("FontDescriptor"), "FontName": Name("X"), key: data})}
                ref = b.add({"Type": Name("Font"), "Subtype": Name(sub), "BaseFont": Name(name)} | extra)
                res["Font"][name] = b.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name(name), "Encoding": Name("Identity-H"), "DescendantFonts": [ref]}) if sub.startswith("CID") else ref

        return S.pdf(b"", more=more)

    return S.files(_table(spark, sf, "region"), make, "r_regionkey")


@query(f"SELECT r_regionkey::BIGINT AS file_id, name, type, embedded FROM region, (VALUES {_FONT_ROWS}) t(name, type, embedded, fine)")
def font_table(spark, sf):
    return D.font_table(_fonts(spark, sf)).where("name <> 'Courier'").select("file_id", "name", "type", "embedded")


@query(f"SELECT r_regionkey::BIGINT AS file_id, name, fine AS type, CASE WHEN embedded THEN '' END AS file FROM region, (VALUES {_FONT_ROWS}) t(name, type, embedded, fine)")
def fonts_poppler(spark, sf):
    return D.fonts(_fonts(spark, sf)).where("name <> 'Courier'").select("file_id", "name", "type", "file")


def _pictures(spark, sf):
    return S.files(_table(spark, sf, "part").select("p_partkey", "p_size"), lambda r: S.pdf(b"/Im1 Do", more=lambda b, res: S.image(b, res, bytes([r["p_size"]]) * r["p_size"], r["p_size"], 1)), "p_partkey")


@query("SELECT p_partkey::BIGINT AS file_id, 1::INT AS page, 'Im1' AS name, p_size::INT AS width, 1::INT AS height, 8::INT AS bits, 'DeviceGray' AS color_space FROM part")
def page_images(spark, sf):
    return D.page_images(_pictures(spark, sf)).select("file_id", "page", "name", "width", "height", "bits", "color_space")


@query("SELECT p_partkey::BIGINT AS file_id, repeat(format('{:02x}', p_size), p_size) AS data FROM part")
def image_raw(spark, sf):
    return D.images(_pictures(spark, sf)).select("file_id", F.lower(F.hex("data")).alias("data"))


@query("SELECT p_partkey::BIGINT AS file_id, (4278190080 + p_size * 65793 - 4294967296)::INT AS pixel, p_size::INT AS n FROM part")
def image_native(spark, sf):
    return D.images(_pictures(spark, sf), native=True).select("file_id", F.get("pixels", F.lit(0)).alias("pixel"), F.size("pixels").alias("n"))


def _outlined(spark, sf):
    n, r = _table(spark, sf, "nation"), _table(spark, sf, "region")
    rows = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("kids")).select("r_regionkey", "r_name", F.col("kids.n_name").alias("names"))

    def make(x: dict) -> bytes:
        def more(b: Builder, res: dict) -> None:
            root, top = b.reserve(), b.reserve()
            kids = [b.reserve() for _ in x["names"]]
            for i, (k, name) in enumerate(zip(kids, x["names"], strict=True)):
                b.put(k, {"Title": name, "Parent": top} | ({"Next": kids[i + 1]} if i + 1 < len(kids) else {}))
            b.put(top, {"Title": x["r_name"], "Parent": root, "First": kids[0], "Last": kids[-1], "Count": len(kids)})
            b.put(root, {"Type": Name("Outlines"), "First": top, "Last": top, "Count": 1})
            data = b.add(Stream({"Subtype": Name("text/plain")}, x["r_name"].encode()))
            spec = b.add({"Type": Name("Filespec"), "F": "a.txt", "Desc": "attached", "EF": {"F": data}})
            b.catalog |= {"Outlines": root, "Names": {"EmbeddedFiles": {"Names": ["a.txt", spec]}}}

        return S.pdf(b"", more=more)

    return S.files(rows, make, "r_regionkey")


@query("""SELECT r_regionkey::BIGINT AS file_id, 1::INT AS item, 0::INT AS parent, 0::INT AS depth, r_name AS title, true AS is_open FROM region
UNION ALL SELECT n_regionkey::BIGINT, (1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT, 1, 1, n_name, false FROM nation""")
def toc(spark, sf):
    return D.toc(_outlined(spark, sf)).select("file_id", "item", F.coalesce("parent", F.lit(0)).alias("parent"), "depth", "title", "is_open")


@query("SELECT r_regionkey::BIGINT AS file_id, 'a.txt' AS name, 'text/plain' AS mime, 'attached' AS description, r_name AS data FROM region")
def attachments(spark, sf):
    return D.attachments(_outlined(spark, sf)).select("file_id", "name", "mime", "description", F.decode("data", "UTF-8").alias("data"))


@query("SELECT n_nationkey::BIGINT AS file_id, CASE WHEN n_nationkey % 4 >= 2 THEN 'limit_error' END AS class, CASE WHEN n_nationkey % 4 >= 2 THEN 'max_pages' END AS lim FROM nation")
def limits_max_pages(spark, sf):
    t = D.page_text(_many(spark, sf), limits=Limits(max_pages=2))
    return t.groupBy("file_id").agg(F.max("status.class").alias("class"), F.max("status.limit").alias("lim"))


@query("SELECT n_nationkey::BIGINT AS file_id, CASE n_nationkey % 3 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'password_error' END AS class FROM nation")
def status_classes(spark, sf):
    def make(r: dict) -> bytes:
        k = r["n_nationkey"] % 3
        if k == 1:
            b = Builder("1.6", S.LETTER)
            b.encrypt("secret", "owner")
            b.page(b"", {})
            return b.save()
        return b"no file at all" if k == 0 else S.pdf(S.shown(r["n_name"]))

    return D.page_text(S.files(_table(spark, sf, "nation"), make, "n_nationkey")).select("file_id", F.col("status.class").alias("class"))


# --- writing and assembly --------------------------------------------------------------------------------------------------------

def _drawn(spark, sf, align: float = 0.0, lines: bool = False):
    n = _table(spark, sf, "nation")
    text = F.concat_ws("\n", F.col("n_name"), F.lit("second line")) if lines else F.col("n_name")
    ops = n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.explode(W.draw_text(F.lit(1), F.lit(1), text, F.lit(300.0), F.lit(700.0), align=align)).alias("o")).select("doc_id", "o.*")
    return W.write(ops, media_box=S.LETTER)


@query(_PT)
def draw_text_roundtrip(spark, sf):
    return D.page_text(_drawn(spark, sf)).select("file_id", "page", "text")


@query("SELECT n_nationkey::BIGINT AS file_id, round(300 - length(n_name) * 3.6::DOUBLE, 6)::DOUBLE AS x0 FROM nation")
def draw_align(spark, sf):
    return D.glyphs(_drawn(spark, sf, 0.5)).where("seq = 1").select("file_id", F.round("x0", 6).alias("x0"))


#: Fonts of different widths, and one of each; SQL has the widths of letters, digits and signs from 32 to 126.
_ALIGNED = ("Helvetica", "Helvetica-Bold", "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Courier")
_ALIGNED_SQL = ", ".join(f"({i}, [{', '.join(map(str, CORE[f][0]))}])" for i, f in enumerate(_ALIGNED))


@query(f"""SELECT (c_custkey * 8 + k)::BIGINT AS file_id, round(300 - 0.01 * list_sum(list_transform(range(1, length(c_name) + 1), lambda i : w[ascii(substr(c_name, i, 1)) - 31])) * (0.5 + 0.5 * (k % 2)), 6)::DOUBLE AS x0
 FROM customer, (VALUES {_ALIGNED_SQL}) t(k, w)""")
def draw_align_fonts(spark, sf):
    """Customers' names set centred and to the right in fonts of every kind of width: where the first glyph comes to lie."""
    c = S.spread(_table(spark, sf, "customer").select("c_custkey", "c_name"))
    each = [c.select((F.col("c_custkey") * 8 + k).cast("long").alias("doc_id"), F.explode(W.draw_text(F.lit(1), F.lit(1), F.col("c_name"), F.lit(300.0), F.lit(700.0), font=f, size=10.0, align=0.5 + 0.5 * (k % 2))).alias("o")) for k, f in enumerate(_ALIGNED)]
    ops = functools.reduce(DataFrame.unionByName, each).select("doc_id", "o.*")
    return D.glyphs(W.write(ops, media_box=S.LETTER)).where("seq = 1").select("file_id", F.round("x0", 6).alias("x0"))


@query("SELECT n_nationkey::BIGINT AS file_id, n_name || chr(10) || 'second line' AS text FROM nation")
def draw_lines(spark, sf):
    return D.page_text(_drawn(spark, sf, lines=True)).select("file_id", "text")


@query("SELECT p_partkey::BIGINT AS file_id, pos::INT AS pos, value FROM (SELECT p_partkey, unnest(range(1, 7)) AS pos, unnest(['10', '20', p_size::VARCHAR, (2 * p_size)::VARCHAR, 're', 'f']) AS value FROM part)")
def draw_path_ops(spark, sf):
    p = _table(spark, sf, "part")
    ops = p.select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(W.draw(F.lit(1), F.lit(1), "rect", 10, 20, F.col("p_size"), F.col("p_size") * 2), W.draw(F.lit(1), F.lit(2), "paint", 1, 0))).alias("o")).select("doc_id", "o.*")
    return D.tokens(W.write(ops)).select("file_id", "pos", "value")


@query("SELECT op, count(*)::BIGINT AS n FROM (VALUES ('rect')) t(op), part GROUP BY op")
def draw_checks(spark, sf):
    p = _table(spark, sf, "part")
    rows = p.select(F.explode(F.array(F.struct(F.lit("rect").alias("op"), F.array(F.lit(1.0)).alias("nums")), F.struct(F.lit("line").alias("op"), F.array(F.lit(1.0), F.lit(2.0)).alias("nums")))).alias("o")).select("o.*")
    return W.check_ops(rows).groupBy("op").agg(F.count("*").alias("n"))


@query(f"SELECT file_id, unnest(CASE page WHEN 3 THEN [1] WHEN 1 THEN [2, 3] ELSE [] END)::INT AS page, text FROM {_THREE}")
def copy_pages(spark, sf):
    return D.page_text(W.copy_pages(_regions(spark, sf), [3, 1, 1])).select("file_id", "page", "text")


@query(f"SELECT file_id, (page - 1)::INT AS page, text FROM {_THREE} WHERE page > 1")
def subset(spark, sf):
    return D.page_text(W.subset(_regions(spark, sf), [-1])).select("file_id", "page", "text")


@query(f"SELECT file_id || '_' || page AS file_id, text FROM {_THREE}")
def split(spark, sf):
    return D.page_text(W.split(_regions(spark, sf))).select("file_id", "text")


@query("SELECT 0::INT AS file_id, (r_regionkey * 3 + page)::INT AS page, text FROM (SELECT file_id AS r_regionkey, page, text FROM %s)" % _THREE)
def combine(spark, sf):
    return D.page_text(W.combine(_regions(spark, sf), F.lit(0), F.col("file_id"))).select("file_id", "page", "text")


@query("SELECT c_nationkey::BIGINT AS file_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC)::INT AS page, c_name AS text FROM customer")
def native_combine(spark, sf):
    """One file a nation of its customers' files, last first: reach, numbers, offsets and cross references by joins and prefix sums."""
    c = _table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    files = S.files(c, lambda r: S.pdf(S.shown(r["c_name"])), "c_custkey").join(c.select(F.col("c_custkey").cast("long").alias("file_id"), F.col("c_nationkey").cast("long").alias("nation")), "file_id")
    return D.page_text(N.combine(files, F.col("nation"), -F.col("file_id"))).select("file_id", "page", "text")


@query(f"SELECT file_id, (4 - page)::INT AS page, text FROM {_THREE}")
def reorder(spark, sf):
    return D.page_text(W.copy_pages(_regions(spark, sf), [3, 2, 1])).select("file_id", "page", "text")


@query("SELECT r_regionkey::BIGINT AS file_id, unnest([1, 2, 3])::INT AS page, unnest([90, 270, 0])::INT AS rotate FROM region")
def rotate_pages(spark, sf):
    once = W.rotate_pages(_regions(spark, sf), [2], 180)
    return D.pages(W.rotate_pages(once, [1, 2], 90, relative=True)).select("file_id", "page", "rotate")


@query("SELECT n_nationkey::BIGINT AS file_id, n_name AS title FROM nation")
def set_meta(spark, sf):
    n = _table(spark, sf, "nation")
    ops = n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("title"), F.explode(W.draw_text(F.lit(1), F.lit(1), F.col("n_name"), F.lit(72.0), F.lit(720.0))).alias("o")).select("doc_id", "title", "o.*")
    return D.meta(W.write(ops)).select("file_id", "title")


@query("SELECT n_nationkey::BIGINT AS file_id, true AS same, 32::INT AS digits FROM nation")
def deterministic_id(spark, sf):
    a, b = _drawn(spark, sf), _drawn(spark, sf)
    return a.join(b.withColumnRenamed("content", "again"), "file_id").select("file_id", (F.col("content") == F.col("again")).alias("same"), F.length(W.deterministic_id(F.col("content"))).alias("digits"))


@query("SELECT c_mktsegment || '%2F' || c_custkey || '.pdf' AS name, c_name AS text, true AS committed FROM customer")
def sink_roundtrip(spark, sf):
    """Every customer's file written all or none under an id with a slash, read back from the folder, and held against the job's lists."""
    c = _table(spark, sf, "customer")
    files = S.files(c.select("c_custkey", "c_name"), lambda r: S.pdf(S.shown(r["c_name"])), "c_custkey")
    named = files.join(c.select(F.col("c_custkey").cast("long").alias("file_id"), "c_mktsegment"), "file_id").select(F.concat_ws("/", "c_mktsegment", F.col("file_id").cast("string")).alias("file_id"), "content")
    at = shared_folder(spark, "saved")
    W.save(named, at, job="customers")
    pdf_source.register(spark)
    read = spark.read.format("pdf").option("table", "page_text").load(at).select(F.substring_index("file_id", "/", -1).alias("name"), "text")
    return read.join(sink.committed(spark, at).select("name", (F.col("size") > 0).alias("committed")), "name", "left")


# --- drawing by columns, secrets, summaries ----------------------------------------------------------------------------------------

_PATH_TOKENS = """SELECT p_partkey::BIGINT AS file_id, k::INT AS pos, v[k] AS value FROM (
 SELECT p_partkey, v, unnest(range(1, len(v) + 1)) AS k FROM (
  SELECT p_partkey, ['q'] || CASE WHEN p_partkey % 3 <> 1 THEN ['1', '0', '0', 'rg'] ELSE [] END || CASE p_partkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['0', '0', '0', 'RG'] ELSE ['0', '0', '1', 'RG'] END
   || ['0.5', 'w', '1', '2', 'm', s, '2', 'l', '1', '1.5', '2', '2.5', s, '6', 'c', 'h', '10', '20', s, '7', 're', CASE p_partkey % 3 WHEN 0 THEN 'f*' WHEN 1 THEN 'S' ELSE 'B*' END, 'Q', 'BT', 'F1', '12', 'Tf', '1', '0', '0', '1', '72', '700', 'Tm', p_name, 'Tj', 'ET'] AS v
  FROM (SELECT p_partkey, p_name, p_size::VARCHAR AS s FROM part)))"""


def _path_ops(spark, sf):
    """Every part's name below a path of all kinds of steps, filled, stroked in black or both by turns."""
    size = F.col("p_size").cast("double")
    row = lambda op, x=None, y=None, x1=None, y1=None, x2=None, y2=None, w=None, h=None: F.struct(*[(v if isinstance(v, F.Column) else F.lit(v)).cast("string" if n == "op" else "double").alias(n) for n, v in zip(("op", "x", "y", "x1", "y1", "x2", "y2", "w", "h"), (op, x, y, x1, y1, x2, y2, w, h), strict=True)])
    path = F.array(row("move", 1, 2), row("line", size, 2), row("curve", size, 6, 1, 1.5, 2, 2.5), row("close"), row("rect", 10, 20, None, None, None, None, size, 7))
    turn = F.col("p_partkey") % 3
    drawn = P.draw_path(F.lit(1), F.lit(1), path, fill=F.when(turn != 1, F.lit("red")), stroke=F.when(turn == 2, F.lit("#0000FF")), width=0.5, rule="evenodd")
    text = W.draw_text(F.lit(1), F.lit(100), F.col("p_name"), F.lit(72.0), F.lit(700.0))
    part = S.spread(_table(spark, sf, "part").select("p_partkey", "p_name", "p_size"))
    return part.select(F.col("p_partkey").alias("doc_id"), F.explode(F.concat(drawn, text)).alias("o")).select("doc_id", "o.*")


@query(_PATH_TOKENS)
def draw_paths(spark, sf):
    """Paths and text compiled, laid out and written by columns, read back as tokens."""
    return D.tokens(P.write(_path_ops(spark, sf)).select("file_id", "content")).select("file_id", "pos", "value")


@query("SELECT p_partkey::BIGINT AS file_id, true AS same FROM part")
def draw_same_bytes(spark, sf):
    """The files by columns and those of the sequential writer, byte for byte."""
    ops = _path_ops(spark, sf)
    return P.write(ops).select("file_id", "content").join(N.long(W.write(ops).withColumnRenamed("content", "again")), "file_id").select("file_id", (F.col("content") == F.col("again")).alias("same"))


@query("SELECT p_partkey::BIGINT AS file_id, unnest([1, 1, 2])::INT AS page, unnest(['img' || p_size, 'tall', 'img' || p_size]) AS name, unnest([p_size, 1, p_size])::INT AS width, unnest([2, 3, 2])::INT AS height FROM part")
def draw_images(spark, sf):
    """Images from a table, each in a document once however often it shows it."""
    p = _table(spark, sf, "part").select("p_partkey", "p_size")
    sizes = p.select("p_size").distinct()
    make = F.udf(lambda n: S.png(n, n, 2), "binary")
    pictures = sizes.select(F.concat(F.lit("img"), F.col("p_size").cast("string")).alias("name"), make("p_size").alias("data")).unionByName(spark.createDataFrame([("tall", S.png(9, 1, 3))], "name string, data binary"))
    shown = lambda page, seq, name: F.struct(F.lit(page).alias("page"), F.lit(seq).alias("seq"), F.lit("image").alias("op"), F.array(*[F.lit(float(x)) for x in (10, 20, 30, 40, 0)]).alias("nums"), name.alias("str"))
    own = F.concat(F.lit("img"), F.col("p_size").cast("string"))
    ops = p.select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(shown(1, 1, own), shown(1, 2, F.lit("tall")), shown(2, 1, own))).alias("o")).select("doc_id", "o.*")
    return D.page_images(P.write(ops, images=pictures).select("file_id", "content")).select("file_id", "page", "name", "width", "height")


@query("""SELECT c_custkey::BIGINT AS file_id, c_name || ' ü (1)' AS title, c_mktsegment AS author, NULL::VARCHAR AS subject, epoch_ms((c_custkey * 86461 + 1) * 1000)::TIMESTAMP AS created, 1::INT AS page, (100 + c_nationkey)::DOUBLE AS width, (c_custkey % 4 * 90)::INT AS rotate FROM customer""")
def written_meta(spark, sf):
    """Metadata, boxes and turns of every customer's file from columns; nothing is drawn."""
    c = _table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), "c_name", "c_mktsegment", "c_nationkey")
    meta = c.select("doc_id", F.concat("c_name", F.lit(" ü (1)")).alias("title"), F.col("c_mktsegment").alias("author"), F.lit(None).cast("string").alias("subject"), (F.col("doc_id") * 86461 + 1).alias("created"))
    pages = c.select("doc_id", F.lit(1).alias("page"), F.array(F.lit(0), F.lit(0), F.col("c_nationkey") + 100, F.lit(50)).cast("array<double>").alias("media_box"), (F.col("doc_id") % 4 * 90).cast("int").alias("rotate"))
    none = spark.createDataFrame([], "doc_id long, page int, seq int, op string, nums array<double>, str string")
    made = P.write(none, pages=pages, meta=meta).select("file_id", "content")
    said = D.meta(made).select("file_id", "title", "author", "subject", F.col("created").cast("timestamp_ntz").alias("created"))
    return said.join(D.pages(made).select("file_id", "page", "width", "rotate"), "file_id")


@query("""SELECT s_suppkey::BIGINT AS file_id, CASE WHEN s_suppkey % 3 < 2 THEN s_name END AS text, CASE WHEN s_suppkey % 3 = 2 THEN 'password_error' END AS class FROM supplier""")
def mixed_passwords(spark, sf):
    """Every supplier's file locked under passwords of its own; candidates come from a table: the right one, a wrong one first, or only a wrong one."""
    s = _table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("file_id"), "s_name")
    plain = S.files(_table(spark, sf, "supplier").select("s_suppkey", "s_name"), lambda r: S.pdf(S.shown(r["s_name"])), "s_suppkey")
    locks = s.select("file_id", F.concat(F.lit("user"), F.col("file_id").cast("string")).alias("user"), F.lit("owner").alias("owner"), F.when(F.col("file_id") % 2 == 0, F.lit("rc4128")).alias("method"))
    turn = F.col("file_id") % 3
    tries = F.when(turn == 0, F.array(F.col("user"))).when(turn == 1, F.array(F.lit("wrong"), F.col("user"))).otherwise(F.array(F.lit("wrong")))
    keys = locks.select("file_id", F.posexplode(tries).alias("ord", "password"))
    locked = W.encrypt(plain, locks).select("file_id", "content")
    return D.page_text(D.with_secrets(locked, keys)).select("file_id", "text", F.col("status.class").alias("class"))


@query("""SELECT c_custkey::BIGINT AS file_id, CASE c_custkey % 3 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS n, CASE c_custkey % 3 WHEN 0 THEN 'parse_error' ELSE 'limit_error' END AS class,
 CASE c_custkey % 3 WHEN 0 THEN '' ELSE '1,3' END AS pages FROM customer WHERE c_custkey % 3 < 2""")
def failure_summary(spark, sf):
    """One row for each of the customers' files that can't be read, or in which two of three pages are too long; the others have none."""
    def make(r: dict) -> bytes:
        k = r["c_custkey"] % 3
        long_ = b" " * 4000 if k == 1 else b""
        return b"broken" if k == 0 else S.pdf(S.shown("a") + long_, S.shown(r["c_name"]), S.shown("b") + long_)

    files = S.files(_table(spark, sf, "customer").select("c_custkey", "c_name"), make, "c_custkey")
    return D.failures(D.page_text(files, limits=Limits(max_stream=2000)), "page").select("file_id", "n", "class", F.concat_ws(",", F.col("items").cast("array<string>")).alias("pages"))


@query("""WITH n AS (SELECT c_custkey, '/in/' || c_name || CASE c_custkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' WHEN 2 THEN '_output.pdf' ELSE '' END AS path, CASE WHEN c_custkey % 4 = 2 THEN '/in/' || c_name || '.pdf' END AS other FROM customer)
SELECT c_custkey::BIGINT AS file_id, unnest([b || '_output.pdf', b || '_combined.pdf', b || '_7.pdf']) AS output, unnest([CASE WHEN other IS NOT NULL THEN 'output must not overwrite an input' END, NULL, NULL]) AS clash
FROM (SELECT c_custkey, other, regexp_replace(coalesce(other, path), '\\.pdf$', '', 'i') AS b FROM n)""")
def output_names(spark, sf):
    """Names of the customers' outputs; for every fourth the default would overwrite another input."""
    c = _table(spark, sf, "customer")
    turn, base = F.col("c_custkey") % 4, F.concat(F.lit("/in/"), F.col("c_name"))
    inputs = c.select(F.col("c_custkey").cast("long").alias("file_id"), F.concat(base, F.when(turn == 0, ".PDF").when(turn == 1, ".pdf").when(turn == 2, "_output.pdf").otherwise("")).alias("path"), F.when(turn == 2, F.concat(base, F.lit(".pdf"))).alias("other"))
    of = F.coalesce("other", "path")
    outputs = inputs.select("file_id", F.explode(F.array(scalars.output_name(of, "subset"), scalars.output_name(of, "combine"), scalars.output_name(of, "split", F.lit(7)))).alias("output"))
    return scalars.safe_outputs(outputs, inputs)


@query("""SELECT c_custkey::BIGINT AS file_id, unnest(['page', 'info']) AS what,
 unnest(['{Contents 4 0 R, MediaBox [0, 0, 612, 792], Parent 2 0 R, Resources {Font {F1 3 0 R}}, Type /Page}', '{Author "' || c_mktsegment || '", Id <0a' || printf('%02x', (c_custkey % 256)::INT) || '>, Title "' || c_name || '"}']) AS value FROM customer""")
def formatted_values(spark, sf):
    """Names, references and binary strings of every customer's file as text."""
    c = _table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files = S.files(c, lambda r: S.pdf(b"", info={"Title": r["c_name"], "Author": r["c_mktsegment"], "Id": Hex(bytes([10, r["c_custkey"] % 256]))}), "c_custkey")
    o = D.objects(files).where("type = 'Page' or number = -1")
    return o.select("file_id", F.when(F.col("number") == -1, F.lit("info")).otherwise(F.lit("page")).alias("what"), formatted(F.col("value")).alias("value"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {w}::DOUBLE, {h}::DOUBLE)" for n, w, h in (("a0", 2383.94, 3370.39), ("a4", 595.28, 841.89), ("a5", 419.53, 595.28), ("b5", 498.9, 708.66), ("letter", 612, 792))) + ") t(name, width, height)")
def paper_sizes(spark, sf):
    return scalars.paper(spark).where(F.col("name").isin("a0", "a4", "a5", "b5", "letter"))
