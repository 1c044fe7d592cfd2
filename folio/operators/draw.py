"""Drawing by columns: paths, colours and text to operations, operations to content streams, and content streams to files, all as expressions, ordered aggregates and joins.

    ops = draw_path(F.col("page"), F.lit(1), F.col("path"), fill=F.lit("gold"), stroke=F.lit("black"), rule="evenodd")     # an array of operations
    write(rows.select("doc_id", F.explode(F.concat(ops, draw_text(...))).alias("o")).select("doc_id", "o.*"))

What is wrong with a path or an operation is an operation ``fault`` or a row's status: its document has no content and a status; other documents don't notice. Pages go by their numbers, without gaps for numbers left out;
operations by seq, equal ones by their text. Bytes equal those of the sequential writer.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidArgument
from ..functions.scalars import rgb
from ..kernel.embed import image
from ..kernel.fonts import CORE, WIN
from ..kernel.serialize import A4, ARITY, serialize
from ..kernel.values import Name
from .graph import Tables, failed, fine
from .native import FEW, FEW_BYTES, _bytes, _number, joined, laid_out, long, without
from .scan import FAILURES

#: A path's rows: what each operation uses of them is checked.
PATH = "array<struct<op:string,x:double,y:double,x1:double,y1:double,x2:double,y2:double,w:double,h:double>>"
#: Numbers of a path's operations, in order (fixed values).
_USES = {"move": ("x", "y"), "line": ("x", "y"), "curve": ("x1", "y1", "x2", "y2", "x", "y"), "close": (), "rect": ("x", "y", "w", "h")}


def _operation(page: Column, seq: Column, op: Column | str, nums: Column, text: Column | None = None) -> Column:
    return F.struct(page.cast("int").alias("page"), seq.cast("int").alias("seq"), (F.lit(op) if isinstance(op, str) else op).alias("op"), nums.cast("array<double>").alias("nums"), (F.lit(None) if text is None else text).cast("string").alias("str"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def path_fault(path: Column) -> Column:
    """What is wrong with a path, or null."""
    rows = path.cast(PATH)
    of = lambda r, names: [r[n] for n in names]
    wrong = lambda r: F.coalesce(*[F.when((r["op"] == op) & ~_all(of(r, names)), F.lit(f"{op} needs finite {', '.join(names)}")) for op, names in _USES.items() if names], F.lit(None).cast("string"))
    strange = F.exists(rows, lambda r: r["op"].isNull() | ~r["op"].isin(*_USES))
    return (F.when(path.isNull() | (F.size(rows) == 0), F.lit("a path needs operations"))
            .when(strange, F.lit("a path's op is move, line, curve, close or rect"))
            .when(~rows[0]["op"].isin("move", "rect"), F.lit("a path starts with move or rect"))
            .otherwise(F.get(F.filter(F.transform(rows, wrong), lambda x: x.isNotNull()), F.lit(0))))


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & _finite(c)
    return out


def draw_path(page: Column, seq: Column, path: Column, *, fill: Column | None = None, stroke: Column | None = None, width: Column | float = 1.0, rule: str = "winding") -> Column:
    """An array of operations that draw a path of rows (op, x, y, x1, y1, x2, y2, w, h): filled, stroked or both; with neither, stroked in black. Colours are names, #RRGGBB, or null for none. Takes seq to seq + rows + 5."""
    if rule not in ("winding", "evenodd"):
        raise InvalidArgument("rule must be winding or evenodd", arg="rule")
    no = F.lit(None).cast("string")
    fill, stroke = no if fill is None else fill, no if stroke is None else stroke
    width = width if isinstance(width, Column) else F.lit(float(width))
    f = rgb(fill)
    s = F.when(fill.isNull() & stroke.isNull(), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(rgb(stroke))
    unknown = lambda name, given, found: F.when(given.isNotNull() & found.isNull() & ~F.lower(given).isin("transparent", "na"), F.concat(F.lit(f"{name}: no colour "), given))
    fault = F.coalesce(path_fault(path), unknown("fill", fill, f), unknown("stroke", stroke, s), F.when(~F.coalesce(_finite(width) & (width >= 0), F.lit(False)), F.lit("width must be 0 or more")))
    rows, n = path.cast(PATH), F.size(path)
    empty = F.array().cast("array<double>")
    numbers = lambda r: _cases([(r["op"] == op, F.array(*[r[x] for x in names]) if names else empty) for op, names in _USES.items()])
    steps = F.transform(rows, lambda r, i: _operation(page, seq + i + 4, r["op"], numbers(r)))
    one = lambda at, op, nums, when=None: F.array(_operation(page, seq + at, op, nums)) if when is None else F.when(when, F.array(_operation(page, seq + at, op, nums))).otherwise(F.array().cast("array<struct<page:int,seq:int,op:string,nums:array<double>,str:string>>"))
    mode = F.array(F.when(f.isNull(), 0.0).otherwise(2.0 if rule == "evenodd" else 1.0), F.when(s.isNull(), 0.0).otherwise(1.0))
    drawn = F.concat(one(0, "save", empty), one(1, "fill_rgb", f, f.isNotNull()), one(2, "stroke_rgb", s, s.isNotNull()), one(3, "line_width", F.array(width)), steps, one(n + 4, "paint", mode), one(n + 5, "restore", empty))
    return F.when(fault.isNotNull(), F.array(_operation(page, seq, "fault", empty, fault))).otherwise(drawn)


def _cases(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.when(*pairs[0])
    for when, then in pairs[1:]:
        out = out.when(when, then)
    return out


def points(xs: Column, ys: Column, close: bool = False) -> Column:
    """A path of points joined by straight lines; null (a fault when drawn) if there are fewer than two or not as many y as x."""
    nothing = {n: F.lit(None).cast("double").alias(n) for n in ("x1", "y1", "x2", "y2", "w", "h")}
    row = lambda op, x, y: F.struct(op.alias("op"), x.cast("double").alias("x"), y.cast("double").alias("y"), *nothing.values())
    lines = F.transform(xs, lambda x, i: row(F.when(i == 0, F.lit("move")).otherwise(F.lit("line")), x, F.get(ys, i)))
    end = F.array(row(F.lit("close"), F.lit(None), F.lit(None))) if close else F.array().cast(PATH)
    return F.when((F.size(xs) == F.size(ys)) & (F.size(xs) >= 2), F.concat(lines, end))


# --- operations to content -------------------------------------------------------------------------------------------------------

def real(v: Column) -> Column:
    """A number with at most six decimals and no exponent."""
    text = F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    return F.when(text.isin("", "-0", "-"), F.lit("0")).otherwise(text)


#: Code page 1252's characters outside Latin-1, and their bytes as characters.
_HIGH = [(chr(WIN[b]), chr(b)) for b in range(0x80, 0xA0) if WIN[b] and WIN[b] > 0xFF]


def literal(text: Column) -> Column:
    """A string in code page 1252 (others as ?), each byte as one character, written as a literal; one that begins like UTF-16 is written in hexadecimal."""
    held = F.translate(F.regexp_replace(text, "[\u0080-\u009f]", "?"), "".join(a for a, _ in _HIGH), "".join(b for _, b in _HIGH))
    held = F.regexp_replace(held, "[^\\u0000-\\u00ff]", "?")
    escaped = F.replace(F.replace(F.regexp_replace(held, r"([()\\])", r"\\$1"), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.when(held.startswith("þÿ"), F.concat(F.lit("<"), F.hex(F.encode(held, "ISO-8859-1")), F.lit(">"))).otherwise(F.concat(F.lit("("), escaped, F.lit(")")))


def _fault(op: Column, nums: Column, text: Column) -> Column:
    """What is wrong with an operation, or null."""
    arity = F.create_map(*[F.lit(x) for kv in ARITY.items() for x in kv])
    takes = F.try_element_at(arity, op)
    return (F.when(op == "fault", text).when(op.isNull() | takes.isNull(), F.concat(F.lit("no operation "), F.coalesce(op, F.lit("null"))))
            .when(nums.isNull() | (F.size(nums) != takes), F.concat(op, F.lit(" takes "), takes.cast("string"), F.lit(" numbers")))
            .when(F.exists(nums, lambda x: ~_finite(x)), F.concat(op, F.lit(" needs finite numbers")))
            .when((op == "paint") & ~(nums[0].isin(0, 1, 2) & nums[1].isin(0, 1)), F.lit("paint takes a fill of 0, 1 or 2 and a stroke of 0 or 1"))
            .when((op == "text") & ~F.coalesce(F.substring_index(text, "\t", 1).isin(*CORE), F.lit(False)), F.concat(F.lit("no core font "), F.coalesce(F.substring_index(text, "\t", 1), F.lit("null"))))
            .when((op == "image") & ~F.coalesce(text.rlike("^[A-Za-z0-9_.-]+$"), F.lit(False)), F.lit("an image needs a name of letters, digits, _, . and -")))


_PLAIN = {"save": "q", "restore": "Q", "fill_rgb": "rg", "stroke_rgb": "RG", "line_width": "w", "move": "m", "line": "l", "curve": "c", "close": "h", "rect": "re"}


def content_of(op: Column, nums: Column, text: Column, fonts: Column) -> Column:
    """An operation's text; fonts: the page's fonts, which are F1, F2 and so on in their order."""
    n = F.transform(nums, real)
    at = lambda i: F.get(n, F.lit(i))
    font = F.concat(F.lit("F"), F.array_position(fonts, F.substring_index(text, "\t", 1)).cast("string"))
    # All after the first tab, which belongs to the text itself.
    said = F.substring(text, F.instr(text, "\t") + 1, F.lit(1 << 30))
    paint = F.create_map(*[F.lit(x) for kv in {"00": "n", "10": "f", "20": "f*", "01": "S", "11": "B", "21": "B*"}.items() for x in kv])
    cases = [(op == o, F.array_join(F.array_append(n, F.lit(c)), " ")) for o, c in _PLAIN.items()]
    cases.append((op == "paint", F.try_element_at(paint, F.concat(at(0), at(1)))))
    cases.append((op == "text", F.concat(F.lit("BT /"), font, F.lit(" "), at(2), F.lit(" Tf "), at(3), F.lit(" "), at(4), F.lit(" "), real(-F.get(nums, F.lit(4))), F.lit(" "), at(3), F.lit(" "), at(0), F.lit(" "), at(1), F.lit(" Tm "), literal(said), F.lit(" Tj ET"))))
    cases.append((op == "image", F.concat(F.lit("q "), at(2), F.lit(" 0 0 "), at(3), F.lit(" "), at(0), F.lit(" "), at(1), F.lit(" cm /"), text, F.lit(" Do Q"))))
    return _cases(cases)


def contents(ops: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """((doc, page, content, fonts, images) of every page that has operations, content with a byte a character; (doc, page, seq, message) of what is wrong, the first of each page)."""
    drawn = _drawn(ops, doc_id)
    return drawn.where("n > 0").drop("n", "why"), drawn.where("why is not null").select("doc", "why.*")


def _drawn(ops: DataFrame, doc_id: str) -> DataFrame:
    """(doc, page, content, fonts, images, n, why) of every page: n operations that can be drawn, and the first that can't be as (page, seq, message). Operations are made and dealt out once."""
    given = ops.select(F.col(doc_id).alias("doc"), "page", "seq", "op", "nums", "str", _fault(F.col("op"), F.col("nums"), F.col("str")).alias("message"))
    given = given.withColumn("message", F.coalesce("message", F.when(F.col("page").isNull() | F.col("seq").isNull(), F.lit("an operation needs a page and a seq"))))
    good, page = F.col("message").isNull(), Window.partitionBy("doc", "page")
    used = lambda op, what: F.array_sort(F.collect_set(F.when(good & (F.col("op") == op), what)).over(page))
    named = given.withColumns({"fonts": used("text", F.substring_index("str", "\t", 1)), "images": used("image", F.col("str"))})
    text = named.select("doc", "page", "seq", "fonts", "images", "message", F.when(good, content_of(F.col("op"), F.col("nums"), F.col("str"), F.col("fonts"))).alias("says"))
    why = F.min(F.when(~good, F.struct("page", "seq", "message")))
    return text.groupBy("doc", "page", "fonts", "images").agg(F.expr("listagg(says, '\n') WITHIN GROUP (ORDER BY seq, says)").alias("content"), F.count("says").alias("n"), why.alias("why"))


def _deflated(data: Column) -> Column:
    """What no SQL function does: a page's bytes, compressed."""
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: zlib.compress(bytes(x)))

    return F.pandas_udf(run, "binary")(data)


# --- content to files ------------------------------------------------------------------------------------------------------------

def text_string(text: Column) -> Column:
    """A text string: printable ASCII as a literal, anything else as UTF-16BE in hexadecimal with its mark."""
    plain = F.concat(F.lit("("), F.regexp_replace(text, r"([()\\])", r"\\$1"), F.lit(")"))
    return F.when(text.rlike("^[ -\\x7f]*\\z"), plain).otherwise(F.concat(F.lit("<FEFF"), F.hex(F.encode(text, "UTF-16BE")), F.lit(">")))


def date_string(seconds: Column) -> Column:
    """Seconds from 1970 as a date, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    part = lambda of, per: F.lpad((F.pmod(F.floor(seconds / per), F.lit(of))).cast("string"), 2, "0")
    return F.concat(F.lit("(D:"), F.date_format(day, "yyyyMMdd"), part(24, 3600), part(60, 60), part(60, 1), F.lit("Z)"))


#: The last second that a date with its four digits of a year can say (9999); the sequential writer stops at the end of 3000, as its model does.
LATEST = 253402300799

#: Columns of metadata and their entries, in the order of the entries' names (fixed values).
_INFO = {"author": "Author", "created": "CreationDate", "creator": "Creator", "keywords": "Keywords", "modified": "ModDate", "subject": "Subject", "title": "Title"}


def information(meta: DataFrame, doc_id: str) -> DataFrame:
    """(doc, says, message) of metadata columns title, author, subject, keywords, creator, and created, modified as seconds from 1970 to the end of 9999; a null is left out, a document without any has none."""
    there = {c: k for c, k in _INFO.items() if c in meta.columns}
    if not there:
        raise InvalidArgument(f"metadata needs some of {', '.join(_INFO)}", arg="meta")
    entry = lambda c, k: F.concat(F.lit(f"/{k} "), date_string(F.col(c).cast("long")) if c in ("created", "modified") else text_string(F.col(c)))
    body = F.concat_ws("", *[entry(c, k) for c, k in there.items()])
    times = [F.when(~F.col(c).cast("long").between(0, LATEST), F.lit(f"{c} must be a time from 1970 to the end of 9999")) for c in there if c in ("created", "modified")]
    return meta.select(F.col(doc_id).alias("doc"), F.when(body != "", F.concat(F.lit("<<"), body, F.lit(">>"))).alias("says"), F.coalesce(*times, F.lit(None).cast("string")).alias("message"))


def _image_object(data: Column) -> Column:
    """An image file's dictionary (a byte a character) and samples, once for each different image."""
    def run(data: pd.Series) -> pd.DataFrame:
        out = []
        for x in data:
            try:
                s = image(bytes(x))
                out.append((serialize(s.dict | {"Length": len(s.raw)}).decode("latin-1"), s.raw, None))
            except FAILURES as e:
                out.append((None, None, str(e) or "no image"))
        return pd.DataFrame(out, columns=["head", "data", "message"])

    return F.pandas_udf(run, "struct<head:string,data:binary,message:string>")(data)


def write(ops: DataFrame, doc_id: str = "doc_id", *, pages: DataFrame | None = None, meta: DataFrame | None = None, images: DataFrame | None = None, media_box=A4, version: str = "1.7") -> DataFrame:
    """ops (doc_id, page, seq, op, nums, str) -> (file_id, content, status).

    pages (doc_id, page, media_box, crop_box, rotate: any of them): boxes and turns of pages, also pages that nothing is drawn on. meta (doc_id, ...): see ``information``.
    images (name, data): PNG and JPEG files by the names that image operations use; each goes into a document once, and is read once however many documents show it.
    """
    rows, bad = segments(ops, doc_id, pages=pages, meta=meta, images=images, media_box=media_box, version=version)
    return joined(rows).withColumn("status", fine()).unionByName(bad.select(F.col("doc").alias("file_id"), F.lit(None).cast("binary").alias("content"), "status"))


def segments(ops: DataFrame, doc_id: str = "doc_id", *, pages: DataFrame | None = None, meta: DataFrame | None = None, images: DataFrame | None = None, media_box=A4, version: str = "1.7") -> tuple[DataFrame, DataFrame]:
    """The bytes of ``write``'s documents as rows (doc, kind, at, data) in order of (kind, at), the id still zeros; and (doc, status) of documents that have none."""
    tables = Tables(ops.sparkSession, "drawing")
    told_ = tables.put(_drawn(ops, doc_id), "contents")
    drawn = told_.where("n > 0").drop("n", "why")
    faults = told_.where("why is not null").select("doc", "why")
    told = lambda df, message: df.select("doc", F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("seq"), message.alias("message")).alias("why"))
    held = drawn.select("doc", "page", F.encode("content", "ISO-8859-1").alias("content"), "fonts", "images")
    extra = ["media_box", "crop_box", "rotate"]
    if pages is not None:
        have = {c: pages[c] for c in extra if c in pages.columns}
        kinds = {"media_box": "array<double>", "crop_box": "array<double>", "rotate": "int"}
        boxes = pages.select(F.col(doc_id).alias("_d"), F.col("page").cast("int").alias("_p"), *[(have[c] if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        held = held.join(long(boxes), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("page") == F.col("_p")), "full").withColumns({"doc": F.coalesce("doc", "_d"), "page": F.coalesce("page", "_p")}).drop("_d", "_p")
        odd = lambda c: F.col(c).isNotNull() & ((F.size(c) != 4) | F.exists(c, lambda x: ~_finite(x)))
        said = F.when(odd("media_box") | odd("crop_box"), F.lit("a box is four finite numbers")).when(F.col("rotate") % 90 != 0, F.lit("rotation goes by 90 degrees"))
        held = tables.put(held, "pages")
        faults = faults.unionByName(told(held.where(said.isNotNull()), said))
    else:
        held = held.select("*", F.lit(None).cast("array<double>").alias("media_box"), F.lit(None).cast("array<double>").alias("crop_box"), F.lit(None).cast("int").alias("rotate"))
    # Things that a document holds once: what a page is the first to use gets its number there.
    none = F.array().cast("array<string>")
    uses = held.select("doc", "page", F.posexplode(F.concat(F.transform(F.coalesce("fonts", none), lambda x: F.struct(F.lit(0).alias("kind"), x.alias("name"))), F.transform(F.coalesce("images", none), lambda x: F.struct(F.lit(1).alias("kind"), x.alias("name"))))).alias("i", "u")).select("doc", "page", "i", "u.*")
    first = tables.put(uses.groupBy("doc", "kind", "name").agg(F.min(F.struct("page", "i")).alias("at")).select("doc", "kind", "name", "at.*"), "first")
    sizes = held.select("doc", "page", (F.col("content").isNotNull().cast("int") + 1).alias("own")).join(long(first.groupBy(F.col("doc").alias("_d"), F.col("page").alias("_p")).agg(F.count(F.lit(1)).alias("new_things"))), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("page") == F.col("_p")), "left").drop("_d", "_p")
    # Numbers: pages one after the other; in a page what is new first, then its content, then the page.
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = tables.put(sizes.withColumn("things", F.coalesce("new_things", F.lit(0))).withColumn("start", F.coalesce(F.sum(F.col("own") + F.col("things")).over(before), F.lit(0)) + 3).select("doc", "page", "own", "things", "start"), "starts")
    at = starts.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), "own", "things", "start")
    same = F.col("doc").eqNullSafe(F.col("_d")) & (F.col("page") == F.col("_p"))
    things = tables.put(first.join(long(at), same).select("doc", "page", "kind", "name", (F.col("start") + F.row_number().over(Window.partitionBy("doc", "page").orderBy("i")) - 1).alias("new")), "things")
    object_ = lambda new, body: F.concat(_bytes(F.concat(new.cast("string"), F.lit(" 0 obj\n"))), body, F.lit(b"\nendobj\n"))
    core = {f: serialize({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(f)} | ({} if f in ("Symbol", "ZapfDingbats") else {"Encoding": Name("WinAnsiEncoding")})) for f in CORE}
    fonts = F.create_map(*[x for f, b in core.items() for x in (F.lit(f), F.lit(b))])
    out = things.where("kind = 0").select("doc", "page", "new", object_(F.col("new"), F.try_element_at(fonts, F.col("name"))).alias("data"))
    shown = things.where("kind = 1")
    if images is not None:
        made = images.where("data is not null").groupBy(F.col("name").alias("_n")).agg(F.min("data").alias("file")).select("_n", _image_object("file").alias("o"))
        made = tables.put(made.select("_n", "o.*"), "images")
        # Equal images take next to nothing in a file; their bytes tell whether all can be sent to all tasks.
        size = made.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("size")).first()
        shown = shown.join(F.broadcast(made) if size["n"] <= FEW and size["size"] <= FEW_BYTES else long(made), F.col("name") == F.col("_n"), "left")
        faults = faults.unionByName(told(shown.where("data is null"), F.concat(F.lit("image "), F.col("name"), F.lit(": "), F.coalesce("message", F.lit("not there")))))
        stream = F.concat(F.encode("head", "ISO-8859-1"), F.lit(b"\nstream\n"), F.col("data"), F.lit(b"\nendstream"))
        out = out.unionByName(shown.where("data is not null").select("doc", "page", "new", object_(F.col("new"), stream).alias("data")))
    else:
        faults = faults.unionByName(told(shown, F.concat(F.lit("image "), F.col("name"), F.lit(": not there"))))
    placed = held.join(long(at), same)
    packed = placed.where("content is not null").select("doc", "page", (F.col("start") + F.col("things")).alias("new"), _deflated("content").alias("z"))
    stream = F.concat(_bytes(F.concat(F.lit("<</Filter /FlateDecode/Length "), F.octet_length("z").cast("string"), F.lit(">>\nstream\n"))), F.col("z"), F.lit(b"\nendstream"))
    out = out.unionByName(packed.select("doc", "page", "new", object_(F.col("new"), stream).alias("data")))
    # A page names its fonts F1, F2 and so on; images keep their names.
    met = uses.select("doc", "page", "kind", "name", "i").join(long(things.select(F.col("doc").alias("_d"), F.col("kind").alias("_k"), F.col("name").alias("_n"), "new")), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("kind") == F.col("_k")) & (F.col("name") == F.col("_n")))
    label = F.when(F.col("kind") == 0, F.concat(F.lit("/F"), (F.col("i") + 1).cast("string"))).otherwise(F.concat(F.lit("/"), F.col("name")))
    entry = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct(label.alias("label"), _number(F.col("new")).alias("ref"))))), lambda e: F.concat(e["label"], F.lit(" "), e["ref"])), "")
    resources = met.groupBy(F.col("doc").alias("_rd"), F.col("page").alias("_rp")).agg(entry(0).alias("f"), entry(1).alias("x"))
    full = placed.select("doc", "page", "content", "media_box", "crop_box", "rotate", "start", "things", "own").join(long(resources), F.col("doc").eqNullSafe(F.col("_rd")) & (F.col("page") == F.col("_rp")), "left")
    box = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, real), " "), F.lit("]"))
    some = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"/{name} <<"), c, F.lit(">>"))).otherwise("")
    default = F.array(*[F.lit(float(x)) for x in media_box])
    new = F.col("start") + F.col("things") + F.col("own") - 1
    dictionary = F.concat(
        F.lit("<<"), F.when(F.col("content").isNotNull(), F.concat(F.lit("/Contents "), _number(new - 1))).otherwise(""), F.when(F.col("crop_box").isNotNull(), F.concat(F.lit("/CropBox "), box(F.col("crop_box")))).otherwise(""),
        F.lit("/MediaBox "), box(F.coalesce("media_box", default)), F.lit("/Parent 2 0 R/Resources <<"), some("Font", F.col("f")), some("XObject", F.col("x")), F.lit(">>"),
        F.when(F.col("rotate").isNotNull(), F.concat(F.lit("/Rotate "), F.pmod(F.col("rotate"), F.lit(360)).cast("string"))).otherwise(""), F.lit("/Type /Page>>"))
    page_rows = full.select("doc", "page", new.alias("new"), object_(new, _bytes(dictionary)).alias("data"))
    out = out.unionByName(page_rows).withColumn("ord", F.col("page").cast("long")).withColumn("part", F.col("page").cast("long"))
    kids = starts.select("doc", (F.col("start") + F.col("things") + F.col("own") - 1).alias("new")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.expr("listagg(concat(cast(new as string), ' 0 R'), ' ') WITHIN GROUP (ORDER BY new)").alias("kids"))
    info = None
    if meta is not None:
        said = tables.put(information(meta, doc_id), "information")
        faults = faults.unionByName(told(said.where("message is not null"), F.col("message")))
        ends = starts.groupBy(F.col("doc").alias("_d")).agg(F.max(F.col("start") + F.col("things") + F.col("own")).alias("new"))
        info = tables.put(said.where("says is not null and message is null").join(long(ends), F.col("doc").eqNullSafe(F.col("_d"))).select("doc", "new", "says"), "info")
        last = F.lit((1 << 63) - 1)
        out = out.unionByName(info.select("doc", F.lit(None).cast("int").alias("page"), "new", object_(F.col("new"), _bytes(F.col("says"))).alias("data"), last.alias("ord"), last.alias("part")))
    failed_ = tables.put(faults.groupBy("doc").agg(F.min("why").alias("why")).select("doc", failed("write_error", F.col("why.message")).alias("status")), "failed")
    return without(laid_out(out, starts.select("doc").distinct(), kids, tables, info, version), failed_), failed_
