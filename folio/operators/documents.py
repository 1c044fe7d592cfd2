"""Reading operators: files in, tables out. What the byte kernel needn't do is DataFrame work over its tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..errors import InvalidArgument
from ..limits import Limits
from .scan import scan


def at_most(c: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(c, lo), hi)


def objects(files: DataFrame, **options) -> DataFrame:
    """One row an object; ``value`` is a VARIANT of the tagged shape, so ``variant_get(value, '$.dict.Kids[0].ref', 'int')`` works."""
    return scan(files, "objects", **options).withColumn("value", F.parse_json("value"))


def pdf_object(files: DataFrame, n: int, **options) -> DataFrame:
    return objects(files, **options).where(F.col("number") == n)


def refs(objects_: DataFrame) -> DataFrame:
    """(file_id, src, dst): which objects each object's value refers to."""
    found = F.regexp_extract_all(F.to_json("value"), F.lit(r'\{"gen":\d+,"ref":(\d+)\}'), F.lit(1))
    each = F.transform(F.array_distinct(found), lambda x: x.cast("bigint"))
    return objects_.where("number > 0").select("file_id", F.col("number").alias("src"), F.explode(each).alias("dst"))


def streams(files: DataFrame, n: int | None = None, decode: bool = True, **options) -> DataFrame:
    return scan(files, "streams", number_=n, decode=decode, **options)


def meta(files: DataFrame, **options) -> DataFrame:
    return scan(files, "meta", **options)


def info(files: DataFrame, **options) -> DataFrame:
    return scan(files, "info", **options)


def length(files: DataFrame, **options) -> DataFrame:
    return meta(files, **options).select("file_id", F.col("pages").alias("length"))


def pages(files: DataFrame, **options) -> DataFrame:
    """Sizes before rotation, boxes, and rotation as 0, 90, 180 or 270. The crop box is the media box where there is none, and clipped to it."""
    p = scan(files, "pages", **options)
    m, c = F.col("media_box"), F.col("crop_raw")
    clipped = F.array(*[at_most(F.get(c, F.lit(i)), F.get(m, F.lit(i % 2)), F.get(m, F.lit(2 + i % 2))) for i in range(4)])
    crop = F.when(c.isNull(), m).when(m.isNull(), c).otherwise(clipped)
    turned = (F.pmod(F.floor(F.col("rotate_raw") / 90 + 0.5), F.lit(4)) * 90).cast("int")
    out = p.withColumn("crop_box", crop)
    box = F.col("crop_box")
    return out.select("file_id", "page", (F.get(box, F.lit(2)) - F.get(box, F.lit(0))).alias("width"), (F.get(box, F.lit(3)) - F.get(box, F.lit(1))).alias("height"), turned.alias("rotate"), "media_box", "crop_box", "streams", "status")


def pagesize(files: DataFrame, **options) -> DataFrame:
    """Edges of the media box: top is its lower y and bottom its upper one, as stored."""
    b = F.col("media_box")
    at = lambda i: F.get(b, F.lit(i))
    return pages(files, **options).select("file_id", "page", at(1).alias("top"), at(2).alias("right"), at(3).alias("bottom"), at(0).alias("left"), (at(2) - at(0)).alias("width"), (at(3) - at(1)).alias("height"))


def tokens(files: DataFrame, **options) -> DataFrame:
    return scan(files, "tokens", **options)


def page_text(files: DataFrame, layout: str = "reading", **options) -> DataFrame:
    return scan(files, "page_text", layout=layout, **options)


def pdf_text(files: DataFrame, raw: bool = False, **options) -> DataFrame:
    """Page texts, with a line break after each that isn't empty."""
    t = page_text(files, "raw" if raw else "reading", **options)
    return t.select("file_id", "page", F.when(F.col("text") != "", F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"))


def glyphs(files: DataFrame, **options) -> DataFrame:
    return scan(files, "glyphs", **options)


def data(files: DataFrame, font_info: bool = False, **options) -> DataFrame:
    """Words with their boxes."""
    w = scan(files, "words", **options)
    return w if font_info else w.drop("font_name", "font_size")


def font_table(files: DataFrame, **options) -> DataFrame:
    return scan(files, "fonts", **options).select("file_id", "object", "name", "type", "embedded", "status")


def fonts(files: DataFrame, **options) -> DataFrame:
    """Fonts as viewers list them: name, finer type, whether embedded, and no file for an embedded one."""
    t = scan(files, "fonts", **options)
    return t.select("file_id", "object", F.coalesce("name", F.lit("")).alias("name"), F.col("poppler_type").alias("type"), "embedded", F.when(F.col("embedded"), F.lit("")).alias("file"), "status")


def page_images(files: DataFrame, **options) -> DataFrame:
    return scan(files, "images", **options)


def images(files: DataFrame, native: bool = False, **options) -> DataFrame:
    """Samples of every image that a page names: (file_id, object, width, height, data, decoded, pixels, status); pixels only if native."""
    return scan(files, "image_data", native=native, **options)


def toc(files: DataFrame, **options) -> DataFrame:
    return scan(files, "toc", **options).where("item is not null or status.class is not null")


def attachments(files: DataFrame, **options) -> DataFrame:
    return scan(files, "attachments", **options).where("ord is not null or status.class is not null")


def split_status(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are all right, rows that failed), for callers who keep failures apart."""
    bad = F.col("status.class").isNotNull()
    return table.where(~bad), table.where(bad)


def with_secrets(files: DataFrame, secrets: DataFrame) -> DataFrame:
    """files with a column ``passwords``: each file's own from secrets (file_id, password, ord), in the order of ord; a file without any has none."""
    held = F.transform(F.sort_array(F.collect_list(F.struct("ord", "password"))), lambda p: p["password"])
    mine = secrets.where("password is not null").groupBy(F.col("file_id").alias("_f")).agg(held.alias("passwords"))
    return files.join(mine, F.col("file_id").eqNullSafe(F.col("_f")), "left").drop("_f")


def observed(table: DataFrame, name: str = "files") -> tuple[DataFrame, Observation]:
    """The table and an observation of it: rows, failures and warnings are counted while an action on the table runs, without a pass of their own."""
    seen = Observation(name)
    of = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kinds = {f"{k}s": of(F.col("status.class") == k) for k in ("invalid_argument", "parse_error", "password_error", "limit_error", "unsupported_input", "font_error")}
    counted = {"rows": F.count(F.lit(1)), "failed": of(F.col("status.class").isNotNull()), "warned": of(F.col("status.nwarning") > 0), **kinds}
    return table.observe(seen, *[c.alias(n) for n, c in counted.items()]), seen


def failures(table: DataFrame, item: str | None = None) -> DataFrame:
    """(file_id, n, items, class, message): one row for each file in which something failed: how many rows, which (in order; by the column ``item``, such as number, object or page) and the first one's failure.

    Only failed rows are grouped; a file has at most max_objects of them.
    """
    key = item or next((c for c in ("number", "object", "page", "ord") if c in table.columns), None)
    which = F.col(key).cast("long") if key else F.lit(None).cast("long")
    bad = table.where(F.col("status.class").isNotNull()).select("file_id", which.alias("item"), F.col("status.class").alias("class"), F.col("status.message").alias("message"))
    first = F.min(F.struct("item", "class", "message"))
    return bad.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("item")).alias("items"), first.alias("first")).select("file_id", "n", "items", "first.class", "first.message")


def deref(values: DataFrame, objects_: DataFrame, ref: str = "ref") -> DataFrame:
    """Follows a column of object numbers within each file: an equi join on (file_id, number)."""
    if ref not in values.columns:
        raise InvalidArgument(f"no column {ref}", arg="ref")
    o = objects_.select(F.col("file_id"), F.col("number").alias(ref), F.col("value").alias("target"))
    return values.join(o, ["file_id", ref], "left")


def engine_info(spark) -> DataFrame:
    """One row about the engine: its version, tables, limits by default and what it leaves out on purpose."""
    from dataclasses import asdict

    from .. import __version__
    from .scan import SCHEMAS

    limits = {k: float(v) for k, v in asdict(Limits()).items()}
    absent = ["rendering", "OCR", "LZW", "ASCII85", "object streams (writing)", "AES-256"]
    return spark.createDataFrame([(__version__, sorted(SCHEMAS), limits, absent)], "version string, tables array<string>, limits map<string,double>, absent array<string>")


def nested_toc(toc_: DataFrame) -> DataFrame:
    """(file_id, toc): a file's outline as one array in reading order, each item with its path of titles from the top. A file's outline is one group: at most max_objects items, taken in one pass."""
    items = toc_.where("item is not null").select("file_id", "item", "depth", "title", "is_open")
    schema = StructType([items.schema["file_id"], *_parse_datatype_string("toc array<struct<path:array<string>,depth:int,is_open:boolean>>").fields])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        path: list[str | None] = []
        out = []
        for r in table.sort_by("item").to_pylist():
            path = [*path[: r["depth"]], r["title"]]
            out.append({"path": path, "depth": r["depth"], "is_open": r["is_open"]})
        return pa.Table.from_pylist([{"file_id": table.column("file_id")[0].as_py(), "toc": out}], arrow)

    return items.groupBy("file_id").applyInArrow(run, schema)
