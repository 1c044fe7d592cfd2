"""Scalar functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..kernel.crypt import PERMISSIONS
from ..kernel.fonts import WIN, core_width


def permissions(bits: Column) -> Column:
    """Names of the permissions whose bits are set."""
    table = F.create_map(*[F.lit(x) for kv in PERMISSIONS.items() for x in kv])
    return F.filter(F.map_keys(table), lambda k: bits.bitwiseAND(table[k]) != 0)


def rotation(degrees: Column) -> Column:
    return (F.pmod(F.floor(degrees / 90 + 0.5), F.lit(4)) * 90).cast("int")


def text_width(text: Column, font: str = "Helvetica", size: float = 12.0) -> Column:
    """The advance of a string in a core font, by a table of widths of code page 1252's characters."""
    known = {WIN[b]: float(core_width(font, WIN[b])) for b in range(256) if WIN[b]}
    other = float(core_width(font, ord("?")))
    # A map is looked through from its beginning; ASCII goes by its place.
    ascii_ = F.array(*[F.lit(known.get(p, other)) for p in range(128)])
    widths = F.create_map(*[F.lit(x) for p, w in known.items() if p >= 128 for x in (chr(p), w)])
    if font.startswith("Courier"):
        return (F.length(text) * (0.6 * size)).cast("double")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.when(F.ascii(c) < 128, F.get(ascii_, F.ascii(c))).otherwise(F.coalesce(F.try_element_at(widths, c), F.lit(other)))) * (size / 1000)


def hex_id(data: Column) -> Column:
    return F.lower(F.hex(data))


def clamp_int(v: Column) -> Column:
    """A number as an int: nothing for not-a-number, else the nearest that fits."""
    return F.when(F.isnan(v) | v.isNull(), 0).otherwise(F.least(F.greatest(v, F.lit(-2147483648.0)), F.lit(2147483647.0))).cast("int")


def paper_sizes() -> list[tuple[str, float, float]]:
    """ISO A and B by halving, floored to millimetres, and three US sizes, in points."""
    out = []
    for series, (w, h) in (("a", (841, 1189)), ("b", (1000, 1414))):
        for i in range(11):
            out.append((f"{series}{i}", round(w * 72 / 25.4, 2), round(h * 72 / 25.4, 2)))
            w, h = math.floor(h / 2), w
    return [*out, ("letter", 612.0, 792.0), ("legal", 612.0, 1008.0), ("tabloid", 792.0, 1224.0)]


def paper(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(paper_sizes(), "name string, width double, height double")


def paper_size(name: str, landscape: bool = False) -> tuple[float, float]:
    found = {n: (w, h) for n, w, h in paper_sizes()}.get(name.lower())
    if found is None:
        raise InvalidArgument(f"no paper {name}", arg="name")
    return found[::-1] if landscape else found


#: What is put after an input's name.
OUTPUTS = {"subset": "_output.pdf", "rotate": "_output.pdf", "combine": "_combined.pdf"}


def output_name(path: Column, kind: str, page: Column | None = None) -> Column:
    """Where an operation's file goes by default: the (first) input's path without ``.pdf``, in any case, then ``_output.pdf``, ``_combined.pdf``, or ``_<page>.pdf`` for kind ``split``. A null path, as of a file from memory, has none."""
    if kind not in OUTPUTS and not (kind == "split" and page is not None):
        raise InvalidArgument("kind must be subset, rotate, combine, or split with a page", arg="kind")
    ending = F.lit(OUTPUTS[kind]) if kind in OUTPUTS else F.concat(F.lit("_"), page.cast("string"), F.lit(".pdf"))
    return F.concat(F.regexp_replace(path, r"(?i)\.pdf\z", ""), ending)


def safe_outputs(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """outputs (output, ...) with ``clash``: why a file can't go there: it would overwrite an input (path), or another output, or it has no name. Null where all is well."""
    taken = inputs.select(F.col("path").alias("_in")).where("_in is not null").distinct()
    twice = outputs.groupBy(F.col("output").alias("_out")).count().where("count > 1").select("_out")
    met = outputs.join(taken, F.col("output") == F.col("_in"), "left").join(twice, F.col("output") == F.col("_out"), "left")
    why = F.when(F.col("output").isNull(), F.lit("output is needed for a file from memory")).when(F.col("_in").isNotNull(), F.lit("output must not overwrite an input")).when(F.col("_out").isNotNull(), F.lit("several files would go there"))
    return met.withColumn("clash", why).drop("_in", "_out")


#: Colour names that are understood (a subset of the CSS names); hexadecimal colours are too.
COLOURS = {"black": 0x000000, "white": 0xFFFFFF, "red": 0xFF0000, "green": 0x00FF00, "blue": 0x0000FF, "yellow": 0xFFFF00, "cyan": 0x00FFFF, "magenta": 0xFF00FF, "gray": 0xBEBEBE, "grey": 0xBEBEBE, "orange": 0xFFA500, "brown": 0xA52A2A, "purple": 0xA020F0, "pink": 0xFFC0CB, "darkgreen": 0x006400, "darkblue": 0x00008B, "darkred": 0x8B0000, "navy": 0x000080}


def rgb(colour: Column) -> Column:
    """(r, g, b) from 0 to 1 of a colour name, gray0 to gray100 or #RRGGBB[AA]; null for none, transparent or unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    low = F.lower(colour)
    # Shades are numbered in hundredths of white.
    shade = F.floor(F.regexp_extract(low, "^gr[ae]y(100|[0-9]{1,2})$", 1).try_cast("int") * 2.55 + 0.5).cast("int")
    v = F.when(low.rlike("^#[0-9a-f]{6}([0-9a-f]{2})?$"), F.conv(F.substring(low, 2, 6), 16, 10).cast("int")).when(shade.isNotNull(), shade * 0x10101).otherwise(F.try_element_at(table, low))
    return F.when(v.isNotNull(), F.array(*[F.shiftright(v, s).bitwiseAND(255) / 255.0 for s in (16, 8, 0)]))
