"""The object graph as tables: page trees, inherited attributes and name trees from ``objects`` alone, by joins and recursion.

A file's objects are rows (file_id, number, value, stream); a reference is an equi join on (file_id, number). Walks down (``/Kids``) go level by level: each node keeps its
least path, and only nodes whose path got less go on, so neither a cycle nor a node of many parents repeats work. Walks up (``/Parent``) have one way each and are a recursive query.
One hostile file is bounded by max_depth like any other: it gets its status, and the others don't notice.

The scan of the files is written once, since every level reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from ..errors import STATUS
from ..limits import Limits
from ..sources.store import shared_folder

#: Page attributes that are inherited and that the pages table says.
INHERITED = ("MediaBox", "CropBox", "Rotate")


class Tables:
    """Written tables in a folder of their own; results read them."""

    def __init__(self, spark, name: str):
        self.spark, self.at, self.n = spark, shared_folder(spark, name), 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def part(value: str | Column, path: str, kind: str = "variant") -> Column:
    """An entry of a tagged value, or null where there is none or another kind."""
    return F.try_variant_get(F.col(value) if isinstance(value, str) else value, path, kind)


def items(value: Column) -> Column:
    """A list's items; null for anything else."""
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def is_dict(value: Column) -> Column:
    return part(value, "$.dict").isNotNull()


def decimal(value: Column) -> Column:
    """A number as a double; null for anything else, also for text that looks like one."""
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))


def text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def failed(kind: str, message: str | Column, limit: str | None = None, value: float | None = None) -> Column:
    """A status of an error."""
    says = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit("error").alias("status"), F.lit(kind).alias("class"), says.alias("message"), F.lit(0).alias("nwarning"), F.lit(None).cast("string").alias("warning"), F.lit(limit).cast("string").alias("limit"), F.lit(value).cast("double").alias("limit_value")).cast(_parse_datatype_string(STATUS))


def fine() -> Column:
    return F.struct(F.lit("ok").alias("status"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("message"), F.lit(0).alias("nwarning"), F.lit(None).cast("string").alias("warning"), F.lit(None).cast("string").alias("limit"), F.lit(None).cast("double").alias("limit_value")).cast(_parse_datatype_string(STATUS))


def graph(objects_: DataFrame, tables: Tables) -> DataFrame:
    """(file_id, number, value, stream) of the objects that could be read."""
    return tables.put(objects_.where("value is not null").select("file_id", "number", "value", F.col("length").isNotNull().alias("stream")), "graph")


def follow(rows: DataFrame, column: str, graph_: DataFrame, number: str | None = None, stream: str | None = None) -> DataFrame:
    """Replaces references in a column by what they refer to (null if that is missing); what is no reference stays. number and stream: columns for the object's number, and whether it is a stream."""
    ref = part(column, "$.ref", "bigint")
    # Rows without a reference get numbers that no object has, and not all the same one: they would all go to one task.
    key = F.coalesce(ref, -2 - F.pmod(F.xxhash64("file_id", F.to_json(column)), F.lit(1 << 20)))
    to = graph_.select(F.col("file_id").alias("_file"), F.col("number").alias("_number"), F.col("value").alias("_value"), F.col("stream").alias("_stream"))
    met = rows.withColumn("_key", key).join(to, F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("_key") == F.col("_number")), "left")
    out = met.withColumn(column, F.when(ref.isNull(), F.col(column)).otherwise(F.col("_value")))
    if number:
        out = out.withColumn(number, F.col("_number"))
    if stream:
        out = out.withColumn(stream, F.coalesce("_stream", F.lit(False)))
    return out.drop("_key", "_file", "_number", "_value", "_stream")


# --- down ------------------------------------------------------------------------------------------------------------------------

def walk(start: DataFrame, graph_: DataFrame, tables: Tables, max_depth: int, *, ends: Column | None = None, only_references: bool = False) -> DataFrame:
    """Nodes of a tree of ``/Kids`` below start (file_id, value: roots or references to them): (file_id, number, value, path, depth), each node once, at its least path.

    ends: nodes whose kids aren't looked at. Ordering by path is reading order. Nodes deeper than max_depth + 1 are not visited; a direct node has number 0.
    """
    level = tables.put(follow(start.select("file_id", "value"), "value", graph_, "number").where(is_dict(F.col("value"))).select("file_id", F.coalesce("number", F.lit(0)).alias("number"), "value", F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth")), "level")
    best = level
    for depth in range(int(min(max_depth, 1_000_000)) + 1):
        open_ = level.where(~F.coalesce(ends, F.lit(False))) if ends is not None else level
        kids = follow(open_.select("file_id", "path", part("value", "$.dict.Kids").alias("kids")).where("kids is not null"), "kids", graph_)
        each = kids.select("file_id", "path", F.posexplode(items(F.col("kids"))).alias("place", "value"))
        if only_references:
            each = each.where(part("value", "$.ref", "bigint").isNotNull())
        found = follow(each, "value", graph_, "number").where(is_dict(F.col("value")))
        found = found.select("file_id", F.coalesce("number", F.lit(0)).alias("number"), "value", F.array_append("path", F.col("place").cast("int")).alias("path"), F.lit(depth + 1).alias("depth"))
        key = ["file_id", F.when(F.col("number") == 0, F.concat_ws(",", F.col("path").cast("array<string>"))).otherwise(F.col("number").cast("string"))]
        first = Window.partitionBy(*key).orderBy("path")
        found = found.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
        held = best.where("number > 0").groupBy(F.col("file_id").alias("_f"), F.col("number").alias("_n")).agg(F.min("path").alias("_path"))
        new = found.join(held, F.col("file_id").eqNullSafe(F.col("_f")) & (F.col("number") == F.col("_n")), "left").where(F.col("_path").isNull() | (F.col("path") < F.col("_path"))).drop("_f", "_n", "_path")
        level = tables.put(new, "level")
        if not level.limit(1).count():
            break
        best = best.unionByName(level)
    key = ["file_id", F.when(F.col("number") == 0, F.concat_ws(",", F.col("path").cast("array<string>"))).otherwise(F.col("number").cast("string"))]
    return best.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy("path"))).where("_first = 1").drop("_first")


def page_nodes(graph_: DataFrame, tables: Tables, limits: Limits) -> DataFrame:
    """(file_id, page, number, value, status): pages in order; a file with too deep a tree or too many pages is one row that says so."""
    root = graph_.where("number = 0").select("file_id", part("value", "$.dict.Pages").alias("value"))
    is_page = part("value", "$.dict.Type.name", "string") == "Page"
    nodes = follow(walk(root, graph_, tables, int(min(limits.max_depth, 1_000_000)), ends=is_page).withColumn("kids", part("value", "$.dict.Kids")), "kids", graph_)
    leaf = is_page | (items(F.col("kids")).isNull() & ~F.coalesce(part("value", "$.dict.Type.name", "string") == "Pages", F.lit(False)))
    nodes = tables.put(nodes.select("file_id", "number", "value", "path", "depth", F.coalesce(leaf, items(F.col("kids")).isNull() & part("value", "$.dict.Type.name", "string").isNull()).alias("leaf")), "nodes")
    bad = nodes.groupBy("file_id").agg(F.max("depth").alias("deepest"), F.count_if("leaf").alias("n"))
    deep, many = F.col("deepest") > limits.max_depth, F.col("n") > limits.max_pages
    bad = bad.where(deep | many).select("file_id", F.when(deep, failed("limit_error", f"more than {limits.max_depth:g} allowed by max_depth", "max_depth", limits.max_depth)).otherwise(failed("limit_error", f"more than {limits.max_pages:g} allowed by max_pages", "max_pages", limits.max_pages)).alias("status"))
    # A file has at most max_pages pages, or isn't ranked.
    good = nodes.where("leaf").join(bad.select(F.col("file_id").alias("_f")), F.col("file_id").eqNullSafe(F.col("_f")), "left_anti")
    ranked = good.select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("path")).alias("page"), "number", "value", fine().alias("status"))
    return tables.put(ranked.unionByName(bad.select("file_id", F.lit(None).cast("int").alias("page"), F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("variant").alias("value"), "status")), "pages")


# --- up --------------------------------------------------------------------------------------------------------------------------

def inherited(nodes: DataFrame, graph_: DataFrame, tables: Tables, keys: tuple[str, ...] = INHERITED, max_depth: float = 64) -> DataFrame:
    """nodes (file_id, page, value) -> (file_id, page, deep, a column each key): an attribute of the page or of its nearest ancestor that has it at all, even as null.

    A recursive query goes up ``/Parent`` until every key is found. deep: there is an ancestor beyond max_depth while a key is still missing, as on a cycle.
    """
    spark, most = nodes.sparkSession, int(min(max_depth, 1_000_000))
    start = ", ".join(f"try_variant_get(value, '$.dict.{k}', 'variant') AS {k}" for k in keys)
    onward = ", ".join(f"coalesce(u.{k}, CASE WHEN u.depth < {most} THEN try_variant_get(o.value, '$.dict.{k}', 'variant') END) AS {k}" for k in keys)
    missing = " OR ".join(f"u.{k} IS NULL" for k in keys)
    limit, rows = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set(limit, "-1")  # rows are bounded by pages and depth
    try:
        up = spark.sql(
            f"""WITH RECURSIVE up(file_id, page, parent, depth, {', '.join(keys)}) MAX RECURSION LEVEL {most + 3} AS (
              SELECT file_id, page, try_variant_get(value, '$.dict.Parent.ref', 'bigint'), 0, {start} FROM {{nodes}}
              UNION ALL
              SELECT u.file_id, u.page, try_variant_get(o.value, '$.dict.Parent.ref', 'bigint'), u.depth + 1, {onward}
              FROM up u JOIN {{graph}} o ON o.file_id <=> u.file_id AND o.number = u.parent
              WHERE u.depth <= {most} AND ({missing}))
            SELECT * FROM up""",
            nodes=nodes.where("page is not null").select("file_id", "page", "value"), graph=graph_)
        last = up.groupBy("file_id", "page").agg(F.max_by(F.struct("depth", *keys), "depth").alias("last"))
        none_left = F.lit(False)
        for k in keys:
            none_left = none_left | F.col(f"last.{k}").isNull()
        return tables.put(last.select("file_id", "page", ((F.col("last.depth") > most) & none_left).alias("deep"), *[F.col(f"last.{k}").alias(k) for k in keys]), "inherited")
    finally:
        spark.conf.set(limit, rows)


def _box(found: DataFrame, column: str, graph_: DataFrame) -> DataFrame:
    """A box as four doubles, corners in order; null if it isn't four numbers. Numbers may be references."""
    boxes = follow(found.select("file_id", "page", F.col(column).alias("box")).where("box is not null"), "box", graph_)
    four = boxes.where(F.size(items(F.col("box"))) == 4).select("file_id", "page", F.posexplode(items(F.col("box"))).alias("i", "x"))
    numbers = follow(four, "x", graph_).groupBy("file_id", "page").agg(F.sort_array(F.collect_list(F.struct("i", decimal(F.col("x")).alias("x")))).alias("c"))
    at = lambda i: F.col("c")[i]["x"]
    whole = ~F.exists("c", lambda c: c["x"].isNull())
    box = F.when(whole, F.array(F.least(at(0), at(2)), F.least(at(1), at(3)), F.greatest(at(0), at(2)), F.greatest(at(1), at(3))))
    return numbers.select(F.col("file_id").alias("_f"), F.col("page").alias("_p"), box.alias(f"{column}_box"))


def raw_pages(objects_: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What the kernel's pages table says, from the objects table: (file_id, page, media_box, crop_raw, rotate_raw, streams, status)."""
    tables = Tables(objects_.sparkSession, "graph")
    graph_ = graph(objects_, tables)
    nodes = page_nodes(graph_, tables, limits)
    found = inherited(nodes, graph_, tables, INHERITED, limits.max_depth)
    turned = follow(found.select("file_id", "page", "deep", "Rotate"), "Rotate", graph_).select(F.col("file_id").alias("_f"), F.col("page").alias("_p"), "deep", F.coalesce(decimal(F.col("Rotate")), F.lit(0.0)).alias("rotate_raw"))
    contents = follow(nodes.where("page is not null").select("file_id", "page", part("value", "$.dict.Contents").alias("c")), "c", graph_, stream="s")
    shown = contents.select(F.col("file_id").alias("_f"), F.col("page").alias("_p"), F.when(items(F.col("c")).isNotNull(), F.size(items(F.col("c")))).otherwise(F.col("s").cast("int")).alias("streams"))
    out = nodes.select("file_id", "page", "status")
    for table in (turned, shown, _box(found, "MediaBox", graph_), _box(found, "CropBox", graph_)):
        out = out.join(table, F.col("file_id").eqNullSafe(F.col("_f")) & (F.col("page") == F.col("_p")), "left").drop("_f", "_p")
    deep = F.coalesce("deep", F.lit(False))
    said = lambda c: F.when(~deep, F.col(c))
    status = F.when(deep, failed("limit_error", f"more than {limits.max_depth:g} allowed by max_depth", "max_depth", limits.max_depth)).otherwise(F.col("status"))
    return out.select("file_id", "page", said("MediaBox_box").alias("media_box"), said("CropBox_box").alias("crop_raw"), said("rotate_raw").alias("rotate_raw"), said("streams").alias("streams"), status.alias("status"))


# --- name trees ------------------------------------------------------------------------------------------------------------------

def name_tree(start: DataFrame, graph_: DataFrame, tables: Tables, max_depth: float = 64) -> DataFrame:
    """(file_id, ord, key, value) of a name tree below start (file_id, value), in order: a node's own pairs before its kids'. An odd last key has no value and is dropped; a node that comes twice counts once."""
    nodes = walk(start, graph_, tables, int(min(max_depth, 1_000_000)), only_references=True).where(F.col("depth") <= max_depth)
    named = follow(nodes.select("file_id", "path", part("value", "$.dict.Names").alias("names")).where("names is not null"), "names", graph_)
    list_ = items(F.col("names"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(list_) / 2).cast("int")), lambda i: F.struct((i * 2 - 2).alias("at"), F.get(list_, i * 2 - 2).alias("key"), F.get(list_, i * 2 - 1).alias("value")))
    each = named.where(F.size(list_) >= 2).select("file_id", "path", F.explode(pairs).alias("p")).select("file_id", "path", "p.*")
    return each.select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("path", "at")).alias("ord"), "key", "value")


def attachments(objects_: DataFrame, streams_: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """(file_id, ord, name, mime, description, created, modified, object, data) of every embedded file, from objects alone; data comes from streams_ (file_id, number, data) where they are given.

    The name is the specification's UF, else its F, else the tree's key; the file is EF's UF, else its F.
    """
    tables = Tables(objects_.sparkSession, "names")
    graph_ = graph(objects_, tables)
    root = follow(graph_.where("number = 0").select("file_id", part("value", "$.dict.Names").alias("names")), "names", graph_)
    pairs = name_tree(root.select("file_id", part("names", "$.dict.EmbeddedFiles").alias("value")).where("value is not null"), graph_, tables, limits.max_depth)
    spec = follow(follow(pairs, "value", graph_), "key", graph_)
    spec = spec.select("file_id", "ord", "key", *[part("value", f"$.dict.{k}").alias(n) for k, n in (("UF", "uf"), ("F", "f"), ("Desc", "desc"), ("EF", "ef"))])
    for c in ("uf", "f", "desc", "ef"):
        spec = follow(spec, c, graph_)
    file = spec.select("file_id", "ord", F.coalesce(text(F.col("uf")), text(F.col("f")), text(F.col("key")), F.lit("")).alias("name"), text(F.col("desc")).alias("description"), F.coalesce(part("ef", "$.dict.UF"), part("ef", "$.dict.F")).alias("file"))
    file = follow(file, "file", graph_, "object", "is_stream").withColumn("params", part("file", "$.dict.Params"))
    file = follow(follow(file.withColumn("sub", part("file", "$.dict.Subtype")), "params", graph_), "sub", graph_)
    time = lambda k: F.timestamp_seconds(part("params", f"$.dict.{k}.date", "bigint"))
    held = F.col("is_stream")
    out = file.select("file_id", "ord", "name", F.when(held, F.coalesce(part("sub", "$.name", "string"), text(F.col("sub")))).alias("mime"), "description", F.when(held, time("CreationDate")).alias("created"), F.when(held, time("ModDate")).alias("modified"), F.when(held, F.col("object")).alias("object"))
    if streams_ is None:
        return out.withColumn("data", F.lit(None).cast("binary"))
    data = streams_.select(F.col("file_id").alias("_f"), F.col("number").alias("_n"), "data")
    return out.join(data, F.col("file_id").eqNullSafe(F.col("_f")) & (F.col("object") == F.col("_n")), "left").drop("_f", "_n")
