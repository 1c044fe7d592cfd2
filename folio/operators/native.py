"""Files assembled by Spark: which objects a page needs, their new numbers, their bytes, offsets and cross references are joins, windows and aggregates over tables.

The kernel only tells an object's bytes with its references left open (table ``bodies``). From there on a document is rows, spread over tasks: what its pages reach is found from the
numbers of references alone; new numbers and offsets are prefix sums, over parts and then within a part; cross references are an ordered
``listagg`` of each part. So the parts of one huge document are worked on by many tasks; ``segments`` gives its bytes as ordered rows, and only ``combine``, whose result is one value, brings a document together.

Bytes equal those of ``write.combine``. A part is one input file in one document. Parts go by order; equal ones in any order. A document with a part that can't be read has no content but the first part's status. A null document is a document of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window

from ..errors import STATUS
from ..limits import Limits
from .graph import Tables, fine
from .scan import scan

HEADER = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
#: Numbers of the catalog and the page tree come first.
FIRST = 3


def _bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def long(side: DataFrame) -> DataFrame:
    """A side of a join with about a row a document, joined by sorting: its file is a few MB where its rows are millions, and by the file's size Spark would send them all through the driver."""
    return side.hint("merge")


#: Rows, and bytes of images, that are sent to all tasks.
FEW, FEW_BYTES = 10_000, 8 << 20


def without(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of the documents (doc) that aren't among the written table failed."""
    keep = failed.select(F.col("doc").alias("_d"))
    n = keep.limit(FEW + 1).count()
    return rows.join(F.broadcast(keep) if n <= FEW else long(keep), F.col("doc").eqNullSafe(F.col("_d")), "left_anti") if n else rows


def _number(c: Column) -> Column:
    return F.concat(c.cast("string"), F.lit(" 0 R"))


def reached(edges: DataFrame) -> DataFrame:
    """edges (part, kind, page, number, links) -> (part, page, number, place): the pages of a part and every object that they reach, in order of discovery; place counts from 0.

    A part's references, 16 bytes each, are one group; a file has at most max_objects objects. Pages come first; then what the pages refer to is taken last found, first followed. Pages that are
    referred to aren't followed, nor is the page tree.
    """
    schema = StructType([edges.schema["part"], *_parse_datatype_string("page int, number bigint, place bigint").fields])

    def run(table: pa.Table) -> pa.Table:
        part, rows = table.column("part")[0].as_py(), table.select(["kind", "page", "number", "links"]).to_pylist()
        pages = sorted((r for r in rows if r["kind"] == "page"), key=lambda r: r["page"])
        links = {r["number"]: r["links"] or [] for r in rows if r["kind"] == "object"}
        seen = {r["number"] for r in rows if r["kind"] != "object"}
        order = [(r["page"], r["number"]) for r in pages]
        todo: list[int] = []

        def follow(refs: list[int]) -> None:
            for n in refs:
                if n not in seen:
                    seen.add(n)
                    order.append((None, n))
                    todo.append(n)

        for r in pages:
            follow(r["links"] or [])
        while todo:
            follow(links.get(todo.pop(), []))
        return pa.table({"part": pa.array([part] * len(order), table.schema.field("part").type), "page": pa.array([p for p, _ in order], pa.int32()), "number": pa.array([n for _, n in order], pa.int64()), "place": pa.array(range(len(order)), pa.int64())})

    return edges.groupBy("part").applyInArrow(run, schema)


def _before(rows: DataFrame, size: Column, name: str) -> DataFrame:
    """rows (doc, ord, part) with the sum of size over the document's earlier parts: a row a part."""
    order = Window.partitionBy("doc").orderBy("ord", "part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(size).over(order), F.lit(0)).cast("long"))


def laid_out(written: DataFrame, docs: DataFrame, kids: DataFrame, tables: Tables, info: DataFrame | None = None, version: str = "1.7") -> DataFrame:
    """Objects written (doc, ord, part, new, data: from number 3 on, parts in order of (ord, part)), every document, and its pages kids (doc, n, kids) -> (doc, kind, at, data): all bytes in order of (kind, at), the id still zeros.

    info (doc, new): the number of the information dictionary. Offsets are the bytes of earlier parts, then of earlier objects of the part.
    """
    header = f"%PDF-{version}\n%".encode() + HEADER[-5:]
    docs = docs.join(long(kids.withColumnRenamed("doc", "_d")), F.col("doc").eqNullSafe(F.col("_d")), "left").drop("_d")
    tree = F.concat(F.lit("<</Count "), F.coalesce("n", F.lit(0)).cast("string"), F.lit("/Kids ["), F.coalesce("kids", F.lit("")), F.lit("]/Type /Pages>>"))
    head = docs.select("doc", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("new"), F.lit("<</Pages 2 0 R/Type /Catalog>>").alias("says")), F.struct(F.lit(2).cast("long").alias("new"), tree.alias("says")))).alias("h"))
    none = F.lit(-(1 << 63))
    head = head.select("doc", none.alias("ord"), none.alias("part"), "h.new", _bytes(F.concat(F.col("h.new").cast("string"), F.lit(" 0 obj\n"), F.col("h.says"), F.lit("\nendobj\n"))).alias("data"))
    written = tables.put(written.select("doc", "ord", "part", "new", "data").unionByName(head), "written")
    long_ = written.groupBy("doc", "ord", "part").agg(F.sum(F.octet_length("data")).alias("size"))
    ahead = tables.put(_before(long_, F.col("size"), "ahead"), "ahead")
    inside = Window.partitionBy("part", "doc").orderBy("new").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written.select("doc", "ord", "part", "new", F.octet_length("data").alias("size")).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ahead_ = ahead.select(F.col("part").alias("_p"), F.col("doc").alias("_d"), "ahead")
    lines = offsets.join(long(ahead_), (F.col("part") == F.col("_p")) & F.col("doc").eqNullSafe(F.col("_d"))).select("doc", "part", "new", F.format_string("%010d 00000 n \n", F.col("ahead") + F.col("within") + len(header)).alias("line"))
    table = lines.groupBy("doc", "part").agg(F.min("new").alias("at"), F.expr("listagg(line, '') WITHIN GROUP (ORDER BY new)").alias("lines"))
    whole = ahead.groupBy("doc").agg((F.sum("size") + len(header)).alias("xref")).join(long(written.groupBy(F.col("doc").alias("_d")).agg(F.max("new").alias("most"))), F.col("doc").eqNullSafe(F.col("_d"))).drop("_d")
    said = F.lit("")
    if info is not None:
        whole = whole.join(long(info.select(F.col("doc").alias("_d"), F.col("new").alias("_info"))), F.col("doc").eqNullSafe(F.col("_d")), "left").drop("_d")
        said = F.coalesce(F.concat(F.lit("/Info "), _number(F.col("_info"))), F.lit(""))
    opening = F.concat(F.lit("xref\n0 "), (F.col("most") + 1).cast("string"), F.lit("\n0000000000 65535 f \n"))
    zeros = "0" * 32
    ending = F.concat(F.lit(f"trailer\n<</ID [<{zeros}> <{zeros}>]"), said, F.lit("/Root 1 0 R/Size "), (F.col("most") + 1).cast("string"), F.lit(">>\nstartxref\n"), F.col("xref").cast("string"), F.lit("\n%%EOF\n"))
    row = lambda df, kind, at, data_: df.select("doc", F.lit(kind).alias("kind"), at.cast("long").alias("at"), data_.alias("data"))
    nil = F.lit(0)
    return row(docs, 0, nil, F.lit(header)).unionByName(row(written, 1, F.col("new"), F.col("data"))).unionByName(row(whole, 2, nil, _bytes(opening))).unionByName(row(table, 3, F.col("at"), _bytes(F.col("lines")))).unionByName(row(whole, 4, nil, _bytes(ending)))


def joined(rows: DataFrame) -> DataFrame:
    """(doc, kind, at, data) -> (file_id, content): each document's bytes as one value, its id the digest of everything with an id of zeros."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([StructField("file_id", rows.schema["doc"].dataType), *_parse_datatype_string("content binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, held, digest = none, [], hashlib.sha256()

        def done() -> pa.RecordBatch:
            held[-1] = held[-1].replace(b"0" * 32, digest.digest()[:16].hex().upper().encode())
            return pa.RecordBatch.from_arrays([pa.array([now], arrow[0].type), pa.array([b"".join(held)], pa.binary())], schema=arrow)

        for batch in batches:
            for doc, data in zip(batch.column(0), batch.column(1), strict=True):
                key = doc.as_py()
                if now is not none and key != now:
                    yield done()
                    held, digest = [], hashlib.sha256()
                now = key
                held.append(data.as_py())
                digest.update(held[-1])
        if now is not none:
            yield done()

    return rows.repartition("doc").sortWithinPartitions(F.col("doc").asc_nulls_first(), "kind", "at").select("doc", "data").mapInArrow(run, schema)


def segments(files: DataFrame, into: Column, order: Column, limits: Limits = Limits(), passwords: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """((doc, kind, at, data): a document's bytes in order of (kind, at), the id still zeros; (doc, status): documents that have none)."""
    tables = Tables(files.sparkSession, "assembly")
    given = files.select(F.struct(into.alias("doc"), order.cast("long").alias("ord"), F.monotonically_increasing_id().alias("part")).alias("file_id"), "content")
    told = tables.put(scan(given, "bodies", limits=limits, passwords=passwords).select("file_id.*", "kind", "page", "number", "pieces", "refs", "links", "stream", "status"), "bodies")
    parts = told.groupBy("part").agg(F.first("doc").alias("doc"), F.first("ord").alias("ord"))
    numbered = tables.put(reached(told.where("kind is not null").select("part", "kind", "page", "number", "links")), "reached")

    # New numbers: parts one after the other, and places within a part.
    counts = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = tables.put(_before(parts.join(counts, "part", "left"), F.coalesce("n", F.lit(0)), "start"), "starts")
    placed = numbered.join(starts.select("part", "doc", "ord", "start"), "part").select("doc", "ord", "part", "page", "number", (F.col("start") + F.col("place") + FIRST).alias("new"))
    placed = tables.put(placed, "placed")

    # What failed: a part as a whole, or an object that a page needs.
    broken = told.where("status.class is not null")
    needed = broken.where("kind is null").select("doc", "ord", "status").unionByName(broken.where("kind = 'object'").join(placed.where("page is null").select("part", "number"), ["part", "number"]).select("doc", "ord", "status"))
    failed = tables.put(needed.groupBy("doc").agg(F.min_by("status", "ord").alias("status")), "failed")

    # Bytes: a page is known by its place, an object by its number. What isn't in the file is the null object.
    pages = placed.where("page is not null").select("part", "page", "doc", "ord", "new").join(told.where("kind = 'page'").select("part", "page", "pieces", "refs", "stream"), ["part", "page"]).drop("page")
    objects_ = placed.where("page is null").select("part", "number", "doc", "ord", "new").join(told.where("kind = 'object'").select("part", "number", "pieces", "refs", "stream"), ["part", "number"], "left").drop("number")
    every = tables.put(pages.unionByName(objects_), "bytes")
    # The first copy of a page is what references mean.
    target = placed.where("number > 0").groupBy("part", F.col("number").alias("ref")).agg(F.min("new").alias("to"))
    each = every.where(F.size("refs") > 0).select("part", "new", F.posexplode("refs").alias("i", "ref"))
    named = each.join(target, ["part", "ref"], "left").withColumn("says", F.when(F.col("ref").isNull(), F.lit("2 0 R")).otherwise(F.coalesce(_number(F.col("to")), F.lit("null"))))
    named = named.groupBy("part", "new").agg(F.sort_array(F.collect_list(F.struct("i", "says"))).alias("says"))
    full = every.join(named, ["part", "new"], "left")
    # Pieces and references by turns; joined as hexadecimal text, which takes one pass over the bytes however many there are.
    turns = F.transform("pieces", lambda p, i: F.concat(F.hex(p), F.coalesce(F.hex(_bytes(F.get(F.col("says"), i)["says"])), F.lit(""))))
    value = F.coalesce(F.unhex(F.array_join(turns, "")), F.lit(b"null"))
    data = F.concat(_bytes(F.concat(F.col("new").cast("string"), F.lit(" 0 obj\n"))), value, F.when(F.col("stream").isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\nstream\n"), F.col("stream"), F.lit(b"\nendstream"))), F.lit(b"\nendobj\n"))
    written = full.select("doc", "ord", "part", "new", data.alias("data"))
    kids = placed.where("page is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.expr("listagg(concat(cast(new as string), ' 0 R'), ' ') WITHIN GROUP (ORDER BY new)").alias("kids"))
    out = laid_out(written, parts.select("doc").distinct(), kids, tables)
    keep = failed.select(F.col("doc").alias("_d"))
    return out.join(keep, F.col("doc").eqNullSafe(F.col("_d")), "left_anti"), failed


def combine(files: DataFrame, into: Column, order: Column, limits: Limits = Limits(), passwords: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, content, status): files of one group ``into`` one after the other by ``order``, as ``write.combine`` gives them."""
    rows, failed = segments(files, into, order, limits, passwords)
    bad = failed.select(F.col("doc").alias("file_id"), F.lit(None).cast("binary").alias("content"), F.col("status").cast(_parse_datatype_string(STATUS)).alias("status"))
    return joined(rows).withColumn("status", fine()).unionByName(bad)
