"""Tables over PDF bytes: each is one Arrow-batched pass that opens a file, says its rows, and lets it go."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..errors import STATUS, InvalidArgument, LimitError, ParseError, PdfError, status
from ..kernel import rows
from ..kernel.syntax import File
from ..limits import Limits

#: Rows of an output batch, which many small files share, and bytes of files after which it is sent in any case.
BATCH, BATCH_BYTES = 4096, 8 << 20
#: What reading untrusted bytes, or turning what they say into columns, can raise.
FAILURES = (PdfError, ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, ArithmeticError, MemoryError, AssertionError, NotImplementedError, zlib.error, struct.error, pa.ArrowException)

SCHEMAS = {
    "objects": f"number bigint, generation int, type string, subtype string, length bigint, value string, filter array<string>, stored binary, status {STATUS}",
    "streams": f"number bigint, data binary, decoded boolean, filter array<string>, status {STATUS}",
    "meta": f"version string, pages bigint, title string, author string, subject string, keywords string, creator string, producer string, language string, created timestamp, modified timestamp, id array<string>, encryption string, permissions array<string>, status {STATUS}",
    "info": f"version string, pages bigint, encrypted boolean, linearized boolean, keys map<string,string>, created timestamp, modified timestamp, metadata string, locked boolean, attachments boolean, layout string, status {STATUS}",
    "pages": f"page int, media_box array<double>, crop_raw array<double>, rotate_raw double, streams int, status {STATUS}",
    "tokens": f"page int, pos int, type string, value string, status {STATUS}",
    "page_text": f"page int, text string, unmapped int, status {STATUS}",
    "glyphs": f"page int, seq int, x0 double, y0 double, x1 double, y1 double, size double, text string, font string, ascent double, descent double, status {STATUS}",
    "words": f"page int, seq int, width int, height int, x int, y int, space boolean, text string, font_name string, font_size double, status {STATUS}",
    "fonts": f"object bigint, name string, type string, embedded boolean, poppler_type string, status {STATUS}",
    "images": f"page int, object bigint, name string, width int, height int, bits int, color_space string, filter string, status {STATUS}",
    "image_data": f"object bigint, width int, height int, data binary, decoded boolean, pixels array<int>, status {STATUS}",
    "toc": f"item int, parent int, depth int, ord int, title string, is_open boolean, status {STATUS}",
    "bodies": f"kind string, page int, number bigint, pieces array<binary>, refs array<bigint>, links array<bigint>, stream binary, status {STATUS}",
    "attachments": f"ord int, name string, mime string, description string, created timestamp, modified timestamp, data binary, status {STATUS}",
}
KERNELS: dict[str, Callable[..., Iterator[dict]]] = {"objects": rows.objects, "streams": rows.decoded, "meta": rows.meta, "info": rows.info, "pages": rows.pages, "tokens": rows.page_tokens, "page_text": rows.page_text, "glyphs": rows.glyphs, "words": rows.page_words, "fonts": rows.fonts, "images": rows.images, "image_data": rows.image_data, "toc": rows.toc, "attachments": rows.attachments, "bodies": rows.bodies}


def tasks(spark) -> int:
    """So many tasks for work that isn't in proportion to its rows' bytes: at least one a core."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def file_rows(table: str, content: bytes | None, limits: Limits, passwords: tuple[str, ...], mode: str, options: dict) -> Iterator[dict]:
    """A table's rows of one file; in PERMISSIVE mode a failure is a row with its status."""
    try:
        if content is None:
            raise InvalidArgument("content is null", arg="content")
        f = File(bytes(content), limits, passwords)
        if table not in ("objects", "fonts", "streams"):
            f.pages()
        for row in KERNELS[table](f, **options):
            if mode == "FAILFAST" and (row.get("status") or {}).get("class"):
                raise ParseError(row["status"]["message"])
            yield row
    except FAILURES as e:
        if mode == "FAILFAST":
            raise
        yield {"status": status(e)}


def _within(value, kind: pa.DataType):
    """Whole numbers pulled into what the column holds."""
    if isinstance(value, int) and pa.types.is_integer(kind):
        top = 1 << (kind.bit_width - 1)
        return max(-top, min(top - 1, value))
    return value


def _batch(rows_: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; a status, which many rows share, is turned into columns once."""
    def column(f: pa.Field) -> pa.Array:
        values = [r.get(f.name) for r in rows_]
        if f.name != "status":
            return pa.array(values, f.type)
        place: dict[int, int] = {}
        at = [place.setdefault(id(v), len(place)) for v in values]
        each = [None] * len(place)
        for i, v in zip(at, values, strict=True):
            each[i] = v
        return pa.array(each, f.type).take(pa.array(at, pa.int32()))

    return pa.RecordBatch.from_arrays([column(f) for f in arrow], schema=arrow)


def as_batches(found: Iterable[tuple[object, int, Iterator[dict]]], arrow: pa.Schema, mode: str) -> Iterator[pa.RecordBatch]:
    """(file_id, bytes, rows) of file after file -> batches of rows that files share.

    Rows that don't fit their columns are given numbers that do; a file for which that doesn't help becomes a row with the failure.
    """
    held: list[tuple[object, list[dict]]] = []
    rows_held = bytes_held = 0

    def batches() -> Iterator[pa.RecordBatch]:
        try:
            yield _batch([r for _, out in held for r in out], arrow)
        except FAILURES:
            for key, out in held:
                try:
                    yield pa.RecordBatch.from_pylist([{f.name: _within(r.get(f.name), f.type) for f in arrow} for r in out], arrow)
                except FAILURES as e:
                    if mode == "FAILFAST":
                        raise
                    yield pa.RecordBatch.from_pylist([{"file_id": key, "status": status(e)}], arrow)

    for key, size, rows_ in found:
        out: list[dict] = []
        held.append((key, out))
        bytes_held += size
        own = {"file_id": key, "status": status()}
        for row in rows_:
            out.append(own | row)
            rows_held += 1
            if rows_held >= BATCH:
                yield from batches()
                out = []
                held, rows_held, bytes_held = [(key, out)], 0, 0
        if bytes_held >= BATCH_BYTES:
            yield from batches()
            held, rows_held, bytes_held = [], 0, 0
    if rows_held:
        yield from batches()


def scan(files: DataFrame, table: str, *, limits: Limits | None = None, passwords: tuple[str, ...] = (), mode: str = "PERMISSIVE", file_id: str = "file_id", content: str = "content", **options) -> DataFrame:
    """files (file_id, content) -> (file_id, the table's columns). Works on batch and streaming DataFrames alike.

    A file that can't be read is one row with its failure in ``status``; FAILFAST raises instead. ``pages=[...]`` reads only those pages. Files
    longer than max_size are told from their length before Python sees a byte. Where files has a column ``passwords`` (an array of strings), a file's own
    passwords are tried in their order before the ones given for all; being a column, they stand in no plan.
    """
    if table not in SCHEMAS:
        raise InvalidArgument(f"no table {table}", arg="table")
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise InvalidArgument("mode must be PERMISSIVE or FAILFAST", arg="mode")
    if any(isinstance(p, bool) or not isinstance(p, int) or p < 1 for p in options.get("pages") or ()):
        raise InvalidArgument("pages are whole numbers from 1", arg="pages")
    if options.get("layout", "reading") not in ("reading", "raw"):
        raise InvalidArgument("layout must be reading or raw", arg="layout")
    held = limits or Limits()
    most = F.lit(int(held.max_size) if held.max_size != float("inf") else 1 << 62)
    # A source that left a long file unread says its size.
    size = F.coalesce(F.octet_length(F.col(content)), F.col("size")) if "size" in files.columns else F.octet_length(F.col(content))
    large = F.coalesce(size > most, F.lit(False))
    own = F.col("passwords").cast("array<string>") if "passwords" in files.columns else F.lit(None).cast("array<string>")
    given = files.select(F.col(file_id).alias("file_id"), F.when(~large, F.col(content)).alias("content"), large.alias("large"), own.alias("passwords"))
    id_type = given.schema["file_id"].dataType
    body = _parse_datatype_string(SCHEMAS[table])
    schema = StructType().add("file_id", id_type)
    for field in body.fields:
        schema.add(field)
    arrow = to_arrow_schema(schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, Iterator[dict]]]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, content_ = batch.column(0)[i].as_py(), batch.column(1)[i]
                if batch.column(2)[i].as_py():
                    if mode == "FAILFAST":
                        raise LimitError("max_size", held.max_size)
                    yield key, 0, iter([{"status": status(LimitError("max_size", held.max_size))}])
                else:
                    data, secrets = content_.as_py(), batch.column(3)[i].as_py() or []
                    yield key, len(data or b""), file_rows(table, data, held, (*(p for p in secrets if p is not None), *passwords), mode, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from as_batches(found(batches), arrow, mode)

    return given.mapInArrow(run, schema)
