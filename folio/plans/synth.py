"""PDFs made from tables: a row's values to the bytes of a small file. For tests and driver queries, which have no PDFs to read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..kernel.serialize import Builder
from ..kernel.values import Name, Ref, Stream
from ..operators.scan import tasks

LETTER = [0, 0, 612, 792]


def shown(text: str, x: float = 72, y: float = 720, size: float = 12) -> bytes:
    """A content stream that shows one line of text."""
    data = text.encode("cp1252", "replace")
    body = data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")
    return b"BT /F1 %g Tf %g %g Td (%s) Tj ET" % (size, x, y, body)


def pdf(*contents: bytes, font: str = "Courier", media_box=LETTER, tree: dict | None = None, page: dict | None = None, flate: bool = False, info: dict | None = None, more: Callable[[Builder, dict], None] | None = None) -> bytes:
    """One page for each content stream, all with the font F1; objects are numbered pages' tree first."""
    b = Builder("1.4", media_box)
    f = b.core_font(font)
    resources: dict = {"Font": {"F1": f}}
    if more:
        more(b, resources)
    for c in contents:
        data = b.stream(c, flate=flate)
        d = {"Type": Name("Page"), "Resources": resources, "Contents": data} | ({} if tree else {"MediaBox": list(media_box), "Parent": Ref(2, 0)}) | (page or {})
        ref = b.reserve()
        b.put(ref, d)
        b.pages.append(ref)
    b.info |= info or {}
    if tree:
        b.catalog["Pages"] = holder = b.reserve()
        b.put(holder, {"Type": Name("Pages"), "Kids": b.pages, "Count": len(b.pages)} | tree)
        for p in b.pages:
            b.objects[p.number - 1]["Parent"] = holder
    return b.save()


def image(b: Builder, resources: dict, samples: bytes, width: int, height: int, space: str = "DeviceGray") -> None:
    ref = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": 8, "ColorSpace": Name(space)}, samples))
    resources["XObject"] = {"Im1": ref}


def png(shade: int, width: int, height: int) -> bytes:
    """A grey PNG file of one shade."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))

    rows = (b"\0" + bytes([shade]) * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def spread(table: DataFrame) -> DataFrame:
    """A table's rows over all cores: one of one row group would be one task."""
    return table.repartition(tasks(table.sparkSession))


def files(table: DataFrame, make: Callable[[dict], bytes], key: str) -> DataFrame:
    """(file_id, content): a file for each row, made in Arrow batches from the row's columns.

    Rows are spread over all cores first, since rows are small while files aren't.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            made = [make(dict(zip(names, row, strict=True))) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(names.index(key)).cast(pa.int64()), pa.array(made, pa.binary())], ["file_id", "content"])

    return spread(table).mapInArrow(run, "file_id long, content binary")
