"""Sources: files by path, as a Spark data source, and as SQL table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import InvalidArgument, LimitError, status
from ..limits import Limits
from ..operators.scan import SCHEMAS, as_batches, file_rows
from .sink import PdfStreamWriter, PdfWriter
from .store import store_of


def files(spark: SparkSession, path: str, limits: Limits = Limits(), glob: str = "*.pdf") -> DataFrame:
    """(file_id, content, size) of the files under a path. Longer files than max_size are left unread: the filter on length reaches the source, and their content is null."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    small = read.where(F.col("length") <= int(min(limits.max_size, 1 << 62))).select(F.col("path").alias("file_id"), "content", F.col("length").alias("size"))
    large = read.where(F.col("length") > int(min(limits.max_size, 1 << 62))).select(F.col("path").alias("file_id"), F.lit(None).cast("binary").alias("content"), F.col("length").alias("size"))
    return small.unionByName(large)


#: Files of a partition at most: opening millions of tiny ones takes longer than reading them.
FILES = 10_000


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.options = schema, options
        self.table = options.get("table", "page_text")
        self.pages = [int(p) for p in options["pages"].split(",")] if options.get("pages") else None

    def pushFilters(self, filters: list) -> Iterator:
        """Takes ``page = n`` where the table has pages and the session lets filters through."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page",) and self.pages is None:
                self.pages = [int(f.value)]
            else:
                yield f

    def partitions(self) -> list[_Files]:
        """Files dealt so that partitions hold like numbers of bytes."""
        from pyarrow import fs

        store, root = store_of(self.options["path"])
        info = store.get_file_info(root)
        found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.lower().endswith(".pdf") and not any(p[:1] in "._" for p in f.path[len(root) :].strip("/").split("/"))]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            held.append(f.path)
            size += f.size
            if size >= 32 << 20 or len(held) >= FILES:
                out.append(_Files(held))
                held, size = [], 0
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.options["path"])
        limits = Limits(**{k: float(self.options[k]) for k in ("max_size", "max_objects", "max_stream", "max_depth", "max_pages") if k in self.options})
        arrow = to_arrow_schema(self.schema)
        options = {"pages": self.pages} if self.pages and self.table in ("tokens", "page_text", "glyphs", "words", "pages", "images") else {}
        passwords, mode = tuple(x for x in (self.options.get("password"),) if x), self.options.get("mode", "PERMISSIVE").upper()

        def found() -> Iterator[tuple[str, int, Iterator[dict]]]:
            for p in partition.paths:
                if store.get_file_info(p).size > limits.max_size:
                    if mode == "FAILFAST":
                        raise LimitError("max_size", limits.max_size)
                    yield p, 0, iter([{"status": status(LimitError("max_size", limits.max_size))}])
                    continue
                with store.open_input_file(p) as f:
                    content = f.read()
                yield p, len(content), file_rows(self.table, content, limits, passwords, mode, options)

        yield from as_batches(found(), arrow, mode)


class PdfDataSource(DataSource):
    """format("pdf"). Reading: option ``table`` names what to read; others are ``pages``, ``password``, ``mode`` and the limits. Writing (file_id, content): see ``sink``."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        table = self.options.get("table", "page_text")
        if table not in SCHEMAS:
            raise InvalidArgument(f"no table {table}", arg="table")
        return f"file_id string, {SCHEMAS[table]}"

    def reader(self, schema: StructType) -> PdfReader:
        return PdfReader(schema, self.options)

    def _held(self, schema: StructType) -> dict:
        if not {"file_id", "content"} <= set(schema.names):
            raise InvalidArgument("files are written from the columns file_id and content", arg="schema")
        return dict(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PdfWriter:
        return PdfWriter(self._held(schema), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> PdfStreamWriter:  # noqa: N802
        return PdfStreamWriter(self._held(schema), overwrite)


def register(spark: SparkSession) -> None:
    """format("pdf") and the table functions pdf_tokens(content), pdf_words(content), pdf_page_text(content) and so on, for LATERAL joins."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # page filters reach the reader
    spark.dataSource.register(PdfDataSource)
    for table in ("tokens", "page_text", "glyphs", "words", "pages", "meta", "fonts", "images", "toc", "objects"):
        spark.udtf.register(f"pdf_{table}", _function(table))


def _function(table: str):
    names = [f.split()[0] for f in SCHEMAS[table].split(", status ")[0].split(", ")]

    class Rows:
        def eval(self, content: bytes):
            for row in file_rows(table, content, Limits(), (), "FAILFAST", {}):
                yield tuple(row.get(n) for n in names)

    return udtf(Rows, returnType=SCHEMAS[table].split(", status ")[0])
