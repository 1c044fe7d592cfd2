"""Reading text columns in Arrow batches of bounded size, and giving memory back when a task ends."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Characters of text that a step holds at once, besides one text that may be longer.
STEP_CHARS = 500_000
#: Bytes of an Arrow batch, where the session doesn't say otherwise: both sides of the pipe hold whole batches.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, for texts of any length. A smaller bound that is set already stays."""
    set_ = spark.conf.get(_BATCH_SETTING, None)
    digits = str(set_ or "").rstrip("bB")
    if not digits.isdigit() or int(digits) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cuts batches into steps of at most so many bytes of text (a longer text is a step of its own); no text is cut."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if pa.types.is_large_string(col.type):
            col = col.cast(pa.string())
        sizes = [x or 0 for x in pc.binary_length(col).to_pylist()]
        at = 0
        while at < len(sizes):
            end, held = at + 1, sizes[at]
            while end < len(sizes) and held + sizes[end] <= most:
                held += sizes[end]
                end += 1
            yield batch.slice(at, end - at), col.slice(at, end - at).to_pylist()
            at = end


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A task's function after which the Python worker gives its freed memory back: workers are reused, also by other stages."""

    @functools.wraps(run)
    def inner(batches):
        yield from run(batches)
        _give_back()

    return inner


def fresh(taken: list[str], name: str) -> str:
    """The name, with underscores put before it until no taken one equals it (upper and lower case are alike to Spark)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def map_rows(docs: DataFrame, keep: list[str], text: str, results: str, rows: Callable[[list[str | None]], list], start: Callable[[], object] | None = None) -> DataFrame:
    """keep's columns and the results' for every row. rows(texts) (or rows(texts, state) with a task's own ``start()``) gives the results' values, a list a column.

    Columns travel under names of their own, so no name of docs can clash; a kept column that is named like a result is left out.
    """
    small_batches(docs.sparkSession)
    out = _parse_datatype_string(results).fields
    names = {f.name.lower() for f in out}
    keep = [c for c in keep if c.lower() not in names or c.lower() == text.lower()]
    kept = [c for c in keep if c.lower() not in names]
    given = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *([] if text in keep else [F.col(f"`{text}`").alias("text")]))
    at = f"c{keep.index(text)}" if text in keep else "text"
    given_fields = {f.name: f for f in given.schema.fields}
    carried = [(f"c{keep.index(c)}", c) for c in kept]
    schema = StructType([given_fields[n] for n, _ in carried] + [StructField(f"r{i}", f.dataType) for i, f in enumerate(out)])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(schema)][len(carried) :]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (start(),) if start else ()
        for batch, texts in steps(batches, at):
            found = rows(texts, *state)
            own = [batch.column(batch.schema.get_field_index(n)) for n, _ in carried]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], [*(n for n, _ in carried), *(f"r{i}" for i in range(len(kinds)))])

    return given.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in carried], *[F.col(f"r{i}").alias(f.name) for i, f in enumerate(out)])
