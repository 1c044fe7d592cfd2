"""Writing operators: rows of drawing operations to files, and pages of files to new files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from ..errors import STATUS, InvalidArgument, LimitError, status
from ..functions.scalars import text_width
from ..kernel import serialize as S
from ..kernel.embed import add_subset, add_truetype, image
from ..kernel.syntax import File
from ..kernel.values import Ref
from ..limits import Limits
from .scan import BATCH, BATCH_BYTES, FAILURES, tasks

OPS = "page int, seq int, op string, nums array<double>, str string"


def check_ops(ops: DataFrame) -> DataFrame:
    """Operations with a wrong number of numbers, for callers who want to see them before writing."""
    arity = F.create_map(*[F.lit(x) for kv in S.ARITY.items() for x in kv])
    return ops.where(F.coalesce(arity[F.col("op")] != F.size("nums"), F.lit(True)))


def draw_text(page: Column, seq: Column, text: Column, x: Column, y: Column, font: str = "Courier", size: float = 12.0, align: float = 0.0, line_height: float = 1.2) -> Column:
    """An array of text operations, one a line. align: 0 left, 0.5 middle, 1 right, by the width of the line in the core font."""
    if align and font in ("Symbol", "ZapfDingbats"):
        raise InvalidArgument(f"{font} has no widths to align by", arg="align")

    def line(s: Column, i: Column) -> Column:
        left = x - text_width(s, font, size) * align if align else x
        return F.struct(page.cast("int").alias("page"), (seq + i).cast("int").alias("seq"), F.lit("text").alias("op"), F.array(left.cast("double"), (y - i * (size * line_height)).cast("double"), F.lit(float(size)), F.lit(1.0), F.lit(0.0)).alias("nums"), F.concat(F.lit(font + "\t"), s).alias("str"))

    return F.transform(F.split(text, "\n"), line)


def draw(page: Column, seq: Column, op: str, *nums: Column | float) -> Column:
    """One operation as a row."""
    if op not in S.ARITY or len(nums) != S.ARITY[op]:
        raise InvalidArgument(f"{op} takes {S.ARITY.get(op)} numbers", arg="op")
    return F.struct(page.cast("int").alias("page"), seq.cast("int").alias("seq"), F.lit(op).alias("op"), F.array(*[(n if isinstance(n, Column) else F.lit(n)).cast("double") for n in nums]).cast("array<double>").alias("nums"), F.lit(None).cast("string").alias("str"))


def build(ops: list[tuple], *, version: str = "1.7", media_box=S.A4, created: int | None = None, deterministic: bool = True, meta: dict | None = None, encryption: dict | None = None, images: dict[str, bytes] | None = None, fonts: dict[str, bytes] | None = None) -> bytes:
    """A file of (page, seq, op, nums, str) operations; pages in their order, without gaps for numbers left out.

    images and fonts: PNG or JPEG files and TrueType files by the names that operations use; each that is used goes into the file once. A font whose texts
    go beyond code page 1252 is embedded as the glyphs that they need, any other one whole.
    """
    b = S.Builder(version, media_box, created, deterministic)
    if encryption:
        b.encrypt(**encryption)
    b.describe(**(meta or {}))
    placed: dict[str, Ref] = {}
    by: dict[int, list] = {}
    for page, seq, op, nums, text in sorted(ops, key=lambda o: (o[0], o[1])):
        by.setdefault(page, []).append((op, list(nums), text))
    codes: dict[str, dict[int, int]] = {}
    said: dict[str, set[int]] = {}
    for _, _, op, _, text in ops:
        if op == "text":
            font, _, shown = (text or "").partition("\t")
            said.setdefault(font, set()).update(map(ord, shown))
    for page in sorted(by):
        used = sorted({(t or "").partition("\t")[0] for op, _, t in by[page] if op == "text"})
        names = {f: f"F{i}" for i, f in enumerate(used, 1)}
        for f in used:
            if f not in b.fonts and f in (fonts or {}):
                if "".join(map(chr, said[f])).encode("cp1252", "ignore").decode("cp1252") == "".join(map(chr, said[f])):
                    b.fonts[f] = add_truetype(b, fonts[f])[0]
                else:
                    b.fonts[f], subset = add_subset(b, fonts[f], said[f])
                    codes[f] = subset.codes
        res = {"Font": {names[f]: b.fonts[f] if f in b.fonts else b.core_font(f) for f in used}} if used else {}
        for name in sorted({t for op, _, t in by[page] if op == "image"}):
            if name not in (images or {}):
                raise InvalidArgument(f"no image {name}", arg="images")
            if name not in placed:
                placed[name] = b.add(image(images[name]))
            res.setdefault("XObject", {})[name] = placed[name]
        b.page(S.content_of(by[page], names, codes), res)
    return b.save()


def write(ops: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """ops (doc_id, page, seq, op, nums, str) -> (file_id, content). ``meta`` (title, author, subject, keywords, creator, language, modified) applies to all; a column ``title`` of ops goes into its file.

    Rows are sorted by document and streamed, so a task holds one document at a time, and files of some MB that go on together.
    """
    titled = "title" in ops.columns
    cols = [F.col(doc_id).alias("file_id"), "page", "seq", "op", "nums", "str", *(["title"] if titled else [])]
    # By their bytes, operations would be few tasks; files are much more work than their operations are long.
    given = ops.select(*cols).repartition(tasks(ops.sparkSession), "file_id").sortWithinPartitions("file_id", "page", "seq")
    schema = StructType().add("file_id", given.schema["file_id"].dataType).add("content", "binary")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, title, none = [], None, object()
        now, ids, files, size = none, [], [], 0

        def done() -> None:
            extra = {"meta": (options.get("meta") or {}) | {"title": title}} if titled else {}
            ids.append(now)
            files.append(build(held, **(options | extra)))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, arrow[0].type), pa.array(files, arrow[1].type)], schema=arrow)

        for b in batches:
            for row in b.to_pylist():
                if now is not none and row["file_id"] != now:
                    done()
                    held, size = [], size + len(files[-1])
                    if len(ids) >= BATCH or size >= BATCH_BYTES:
                        yield batch()
                        ids, files, size = [], [], 0
                now, title = row["file_id"], row.get("title")
                held.append((row["page"], row["seq"], row["op"], row["nums"], row["str"]))
        if now is not none:
            done()
            yield batch()

    return given.mapInArrow(run, schema)


def save(files: DataFrame, path: str, **options) -> None:
    """Writes (file_id, content) as one file each under a folder that executors reach, all or none: ``sources.sink.save``."""
    from ..sources import sink

    sink.save(files, path, **options)


# --- assembly --------------------------------------------------------------------------------------------------------------------
# Every result is (file_id, content, status): where a part can't be read, content is null and status says why; FAILFAST raises instead.

def _result(id_type) -> tuple[StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType().add("file_id", id_type).add("content", "binary").add("status", _parse_datatype_string(STATUS))
    return schema, to_arrow_schema(schema)


def _add(b: S.Builder, f: File, pages: list[int] | None, turns: list[int | None] | None) -> None:
    """Copies pages of a file (all by default) and turns each by its own entry of turns, or the last one."""
    wanted = pages if pages is not None else list(range(1, len(f.pages()) + 1))
    first = len(b.pages)
    S.copy_pages(b, f, wanted)
    for ref, p in zip(b.pages[first:], wanted, strict=True):
        if turns:
            turn(b, ref, turns[min(p, len(turns)) - 1])


def _assemble(parts: DataFrame, limits: Limits, passwords: tuple[str, ...], mode: str = "PERMISSIVE") -> DataFrame:
    """parts (file_id, ord, content) -> (file_id, content, status): the parts' pages in their order."""
    given = parts.repartition("file_id").sortWithinPartitions("file_id", "ord")
    schema, arrow = _result(parts.schema["file_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, b, failed = none, None, None

        def done() -> pa.RecordBatch:
            try:
                row = {"content": None if failed else b.save(), "status": status(failed)}
            except FAILURES as e:
                if mode == "FAILFAST":
                    raise
                row = {"status": status(e)}
            return pa.RecordBatch.from_pylist([{"file_id": now} | row], arrow)

        for batch in batches:
            for row in batch.to_pylist():
                if now is none or row["file_id"] != now:
                    if now is not none:
                        yield done()
                    now, b, failed = row["file_id"], S.Builder(), None
                try:
                    if not failed:
                        _add(b, _opened(row["content"], limits, passwords), None, None)
                except FAILURES as e:
                    if mode == "FAILFAST":
                        raise
                    failed = e
        if now is not none:
            yield done()

    return given.mapInArrow(run, schema)


def _opened(content: bytes | None, limits: Limits, passwords: tuple[str, ...]) -> File:
    if content is None:
        raise InvalidArgument("content is null", arg="content")
    if len(content) > limits.max_size:
        raise LimitError("max_size", limits.max_size)
    return File(content, limits, passwords)


def _each(files: DataFrame, plan: Callable[[File], Iterator[tuple[int | None, list[int] | None, list[int | None] | None]]], limits: Limits = Limits(), passwords: tuple[str, ...] = (), mode: str = "PERMISSIVE", named: bool = False) -> DataFrame:
    """A file is opened where it lies, once, and becomes the files that plan(file) says, each (number, pages, turns); nothing is shuffled. named: ids are ``<file_id>_<number>``."""
    schema, arrow = _result(StringType() if named else files.schema["file_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, number = batch.column(0)[i].as_py(), None
                name = lambda n: f"{key}_{n}" if named and n is not None else str(key) if named and key is not None else key  # noqa: E731,B023
                try:
                    f = _opened(batch.column(1)[i].as_py(), limits, passwords)
                    for number, pages, turns in plan(f):
                        b = S.Builder()
                        _add(b, f, pages, turns)
                        yield pa.RecordBatch.from_pylist([{"file_id": name(number), "content": b.save(), "status": status()}], arrow)
                except FAILURES as e:
                    if mode == "FAILFAST":
                        raise
                    yield pa.RecordBatch.from_pylist([{"file_id": name(number), "status": status(e)}], arrow)

    return files.select("file_id", "content").mapInArrow(run, schema)


def turn(b: S.Builder, ref: Ref, by: int | None) -> None:
    """Adds to a page's rotation; None leaves it, and a number with 1000 added sets it."""
    if by is None:
        return
    d = b.objects[ref.number - 1]
    old = d.get("Rotate") or 0
    d["Rotate"] = (by - 1000) % 360 if by >= 1000 else (int(old) + by) % 360


def copy_pages(files: DataFrame, pages: list[int] | None = None, rotate: int = 0, **options) -> DataFrame:
    """Chosen pages (all by default), in the order given, repeats allowed, each turned further by ``rotate``."""
    if rotate % 90:
        raise InvalidArgument("rotation goes by 90 degrees", arg="rotate")
    return _each(files, lambda f: iter([(None, pages, [rotate] if rotate else None)]), **options)


def chosen(n: int, pages: list[int]) -> list[int]:
    """Page numbers that an index means: positive ones in order, or all but negative ones."""
    return list(pages) if pages[0] > 0 else [p for p in range(1, n + 1) if -p not in pages]


def subset(files: DataFrame, pages: list[int], **options) -> DataFrame:
    if not pages or 0 in pages or (min(pages) < 0 < max(pages)):
        raise InvalidArgument("pages must be all positive or all negative", arg="pages")
    return _each(files, lambda f: iter([(None, chosen(len(f.pages()), pages), None)]), **options)


def split(files: DataFrame, **options) -> DataFrame:
    """One file a page, named ``<file_id>_<page>``."""
    return _each(files, lambda f: ((p, [p], None) for p in range(1, len(f.pages()) + 1)), named=True, **options)


def combine(files: DataFrame, into: Column, order: Column, limits: Limits = Limits(), passwords: tuple[str, ...] = (), mode: str = "PERMISSIVE") -> DataFrame:
    """Files of one group ``into`` one after the other by ``order``."""
    return _assemble(files.select(into.alias("file_id"), order.cast("long").alias("ord"), "content"), limits, passwords, mode)


def rotate_pages(files: DataFrame, pages: list[int], angle: int = 90, relative: bool = False, **options) -> DataFrame:
    """Sets, or adds to, the rotation of chosen pages; the others stay as they are."""
    if angle % 90:
        raise InvalidArgument("rotation goes by 90 degrees", arg="angle")
    by = [angle % 360 + (0 if relative else 1000) if p in pages else None for p in range(1, max(pages) + 2)]
    return _each(files, lambda f: iter([(None, None, by)]), **options)


def encrypt(files: DataFrame, secrets: DataFrame, limits: Limits = Limits(), passwords: tuple[str, ...] = (), mode: str = "PERMISSIVE") -> DataFrame:
    """files (file_id, content) with secrets (file_id, user, owner, method, permissions: any but the id may be missing or null) -> (file_id, content, status): each file's pages and information under its own passwords.

    Passwords are columns, so no plan says them. A file without a row in secrets stays as it is; one with several takes the least of them. method is aes128 (by default) or rc4128; permissions are names, all by default.
    """
    kinds = {"user": "string", "owner": "string", "method": "string", "permissions": "array<string>"}
    fields = [(F.col(c) if c in secrets.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    mine = secrets.groupBy(F.col("file_id").alias("_f")).agg(F.min(F.struct(*fields)).alias("secret"))
    given = files.select("file_id", "content").join(mine, F.col("file_id").eqNullSafe(F.col("_f")), "left").select("file_id", "content", "secret")
    schema, arrow = _result(files.schema["file_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, data, secret = (batch.column(c)[i].as_py() for c in range(3))
                try:
                    row = {"content": data, "status": status()}
                    if secret is not None:
                        f = _opened(data, limits, passwords)
                        b = S.Builder()
                        b.encrypt(secret["user"] or "", secret["owner"] or "", secret["method"] or "aes128", secret["permissions"])
                        S.copy_pages(b, f, list(range(1, len(f.pages()) + 1)))
                        b.info |= {k: v for k, v in f.dict_of(f.trailer.get("Info")).items() if isinstance(v, (bytes, str))}
                        row["content"] = b.save()
                except FAILURES as e:
                    if mode == "FAILFAST":
                        raise
                    row = {"content": None, "status": status(e)}
                yield pa.RecordBatch.from_pylist([{"file_id": key} | row], arrow)

    return given.mapInArrow(run, schema)


def deterministic_id(content: Column) -> Column:
    """The 32 hexadecimal digits of a written file's id, by columns."""
    return F.lower(F.regexp_extract(F.decode(F.substring(content, -200, 200), "ISO-8859-1"), r"/ID \[<([0-9A-Fa-f]{32})>", 1))
