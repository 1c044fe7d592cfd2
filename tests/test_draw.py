"""Drawing by columns against the sequential writer, byte for byte, and paths against their rules."""

import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from folio.functions import scalars
from folio.kernel.fonts import CORE
from folio.kernel.serialize import text_width
from folio.operators import documents as D
from folio.operators import draw as P
from folio.operators import write as W
from folio.operators.graph import Tables
from folio.plans import catalogue

OPS = "doc_id int, page int, seq int, op string, nums array<double>, str string"
TEXTS = ["plain", "par(en)s \\ and \r\n", "Ünï € ‚„… Ωmega 😀 \x85\x9f", "þÿ starts", "tab\tinside", "", "ÿ"]


def png(shade: int) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))
    rows = b"".join(b"\0" + bytes([shade] * 3) for _ in range(2))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def operations():
    rows = []
    for doc in (1, 2, None):
        for page in (3, 1, 7):
            at = 0
            for i, t in enumerate(TEXTS):
                font = ["Courier", "Helvetica", "Times-Bold", "Symbol"][(i + page + (doc or 0)) % 4]
                rows.append((doc, page, at := at + 1, "text", [10.5, 20.0 + i, 12.0, math.cos(i / 7), math.sin(i / 7)], f"{font}\t{t}"))
            for op, nums in (("save", []), ("fill_rgb", [0, 0.5, 1]), ("stroke_rgb", [1 / 3, 2 / 3, 0.1]), ("line_width", [0.0]), ("move", [-0.0, 1e6]), ("line", [0.1234567, -5.0]), ("curve", [1, 2, 3, 4, 5, 6.25]), ("close", []), ("rect", [1, 2, 3, 4]), ("paint", [2, 1]), ("restore", [])):
                rows.append((doc, page, at := at + 1, op, [float(x) for x in nums], None))
    return rows


def test_same_bytes_as_the_sequential_writer(spark):
    ops = spark.createDataFrame(operations(), OPS).repartition(3)
    want = {r["file_id"]: bytes(r["content"]) for r in W.write(ops).collect()}
    got = {r["file_id"]: (bytes(r["content"]), r["status"]["status"]) for r in P.write(ops).collect()}
    assert got == {k: (v, "ok") for k, v in want.items()} and len(got) == 3


def test_images_and_metadata(spark):
    ops = [(d, p, s, "image", [1.0, 2.0, 30.0, 40.0, 0.0], n) for d, p, s, n in ((1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "a"), (2, 1, 1, "b"))] + [(2, 1, 2, "text", [1.0, 2.0, 12.0, 1.0, 0.0], "Courier\tx")]
    files = {"a": png(10), "b": png(200), "unused": b"none"}
    frame = spark.createDataFrame(ops, OPS)
    meta = spark.createDataFrame([(1, "Tïtle", "A (b) \\", None, 86399, 32535215999), (2, None, None, None, None, None)], "doc_id int, title string, author string, subject string, created long, modified long")
    got = {r["file_id"]: bytes(r["content"]) for r in P.write(frame, images=spark.createDataFrame(list(files.items()), "name string, data binary"), meta=meta).collect()}
    of = lambda d: [o[1:] for o in ops if o[0] == d]
    assert got == {1: W.build(of(1), images=files, meta={"title": "Tïtle", "author": "A (b) \\", "modified": 32535215999}, created=86399), 2: W.build(of(2), images=files)}


def test_times_to_the_end_of_9999(spark):
    times = {1: 0, 2: 32535216000, 3: 899_999 * 86461 + 1, 4: 253402300799, 5: 253402300800, 6: -1}
    ops = spark.createDataFrame([(d, 1, 1, "save", [], None) for d in times], OPS)
    made = P.write(ops, meta=spark.createDataFrame(list(times.items()), "doc_id int, created long"))
    bad = {r["file_id"]: r["status"]["message"] for r in made.where("content is null").collect()}
    assert bad == {d: "created must be a time from 1970 to the end of 9999" for d in (5, 6)}
    got = {r["file_id"]: r["t"] for r in D.meta(made.where("content is not null").select("file_id", "content")).select("file_id", F.unix_timestamp("created").alias("t")).collect()}
    # A time of 0 is read as none.
    assert got == {d: t or None for d, t in times.items() if d < 5}


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of the tables written from here on."""
    said, put = [], Tables.put
    monkeypatch.setattr(Tables, "put", lambda self, df, name: (said.append(df._jdf.queryExecution().executedPlan().toString()), put(self, df, name))[1])
    return said


def test_nothing_as_long_as_the_documents_is_broadcast(spark, plans):
    ops = spark.createDataFrame([(d, 1, 1, "text", [1.0, 2.0, 12.0, 1.0, 0.0], "Courier\tx") for d in (1, 2)] + [(3, 1, 1, "ring", [], None)], OPS)
    meta = spark.createDataFrame([(1, "a")], "doc_id int, title string")
    boxes = spark.createDataFrame([(1, 1, [0.0, 0.0, 9.0, 9.0])], "doc_id int, page int, media_box array<double>")
    good = P.write(ops.where("doc_id < 3"), pages=boxes, meta=meta)
    for plan in [*plans, good._jdf.queryExecution().executedPlan().toString()]:
        assert "Broadcast" not in plan
    # The few documents that failed may be sent to all tasks.
    assert {r["file_id"]: r["status"]["class"] for r in P.write(ops, pages=boxes, meta=meta).collect()} == {1: None, 2: None, 3: "write_error"}


def test_images_are_broadcast_by_their_bytes(spark, monkeypatch, plans):
    frame = spark.createDataFrame([(d, 1, 1, "image", [1.0, 2.0, 30.0, 40.0, 0.0], f"i{d}") for d in (1, 2)], OPS)
    files = {f"i{d}": png(d) for d in (1, 2)}
    images = spark.createDataFrame(list(files.items()), "name string, data binary")
    joins = lambda: [x for plan in plans for x in plan.splitlines() if "BroadcastHashJoin" in x]
    P.write(frame, images=images)
    assert joins() and all("name#" in x for x in joins())
    plans.clear()
    monkeypatch.setattr(P, "FEW_BYTES", 1)
    many = P.write(frame, images=images)
    assert not joins()
    want = {d: W.build([(1, 1, "image", [1.0, 2.0, 30.0, 40.0, 0.0], f"i{d}")], images=files) for d in (1, 2)}
    assert {r["file_id"]: bytes(r["content"]) for r in many.collect()} == want


def test_both_writers_are_joined_by_sorting(spark, tmp_path):
    spark.createDataFrame([(k, f"part {k}", 7) for k in range(3)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = catalogue.QUERIES["draw_same_bytes"](spark, str(tmp_path))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_pages(spark):
    ops = spark.createDataFrame([(1, 1, 1, "text", [1.0, 2.0, 12.0, 1.0, 0.0], "Courier\tx")], OPS)
    pages = spark.createDataFrame([(1, 1, [0.0, 0.0, 100.5, 200.0], [0.0, 0.0, 50.0, 60.0], 450), (1, 2, None, None, None), (5, 1, [0.0, 0.0, 9.0, 9.0], None, -90)], "doc_id int, page int, media_box array<double>, crop_box array<double>, rotate int")
    made = P.write(ops, pages=pages)
    got = sorted((r["file_id"], r["page"], r["width"], r["height"], r["rotate"], r["streams"], tuple(r["media_box"])) for r in D.pages(made).collect())
    assert got == [(1, 1, 50.0, 60.0, 90, 1, (0, 0, 100.5, 200)), (1, 2, 595.28, 841.89, 0, 0, (0, 0, 595.28, 841.89)), (5, 1, 9.0, 9.0, 270, 0, (0, 0, 9, 9))]


@pytest.mark.parametrize("op, nums, text, says", [("rect", [1.0], None, "rect takes 4 numbers"), ("ring", [], None, "no operation ring"), (None, [], None, "no operation null"), ("line", [1.0, math.nan], None, "line needs finite numbers"), ("move", None, None, "move takes 2 numbers"), ("paint", [3.0, 0.0], None, "paint takes"), ("text", [1.0] * 5, "Comic\tx", "no core font Comic"), ("image", [1.0] * 5, "gone", "image gone: not there"), ("image", [1.0] * 5, "a b", "an image needs a name")])
def test_one_bad_operation_spoils_its_document_only(spark, op, nums, text, says):
    rows = [(1, 1, 1, "save", [], None), (1, 1, 2, op, nums, text), (2, 1, 1, "save", [], None)]
    got = {r["file_id"]: r for r in P.write(spark.createDataFrame(rows, OPS)).collect()}
    assert got[1]["content"] is None and got[1]["status"]["class"] == "write_error" and got[1]["status"]["message"].startswith(says)
    assert got[2]["content"] is not None and got[2]["status"]["class"] is None


PATHS = f"id int, path {P.PATH}, fill string, stroke string, width double"


def rows_of(*ops):
    return [dict(zip(("op", "x", "y", "x1", "y1", "x2", "y2", "w", "h"), o, strict=False)) for o in ops]


def drawn(spark, rows, **options):
    df = spark.createDataFrame(rows, PATHS)
    out = df.select("id", F.explode(P.draw_path(F.lit(1), F.lit(10), F.col("path"), fill=F.col("fill"), stroke=F.col("stroke"), width=F.col("width"), **options)).alias("o")).select("id", "o.*")
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["id"], r["seq"])):
        got.setdefault(r["id"], []).append((r["op"], list(r["nums"]), r["str"]))
    return got


def test_paths(spark):
    path = rows_of(("move", 1.0, 2.0), ("line", 3.0, 4.0), ("curve", 5.0, 6.0, 1.0, 1.5, 2.0, 2.5), ("close",), ("rect", 7.0, 8.0, None, None, None, None, 9.0, 10.0))
    steps = [("move", [1, 2], None), ("line", [3, 4], None), ("curve", [1, 1.5, 2, 2.5, 5, 6], None), ("close", [], None), ("rect", [7, 8, 9, 10], None)]
    got = drawn(spark, [(1, path, None, None, 1.0), (2, path, "#ff0000", None, 2.0), (3, path, None, "blue", 0.0), (4, path, "white", "black", 1.0)], rule="evenodd")
    around = lambda colours, width, paint: [("save", [], None), *colours, ("line_width", [width], None), *steps, ("paint", paint, None), ("restore", [], None)]
    assert got[1] == around([("stroke_rgb", [0, 0, 0], None)], 1, [0, 1])
    assert got[2] == around([("fill_rgb", [1, 0, 0], None)], 2, [2, 0])
    assert got[3] == around([("stroke_rgb", [0, 0, 1], None)], 0, [0, 1])
    assert got[4] == around([("fill_rgb", [1, 1, 1], None), ("stroke_rgb", [0, 0, 0], None)], 1, [2, 1])
    assert drawn(spark, [(1, path, "red", None, 1.0)])[1][-2] == ("paint", [1, 0], None)


def test_path_faults(spark):
    ok = rows_of(("move", 1.0, 2.0), ("line", 3.0, 4.0))
    bad = [(None, None, 1.0), ([], None, 1.0), (rows_of(("line", 1.0, 2.0)), None, 1.0), (rows_of(("move", 1.0, None)), None, 1.0), (rows_of(("move", 1.0, 2.0), ("rect", 1.0, 2.0)), None, 1.0), (rows_of(("move", 1.0, math.inf)), None, 1.0), (rows_of(("arc", 1.0, 2.0)), None, 1.0), (ok, "no colour at all", 1.0), (ok, None, -1.0), (ok, None, None)]
    got = drawn(spark, [(i, p, f, None, w) for i, (p, f, w) in enumerate(bad)])
    assert all([o[0] for o in ops] == ["fault"] and ops[0][2] for ops in got.values()) and len(got) == len(bad)


def test_points(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), (2, [1.0], [1.0]), (3, [1.0, 2.0], [1.0])], "id int, x array<double>, y array<double>")
    got = {r["id"]: r["p"] and [(s["op"], s["x"], s["y"]) for s in r["p"]] for r in df.select("id", P.points(F.col("x"), F.col("y"), close=True).alias("p")).collect()}
    assert got == {1: [("move", 1, 4), ("line", 2, 5), ("line", 3, 6), ("close", None, None)], 2: None, 3: None}


def test_the_sequential_writer_works_in_many_tasks(spark):
    ops = spark.range(200).select(F.col("id").alias("doc_id"), F.explode(W.draw_text(F.lit(1), F.lit(1), F.col("id").cast("string"), F.lit(1.0), F.lit(2.0), font="Times-Roman", align=0.5)).alias("o")).select("doc_id", "o.*")
    made = W.write(ops)
    assert made.select(F.spark_partition_id()).distinct().count() > 1
    said = {r["file_id"]: r["text"] for r in D.page_text(made).collect()}
    assert said == {i: str(i) for i in range(200)}


def test_widths_of_ascii_and_other_characters(spark):
    text = "aZ0~ €é—Δ"
    df = spark.createDataFrame([(text,)], "t string")
    for font in CORE:
        got = df.select(scalars.text_width(F.col("t"), font, 10.0)).first()[0]
        assert got == pytest.approx(text_width(text, font, 10.0))
