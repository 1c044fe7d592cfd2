from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.errors import InvalidArgument
from folio.functions import scalars
from folio.kernel.serialize import Builder
from folio.limits import Limits
from folio.operators import documents as D
from folio.operators import write as W
from folio.operators.scan import scan
from folio.plans.synth import pdf, shown
from folio.sources import pdf as source
from folio.streaming.pdf import stream_table


@pytest.fixture()
def folder(tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pdf").write_bytes(pdf(shown(f"file {i}"), shown("two")))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("no PDF")
    return tmp_path


def named(rows):
    return sorted((Path(r["file_id"].removeprefix("file:")).name, r["page"], r["text"]) for r in rows if r["page"])


def test_files_by_path(spark, folder):
    t = D.page_text(source.files(spark, str(folder)))
    assert named(t.collect())[:2] == [("0.pdf", 1, "file 0"), ("0.pdf", 2, "two")]
    assert t.where("status.class = 'parse_error'").count() == 1


def test_size_limit_leaves_content_unread(spark, folder):
    limits = Limits(max_size=100)
    got = D.page_text(source.files(spark, str(folder), limits), limits=limits).collect()
    assert {r["status"]["class"] for r in got} == {"limit_error", "parse_error"}


def test_data_source(spark, folder):
    source.register(spark)
    t = spark.read.format("pdf").option("table", "page_text").option("pages", "1").load(str(folder))
    assert named(t.collect()) == [(f"{i}.pdf", 1, f"file {i}") for i in range(3)]
    assert spark.read.format("pdf").option("table", "meta").load(str(folder)).where("pages = 2").count() == 3
    second = spark.read.format("pdf").load(str(folder)).where("page = 2")
    assert named(second.collect()) == [(f"{i}.pdf", 2, "two") for i in range(3)]


def test_table_functions(spark, folder):
    source.register(spark)
    source.files(spark, str(folder), glob="[0-9].pdf").createOrReplaceTempView("files")
    got = spark.sql("SELECT w.text FROM files, LATERAL pdf_words(content) w WHERE w.page = 1 ORDER BY 1").collect()
    assert [r["text"] for r in got] == ["0", "1", "2", "file", "file", "file"]


def test_stream(spark, folder, tmp_path_factory):
    q = stream_table(spark, str(folder)).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path_factory.mktemp("c"))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT * FROM streamed WHERE page = 2 AND text = 'two'").count() == 3


def test_failures_are_rows_or_raised(spark):
    files = spark.createDataFrame([(1, bytearray(pdf(shown("x")))), (2, None), (3, bytearray(b""))], "file_id int, content binary")
    got = {r["file_id"]: r["status"]["class"] for r in D.page_text(files).collect()}
    assert got == {1: None, 2: "invalid_argument", 3: "parse_error"}
    with pytest.raises(Exception, match="not a PDF"):
        D.page_text(files.where("file_id = 3"), mode="FAILFAST").collect()
    good, bad = D.split_status(D.page_text(files))
    assert (good.count(), bad.count()) == (1, 2)


def test_arguments_are_checked_before_a_plan(spark):
    files = spark.createDataFrame([], "file_id int, content binary")
    for bad in ({"table": "none"}, {"table": "pages", "mode": "x"}, {"table": "page_text", "pages": [0]}, {"table": "page_text", "layout": "x"}):
        with pytest.raises(InvalidArgument):
            scan(files, **bad)
    assert D.page_text(files).count() == 0


def test_saved_files_read_back(spark, tmp_path):
    files = spark.createDataFrame([(1, bytearray(pdf(shown("saved"))))], "file_id int, content binary")
    W.save(files, str(tmp_path / "out"))
    assert [r["text"] for r in D.page_text(source.files(spark, str(tmp_path / "out"))).collect()] == ["saved"]


def test_deref_joins_within_a_file(spark):
    o = D.objects(spark.createDataFrame([(1, bytearray(pdf(shown("x"))))], "file_id int, content binary"))
    pages = o.where("type = 'Page'").select("file_id", F.expr("variant_get(value, '$.dict.Contents.ref', 'bigint')").alias("ref"))
    assert D.deref(pages, o).where("target is not null").count() == 1


def test_password_by_option(spark):
    b = Builder()
    b.encrypt("user", "owner")
    b.page(b"", {})
    files = spark.createDataFrame([(1, bytearray(b.save()))], "file_id int, content binary")
    assert D.length(files, passwords=("owner",)).collect()[0]["length"] == 1


def test_scalars(spark):
    row = spark.range(1).select(scalars.text_width(F.lit("Hello"), "Helvetica", 10).alias("w"), scalars.rgb(F.lit("#ff0000")).alias("c"), scalars.rgb(F.lit("none")).alias("n"), *(scalars.rgb(F.lit(c)).alias(c) for c in ("gray0", "grey51", "gray100", "gray101")), scalars.clamp_int(F.lit(1e12)).alias("i"), scalars.rotation(F.lit(-90.0)).alias("r")).collect()[0]
    assert row["w"] == pytest.approx(22.78) and row["c"] == [1.0, 0.0, 0.0] and row["n"] is None and row["i"] == 2147483647 and row["r"] == 270
    assert [row[c] and round(row[c][0] * 255) for c in ("gray0", "grey51", "gray100", "gray101")] == [0, 130, 255, None]


def test_engine_info_and_nested_outline(spark):
    assert "words" in D.engine_info(spark).collect()[0]["tables"]
    toc = spark.createDataFrame([(1, 1, None, 0, "A", True), (1, 2, 1, 1, "B", False), (1, 3, 2, 2, "C", False), (1, 4, None, 0, "D", False)], "file_id int, item int, parent int, depth int, title string, is_open boolean")
    assert [x["path"] for x in D.nested_toc(toc).collect()[0]["toc"]] == [["A"], ["A", "B"], ["A", "B", "C"], ["D"]]
