"""The transactional sink: names, all or none, recovery, streams."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.errors import InvalidArgument, IoError, WriteError
from folio.sources import pdf, sink
from folio.sources.store import LONGEST_NAME, safe_name, store_of

ROOT = str(Path(__file__).resolve().parent.parent)


def rows(spark, ids, tag="x"):
    return spark.createDataFrame([(str(i), f"{tag}{i}".encode()) for i in ids], "file_id string, content binary").repartition(3)


def seen(path):
    """What anyone sees in the folder: names and contents, without what lies under hidden folders."""
    return {p.name: p.read_bytes() for p in Path(path).glob("*") if p.is_file() and p.name[0] not in "._"} if Path(path).exists() else {}


def batch(ids, tag="x"):
    return pa.RecordBatch.from_pydict({"file_id": [str(i) for i in ids], "content": [f"{tag}{i}".encode() for i in ids]})


def test_safe_names():
    keys = ["a", "A/b", "../../etc/passwd", "..", ".", "_x", ".hidden", "é", "a b", "a%20b", "", "x" * 500, "x" * 501, "~", 7, -1.5, "line\nbreak", "\\", "a:b", "é" * 100]
    names = {k: safe_name(k) for k in keys if k != ""}
    assert len(set(names.values())) == len(names)
    for n in names.values():
        assert len(n) <= LONGEST_NAME and "/" not in n and n[0] not in "._" and n.endswith(".pdf") and n.isascii()
    assert names["a"] == "a.pdf" and names["A/b"] == "A%2Fb.pdf" and names[7] == "7.pdf"
    for k in ("", None):
        with pytest.raises(InvalidArgument):
            safe_name(k)


def test_store_paths():
    assert store_of("/a/b")[1] == "/a/b" and store_of("file:///a/b")[1] == "/a/b"


def test_batch_write(spark, tmp_path):
    pdf.register(spark)
    at = str(tmp_path / "out")
    rows(spark, ["1", "a/b", "..", "é"]).write.format("pdf").mode("append").option("job", "j").save(at)
    assert seen(at) == {safe_name(i): f"x{i}".encode() for i in ("1", "a/b", "..", "é")}
    told = sink.committed(spark, at).collect()
    assert {(r["job"], r["file_id"], r["name"], r["size"]) for r in told} == {("j", i, safe_name(i), len(f"x{i}".encode())) for i in ("1", "a/b", "..", "é")}
    # The job is committed: nothing is written again.
    rows(spark, ["1", "2"], "y").write.format("pdf").mode("append").option("job", "j").save(at)
    assert "2.pdf" not in seen(at) and seen(at)["1.pdf"] == b"x1"


@pytest.mark.parametrize("how", ["write", "save"])
def test_refusals_leave_nothing(spark, tmp_path, how):
    pdf.register(spark)
    at = str(tmp_path / "out")
    put = (lambda df, **o: sink.save(df, at, **o)) if how == "save" else (lambda df, **o: df.write.format("pdf").mode("append").options(**o).save(at))
    put(rows(spark, range(3)), job="first")
    before = seen(at)
    assert len(before) == 3
    with pytest.raises(Exception, match="one name|are named"):
        put(rows(spark, [7, 8]).unionAll(rows(spark, [8], "z")))
    with pytest.raises(Exception, match="already there: 2.pdf"):
        put(rows(spark, [2, 9]))
    with pytest.raises(Exception, match="no content"):
        put(rows(spark, [10, 11]).withColumn("content", F.when(F.col("file_id") != "11", F.col("content"))))
    bad = F.udf(lambda x: b"" if x != "13" else 1 / 0, "binary")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        put(rows(spark, [12, 13, 14]).withColumn("content", bad("file_id")))
    assert seen(at) == before
    assert {r["file_id"] for r in sink.committed(spark, at).collect()} == {"0", "1", "2"}


def test_overwrite_and_skipped(spark, tmp_path):
    at = str(tmp_path / "out")
    sink.save(rows(spark, [1, 2]), at)
    sink.save(rows(spark, [2, 3], "new").withColumn("content", F.when(F.col("file_id") != "3", F.col("content"))), at, overwrite=True, skip_failed=True)
    assert seen(at) == {"1.pdf": b"x1", "2.pdf": b"new2"}
    sink.save(rows(spark, []), at)
    assert len(seen(at)) == 2


def test_a_rerun_gives_the_same_files(spark, tmp_path):
    for at in ("a", "b"):
        sink.save(rows(spark, range(20)).repartition(1 + len(at) * 2), str(tmp_path / at), job="j")
    assert seen(tmp_path / "a") == seen(tmp_path / "b") and len(seen(tmp_path / "a")) == 20


def test_death_before_the_commit_point(spark, tmp_path):
    """Staged files of a driver that died are seen by nobody and hinder nobody."""
    at = str(tmp_path / "out")
    place = sink.Place(at, "dead")
    sink.stage(place, iter([batch([1, 2])]), False)
    assert seen(at) == {} and sink.committed(spark, at).count() == 0
    assert sink.recover(spark, at) == {} and seen(at) == {}
    sink.save(rows(spark, [1, 2]), at, job="dead")
    assert seen(at) == {"1.pdf": b"x1", "2.pdf": b"x2"}


def test_death_after_the_commit_point(spark, tmp_path):
    """Whoever comes next finishes a committed job, also one whose moves were under way."""
    at = str(tmp_path / "out")
    place = sink.Place(at, "cut")
    messages = [sink.stage(place, iter([batch([1, 2, 3])]), False), sink.stage(place, iter([batch([4])]), False), sink.stage(place, iter([batch([1, 5])]), False)]
    # The third list is of a task that ran twice: no message of it counts.
    place.put(sink.manifest_name(), sink.json.dumps({"job": "cut", "parts": [m.part for m in messages[:2]], "count": 4, "size": 8}).encode())
    store, target, job = place.stores()
    first = next(sink._entries(place, [messages[0].part]))
    sink.move(store, target, job, first["staged"], first["name"], first["size"])
    assert len(seen(at)) == 1
    assert sink.recover(spark, at) == {"cut/manifest.json": "finished"}
    assert seen(at) == {f"{i}.pdf": f"x{i}".encode() for i in (1, 2, 3, 4)}
    assert sink.recover(spark, at) == {"cut/manifest.json": "was done"}


def test_lost_committed_files_are_told(spark, tmp_path):
    at = str(tmp_path / "out")
    place = sink.Place(at, "lost")
    m = sink.stage(place, iter([batch([1])]), False)
    place.put(sink.manifest_name(), sink.json.dumps({"job": "lost", "parts": [m.part], "count": 1, "size": 2}).encode())
    os.remove(f"{place.root}/{m.part.split('/')[0]}/0")
    with pytest.raises(Exception, match="neither staged nor there"):
        sink.recover(spark, at)


def test_unfinished_jobs_are_dropped_on_demand(spark, tmp_path):
    at = str(tmp_path / "out")
    sink.stage(sink.Place(at, "dead/one"), iter([batch([1])]), False)
    assert sink.recover(spark, at, drop_unfinished=True) == {"dead/one": "dropped"}
    assert not list(Path(at, "_sink").iterdir())


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from folio.sources import sink
import pyarrow as pa
place = sink.Place({at!r}, "killed")
def batches():
    yield pa.RecordBatch.from_pydict({{"file_id": ["1"], "content": [b"x1"]}})
    os.kill(os.getpid(), 9)
sink.stage(place, batches(), False)
"""


def test_a_killed_task(spark, tmp_path):
    at = str(tmp_path / "out")
    died = subprocess.run([sys.executable, "-c", KILLED.format(root=ROOT, at=at)], check=False)
    assert died.returncode == -9 and seen(at) == {}
    sink.save(rows(spark, [1]), at, job="killed")
    assert seen(at) == {"1.pdf": b"x1"}


def test_stream(spark, tmp_path):
    """Batches are committed once; a replayed one is finished, not written again."""
    pdf.register(spark)
    source, at = tmp_path / "in", str(tmp_path / "out")
    schema = "file_id string, content binary"

    def run():
        q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)).writeStream.format("pdf").option("job", "s").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(at)
        q.awaitTermination()

    for tag, ids in (("x", [1, 2]), ("x", [3])):
        rows(spark, ids, tag).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert seen(at) == {f"{i}.pdf": f"x{i}".encode() for i in (1, 2, 3)}
    manifests = sorted(p.name for p in Path(at, "_sink", "s").glob("manifest-*"))
    assert len(manifests) == 2
    # A replay of batch 0, as after a driver's death between commit and log: other rows change nothing.
    place = sink.Place(at, "s")
    writer = sink.PdfStreamWriter({"path": at, "job": "s"}, False)
    writer.commit([writer.write(iter([batch([1, 2])]))], 0)
    assert seen(at) == {f"{i}.pdf": f"x{i}".encode() for i in (1, 2, 3)} and place.get(sink.manifest_name(0))["count"] == 2
    with pytest.raises(IoError, match="already there"):
        writer.commit([writer.write(iter([batch([3, 4])]))], 7)
    assert "4.pdf" not in seen(at)
    rows(spark, [4]).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert len(seen(at)) == 4


def test_wrong_columns(spark, tmp_path):
    pdf.register(spark)
    with pytest.raises(Exception, match="file_id and content"):
        spark.range(2).write.format("pdf").mode("append").save(str(tmp_path / "out"))
    with pytest.raises(WriteError):
        sink.stage(sink.Place(str(tmp_path / "o"), "j"), iter([pa.RecordBatch.from_pydict({"file_id": ["1"], "content": pa.array([None], pa.binary())})]), False)
