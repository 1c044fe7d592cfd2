"""Files written all or none: format("pdf") as a batch and streaming sink, and ``save`` for very many files.

Under the target lies ``_sink/<job>/``, which readers pass over. Tasks stage each file there under a number, with its name, size and digest in a list of the task's own; a task that fails or
runs twice leaves lists that nobody names. The driver then writes one manifest, which names the lists that count: this is the commit point. Only after it are files
moved to their names. Whatever dies before it leaves nothing that is seen; whatever dies after it is finished by ``recover``, or by the next write of the same job, since moves can be repeated.

    files.write.format("pdf").mode("append").option("job", "2024-05").save("/data/out")
    files.writeStream.format("pdf").option("job", "daily").option("checkpointLocation", ...).start("/data/out")
    sink.save(files, "/data/out", job="2024-05")

Names come from ids (``store.safe_name``), so a rerun gives the same files. Names that repeat, and names that the folder has already (unless mode is overwrite), are refused before the commit point. A job
that is committed isn't written again. A stream's batch is a job of its own, so a batch that is replayed is written once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from ..errors import InvalidArgument, IoError, WriteError
from .store import exists, safe_name, store_of

#: Names that a plain write checks and moves on the driver; ``save`` does that in tasks, for any number.
MOST_NAMES = 1_000_000
ENTRY = "part string, staged string, file_id string, name string, size bigint, sha256 string"


@dataclass
class Staged(WriterCommitMessage):
    """What a task staged: the list's path under the job's folder, and how many files of how many bytes."""

    part: str
    count: int
    size: int


class Place:
    """A target folder and one job's folder in it."""

    def __init__(self, path: str, job: str):
        if not job:
            raise InvalidArgument("a job needs a name", arg="job")
        self.path, self.job = path.rstrip("/") or "/", job
        self.root = f"{self.path}/_sink/{quote(job, safe='')}"

    def stores(self) -> tuple[fs.FileSystem, str, str]:
        """(file system, target folder, job's folder)."""
        store, at = store_of(self.path)
        return store, at.rstrip("/"), f"{at.rstrip('/')}/_sink/{quote(self.job, safe='')}"

    def put(self, name: str, data: bytes) -> None:
        """A small file in the job's folder, whole or not there."""
        store, _, job = self.stores()
        store.create_dir(job, recursive=True)
        part = f"{job}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, f"{job}/{name}")

    def get(self, name: str) -> dict | None:
        store, _, job = self.stores()
        if not exists(store, f"{job}/{name}"):
            return None
        with store.open_input_stream(f"{job}/{name}") as f:
            return json.loads(f.read())


def manifest_name(batch: int | None = None) -> str:
    return "manifest.json" if batch is None else f"manifest-{batch:012d}.json"


# --- in tasks --------------------------------------------------------------------------------------------------------------------

def stage(place: Place, batches: Iterator[pa.RecordBatch], skip_failed: bool) -> Staged:
    """Writes a task's rows (file_id, content[, status]) as numbered files, then their list."""
    store, _, job = place.stores()
    part = uuid.uuid4().hex
    store.create_dir(f"{job}/{part}", recursive=True)
    entries: dict[str, dict] = {}
    for batch in batches:
        ids, contents = (batch.column(batch.schema.get_field_index(c)) for c in ("file_id", "content"))
        for key, content in zip(ids, contents, strict=True):
            data = content.as_py()
            if data is None and skip_failed:
                continue
            if data is None:
                raise WriteError(f"no content for {key.as_py()!r}")
            name = safe_name(key.as_py())
            if name in entries:
                raise InvalidArgument(f"two files are named {name}", arg="file_id")
            staged = f"{part}/{len(entries)}"
            with store.open_output_stream(f"{job}/{staged}") as out:
                out.write(data)
            entries[name] = {"part": part, "staged": staged, "file_id": str(key.as_py()), "name": name, "size": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    with store.open_output_stream(f"{job}/{part}/part.jsonl") as out:
        for name in sorted(entries):
            out.write((json.dumps(entries[name]) + "\n").encode())
    return Staged(f"{part}/part.jsonl", len(entries), sum(e["size"] for e in entries.values()))


def move(store: fs.FileSystem, target: str, job: str, staged: str, name: str, size: int) -> None:
    """Moves a staged file to its name, unless that is done already."""
    from_, to = store.get_file_info([f"{job}/{staged}", f"{target}/{name}"])
    if from_.type != fs.FileType.NotFound:
        store.move(from_.path, to.path)
    elif to.type == fs.FileType.NotFound or to.size != size:
        raise IoError(f"{name} was committed but is neither staged nor there")


# --- on the driver: a plain write ------------------------------------------------------------------------------------------------

def _entries(place: Place, parts: list[str]) -> Iterator[dict]:
    store, _, job = place.stores()
    for part in parts:
        with store.open_input_stream(f"{job}/{part}") as f:
            for line in f.read().splitlines():
                yield json.loads(line)


def _commit(place: Place, messages: list[Staged | None], overwrite: bool, batch: int | None = None) -> None:
    """Checks names, writes the manifest, moves the files. What was committed before is only finished, and the new staged files go."""
    found = [m for m in messages if m is not None]
    name = manifest_name(batch)
    if place.get(name) is None:
        if sum(m.count for m in found) > MOST_NAMES:
            raise InvalidArgument(f"a plain write takes {MOST_NAMES} files; use save()", arg="job")
        store, target, _ = place.stores()
        seen: set[str] = set()
        for e in _entries(place, [m.part for m in found]):
            if e["name"] in seen:
                raise InvalidArgument(f"two files are named {e['name']}", arg="file_id")
            seen.add(e["name"])
        if not overwrite:
            held = {f.base_name for f in store.get_file_info(fs.FileSelector(target, allow_not_found=True)) if f.is_file}
            if there := sorted(seen & held)[:3]:
                raise IoError(f"already there: {', '.join(there)}")
        place.put(name, json.dumps({"job": place.job, "parts": sorted(m.part for m in found), "count": len(seen), "size": sum(m.size for m in found)}).encode())
        kept = set()
    else:
        kept = set(place.get(name)["parts"])
        _discard(place, [m.part for m in found if m.part not in kept])
    _finish(place, name)


def _finish(place: Place, name: str) -> None:
    store, target, job = place.stores()
    if exists(store, f"{job}/done-{name}"):
        return
    store.create_dir(target, recursive=True)
    for e in _entries(place, place.get(name)["parts"]):
        move(store, target, job, e["staged"], e["name"], e["size"])
    place.put(f"done-{name}", b"{}")


def _discard(place: Place, parts: list[str]) -> None:
    store, _, job = place.stores()
    for part in parts:
        if exists(store, folder := f"{job}/{part.split('/')[0]}"):
            store.delete_dir(folder)


class PdfWriter(DataSourceArrowWriter):
    """A batch write. Options: ``job`` (a name of its own by default), ``skipFailed`` (rows without content are left out instead of failing the write)."""

    def __init__(self, options: dict, overwrite: bool):
        self.place = Place(options["path"], options.get("job") or uuid.uuid4().hex)
        self.overwrite, self.skip = overwrite, str(options.get("skipfailed", options.get("skipFailed", "false"))).lower() == "true"
        #: ``save`` commits by itself.
        self.later = options.get("commit") == "later"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return stage(self.place, iterator, self.skip)

    def commit(self, messages: list[Staged | None]) -> None:
        if self.later:
            found = [m for m in messages if m is not None]
            self.place.put("staged.json", json.dumps({"parts": sorted(m.part for m in found), "count": sum(m.count for m in found), "size": sum(m.size for m in found)}).encode())
            return
        try:
            _commit(self.place, messages, self.overwrite)
        except (InvalidArgument, IoError):
            self.abort(messages)
            raise

    def abort(self, messages: list[Staged | None]) -> None:
        """Removes what was staged, unless the job is committed: then only ``recover`` has something to do."""
        store, _, job = self.place.stores()
        if self.place.get(manifest_name()) is None and exists(store, job):
            store.delete_dir(job)


class PdfStreamWriter(DataSourceStreamArrowWriter):
    """A streaming write; ``job`` names the stream, and has to stay the same when it is started again."""

    def __init__(self, options: dict, overwrite: bool):
        self.place = Place(options["path"], options.get("job") or "stream")
        self.overwrite, self.skip = overwrite, str(options.get("skipfailed", options.get("skipFailed", "false"))).lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return stage(self.place, iterator, self.skip)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        try:
            _commit(self.place, messages, self.overwrite, batchId)
        except (InvalidArgument, IoError):
            self.abort(messages, batchId)
            raise

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        if self.place.get(manifest_name(batchId)) is None:
            _discard(self.place, [m.part for m in messages if m is not None])


# --- by Spark: any number of files -----------------------------------------------------------------------------------------------

def _lists(spark: SparkSession, place: Place, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json([f"{place.root}/{p}" for p in parts])


def _there(entries: DataFrame, path: str) -> DataFrame:
    """Names of entries that the folder has; looked up in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            info = store.get_file_info([f"{at.rstrip('/')}/{n}" for n in names])
            yield pa.RecordBatch.from_arrays([pa.array([n for n, i in zip(names, info, strict=True) if i.type != fs.FileType.NotFound], pa.string())], ["name"])

    return entries.select("name").mapInArrow(run, "name string")


def _publish(spark: SparkSession, place: Place, name: str) -> None:
    """Moves a committed job's files in tasks; a task that runs again finds its moves done."""
    store, target, job = place.stores()
    if exists(store, f"{job}/done-{name}"):
        return
    store.create_dir(target, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, target, job = place.stores()
        for batch in batches:
            rows = batch.to_pylist()
            for e in rows:
                move(store, target, job, e["staged"], e["name"], e["size"])
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    manifest = place.get(name)
    moved = _lists(spark, place, manifest["parts"]).select("staged", "name", "size").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if moved != manifest["count"]:
        raise IoError(f"{moved} of {manifest['count']} committed files are named in the job's lists")
    place.put(f"done-{name}", b"{}")


def save(files: DataFrame, path: str, *, job: str | None = None, overwrite: bool = False, skip_failed: bool = False) -> None:
    """Writes (file_id, content) as one file each, all or none; names are checked and files moved in tasks, so any number will do. With a ``job`` that was committed before, it only finishes that."""
    from . import pdf

    spark = files.sparkSession
    place = Place(path, job or uuid.uuid4().hex)
    if place.get(manifest_name()) is None:
        pdf.register(spark)
        writer = files.select(F.col("file_id").cast("string").alias("file_id"), "content").write.format("pdf").mode("append")
        writer.option("job", place.job).option("commit", "later").option("skipFailed", str(skip_failed).lower()).save(path)
        staged = place.get("staged.json")
        entries = _lists(spark, place, staged["parts"])
        try:
            if twice := entries.groupBy("name").count().where("count > 1").limit(3).collect():
                raise InvalidArgument(f"several files have one name: {', '.join(sorted(r['name'] for r in twice))}", arg="file_id")
            if not overwrite and (there := _there(entries, place.path).limit(3).collect()):
                raise IoError(f"already there: {', '.join(sorted(r['name'] for r in there))}")
        except (InvalidArgument, IoError):
            store, _, at = place.stores()
            store.delete_dir(at)
            raise
        place.put(manifest_name(), json.dumps({"job": place.job} | staged).encode())
    _publish(spark, place, manifest_name())


def _jobs(path: str) -> Iterator[tuple[Place, list[str]]]:
    """Jobs of a folder, with the names of files in their folders."""
    from urllib.parse import unquote

    store, at = store_of(path)
    for job in sorted(store.get_file_info(fs.FileSelector(f"{at.rstrip('/')}/_sink", allow_not_found=True)), key=lambda f: f.path):
        if job.type == fs.FileType.Directory:
            yield Place(path, unquote(job.base_name)), sorted(f.base_name for f in store.get_file_info(fs.FileSelector(job.path)) if f.is_file)


def recover(spark: SparkSession, path: str, *, drop_unfinished: bool = False) -> dict[str, str]:
    """Finishes every committed job of a folder: {job and manifest: "finished" or "was done"}. drop_unfinished also removes what never reached its commit point; no such job may be running."""
    out = {}
    for place, names in _jobs(path):
        manifests = [n for n in names if n.startswith("manifest")]
        for name in manifests:
            out[f"{place.job}/{name}"] = "was done" if f"done-{name}" in names else "finished"
            _publish(spark, place, name)
        if not manifests and drop_unfinished:
            store, _, at = place.stores()
            store.delete_dir(at)
            out[place.job] = "dropped"
    return out


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(job, file_id, name, size, sha256) of every file that was committed, from the jobs' lists."""
    out = spark.createDataFrame([], "job string, file_id string, name string, size bigint, sha256 string")
    for place, names in _jobs(path):
        parts = [p for n in names if n.startswith("manifest") for p in place.get(n)["parts"]]
        if parts:
            out = out.unionByName(_lists(spark, place, parts).select(F.lit(place.job).alias("job"), "file_id", "name", "size", "sha256"))
    return out
