"""Media columns: a Spark data source over directories of archives.

Payloads are stored as 8-bit RGB images (PNG, 64 pixels a row, so a row is 192 bytes), images as stored members of ZIP archives. Writing is one
archive or more a task, under a name of the attempt's own, that the commit makes visible; what failed or was tried twice is never seen. Reading plans
byte ranges of the archives from their sizes alone; a task reads its archive's directory, takes the members that begin in its range,
and streams their payloads in Arrow batches. Every member is fetched by its own offset and tried again by itself; one that
stays unreadable is a row with an error, not a failed job.

A null text is an empty payload. Empty texts, repeated rows and equal names are members like others; equal
texts give equal images. Texts are stored whole. Extra columns are not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .scratch import Scratch
from .textbatch import steps

ROW = 192
FILL = b"\x20"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# --- payloads and images ---------------------------------------------------------------------------------------------------------

def padded(data: bytes) -> bytes:
    """data and spaces up to a positive multiple of a row."""
    return data + FILL * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes, n_bytes: int, level: int = 2) -> bytes:
    """An image of 64 pixels a row whose samples are the payload; the length before padding is a text chunk."""
    rows = len(payload) // ROW
    lines = b"".join([b"\0" + payload[i * ROW : (i + 1) * ROW] for i in range(rows)])
    head = struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"length\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int, int]:
    """The samples of an image written by to_png, its rows, and the length before padding. Raises ValueError on damage."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, found = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"damaged {kind!r} chunk")
        found[kind] = found.get(kind, b"") + body
        at += 12 + n
    rows = struct.unpack(">II", found[b"IHDR"][:8])[1]
    lines = zlib.decompress(found[b"IDAT"])
    if len(lines) != rows * (ROW + 1) or any(lines[:: ROW + 1]):
        raise ValueError("samples are missing or filtered")
    return b"".join([lines[i + 1 : i + 1 + ROW] for i in range(0, len(lines), ROW + 1)]), rows, int(found[b"tEXt"].partition(b"\0")[2])


# --- the archive store -----------------------------------------------------------------------------------------------------------

def filesystem(uri: str):
    """The Arrow file system and the path in it of a URI or a local path."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class Stored(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _At:
    """A seekable stream for zipfile over an Arrow input file."""

    def __init__(self, f):
        self.f = f

    def read(self, n: int = -1) -> bytes:
        return self.f.read(n if n is not None and n >= 0 else None)

    def seek(self, at: int, whence: int = 0) -> int:
        self.f.seek(at, whence)
        return self.f.tell()

    def tell(self) -> int:
        return self.f.tell()

    def seekable(self) -> bool:
        return True


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.bytes = int(options.get("rangebytes", 16 << 20))
        self.tries = int(options.get("tries", 3))
        self.batch = int(options.get("batchbytes", 8 << 20))

    def partitions(self) -> list[Range]:
        """Byte ranges of every archive of the committed directory; nothing is opened here."""
        from pyarrow import fs

        store, root = filesystem(self.root)
        files = [f for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith(".zip")]
        out = [Range(f.path, a, min(a + self.bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self.bytes)]
        return out or [Range("", 0, 0)]

    def member(self, store, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset: local header, then its bytes, checked."""
        with store.open_input_file(path) as f:
            f.seek(info.header_offset)
            head = f.read(30)
            name, extra = struct.unpack("<HH", head[26:30])
            f.seek(info.header_offset + 30 + name + extra)
            data = f.read(info.file_size)
        if head[:4] != b"PK\3\4" or len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise OSError(f"member at {info.header_offset} is damaged")
        return data

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = filesystem(self.root)
        with store.open_input_file(partition.path) as f, zipfile.ZipFile(_At(f)) as z:
            infos = sorted((i for i in z.infolist() if partition.start <= i.header_offset < partition.end), key=lambda i: i.header_offset)
        rows, held = [], 0
        for info in infos:
            data, error = None, None
            for attempt in range(self.tries):
                try:
                    data, error = self.member(store, partition.path, info), None
                    break
                except OSError as e:
                    error = str(e)
                    time.sleep(0.05 * 4**attempt * (attempt + 1 < self.tries))
            rows.append((info.filename.partition("/")[2], partition.path, info.header_offset, data, error))
            held += len(data or b"")
            if held >= self.batch:
                yield self.rows(rows)
                rows, held = [], 0
        if rows:
            yield self.rows(rows)

    @staticmethod
    def rows(rows: list) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["name", "archive", "at", "data", "error"])


class ArchiveWriter(DataSourceArrowWriter):
    """Takes (name, data) rows. Archives are closed at ``archivebytes``; the last attempt's are renamed by the commit."""

    def __init__(self, options):
        self.root = options["path"]
        self.most = int(options.get("archivebytes", 128 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Stored:
        store, root = filesystem(self.root)
        store.create_dir(f"{root}/_pending", recursive=True)
        mine, names, z, out, n = uuid.uuid4().hex, [], None, None, 0
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("data").to_pylist(), strict=True):
                if z is None:
                    names.append(f"{mine}-{len(names):04d}.zip")
                    out = store.open_output_stream(f"{root}/_pending/{names[-1]}")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                z.writestr(zipfile.ZipInfo(f"{n}/{name}"), data)
                n += 1
                if out.tell() >= self.most:
                    z.close()
                    out.close()
                    z = None
        if z is not None:
            z.close()
            out.close()
        return Stored(names)

    def commit(self, messages: list) -> None:
        store, root = filesystem(self.root)
        for m in messages:
            for name in m.names if m else []:
                store.move(f"{root}/_pending/{name}", f"{root}/{name}")
        if store.get_file_info(f"{root}/_pending").type.name != "NotFound":
            store.delete_dir(f"{root}/_pending")

    def abort(self, messages: list) -> None:
        store, root = filesystem(self.root)
        if store.get_file_info(f"{root}/_pending").type.name != "NotFound":
            store.delete_dir(f"{root}/_pending")


class MediaArchives(DataSource):
    """format("media_archives"): reads (name, archive, at, data, error); writes (name, data). Options: path, rangebytes, batchbytes, tries, archivebytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "name string, archive string, at long, data binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def store_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes every row's text as an image to archives under path."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
            names = ["" if d is None else str(d) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([to_png(padded(r), len(r)) for r in raw], pa.binary())], ["name", "data"])

    docs.sparkSession.dataSource.register(MediaArchives)
    given.mapInArrow(run, "name string, data binary").write.format("media_archives").mode("append").option("path", path).save()


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(path=path, **options).load()


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error) from what was stored.

    feature: JSON with the image's size and its samples' least, largest and mean value and entropy in bits, rounded to 6 places. A
    member that could not be read has nulls and its error.
    """
    kinds = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_bytes", "payload_bytes")), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]

    def row(name: str, data: bytes | None, error: str | None) -> tuple:
        import numpy as np

        doc_id = int(name) if name else None
        if data is None:
            return doc_id, *(None,) * 7, error
        try:
            payload, rows, n = from_png(data)
        except (ValueError, KeyError, struct.error, zlib.error) as e:
            return doc_id, *(None,) * 7, f"{type(e).__name__}: {e}"
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        used = np.flatnonzero(counts)
        p = counts[used] / len(payload)
        said = {"width": ROW // 3, "height": rows, "channels": 3, "min": int(used[0]), "max": int(used[-1]), "mean": round(float((p * used).sum()), 6), "entropy": round(float(-(p * np.log2(p)).sum()) + 0.0, 6)}
        return doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), json.dumps(said, separators=(",", ":")), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(*x) for x in zip(*(b.column(n).to_pylist() for n in ("name", "data", "error")), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return media.select("name", "data", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op6_media(spark, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "media").path("archives")
    store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return features(read_media(spark, path))
