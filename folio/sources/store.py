"""File systems of tasks and driver by path: what Spark names s3a, s3n, gs, abfs, hdfs, viewfs, file or nothing."""

from __future__ import annotations

import re
from urllib.parse import quote, urlsplit

from pyarrow import fs

from ..errors import InvalidArgument

#: Schemes that Spark's file systems and Arrow's call by different names (fixed values).
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "abfs": "abfs", "hdfs": "hdfs", "viewfs": "viewfs"}
#: Bytes of a file's name that every store takes.
LONGEST_NAME = 200


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path within it)."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path if parts.scheme else path
    if parts.scheme not in _SCHEMES:
        return fs.FileSystem.from_uri(path)
    if parts.scheme == "viewfs":
        return fs.HadoopFileSystem(f"viewfs://{parts.netloc}"), parts.path
    return fs.FileSystem.from_uri(f"{_SCHEMES[parts.scheme]}://{path.partition('://')[2]}")


def shared_folder(spark, name: str) -> str:
    """A new folder of this name under spark.checkpoint.dir, which driver and executors share; a local session may go without, and gets a temporary one."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that the driver and all executors share", arg="spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="folio-"))
        found = sc.getCheckpointDir()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def safe_name(key: object, ending: str = ".pdf") -> str:
    """A file's name for a key, the same every time and different for different keys: what isn't a letter, digit, or one of ``._-`` is percent-encoded, as is a leading ``.`` or ``_`` (which would
    hide the file); so no key leaves the folder. A long one keeps its beginning and ends in its digest."""
    if key is None:
        raise InvalidArgument("a file needs an id", arg="file_id")
    text = str(key)
    name = re.sub(r"^[._]", lambda m: f"%{ord(m[0]):02X}", quote(text, safe="").replace("~", "%7E"))
    if not name:
        raise InvalidArgument("a file needs an id", arg="file_id")
    if len(name) > LONGEST_NAME - len(ending):
        import hashlib

        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        # "%-" is never part of an encoded name.
        name = f"{name[: LONGEST_NAME - len(ending) - len(digest) - 2]}%-{digest}"
    return name + ending
