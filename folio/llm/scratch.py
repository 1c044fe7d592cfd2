"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The largest side that is broadcast, in rows of one or two longs (about 16 bytes each): 32 MB.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. A local session may lack it (tests); then a temporary folder is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="folio-"))
    return sc.getCheckpointDir()


class Scratch:
    """A folder of Parquet tables under the shared folder; a lost executor's work is redone from them, not from the start.

    Operators' results read these tables, so they stay until the caller, done with a result, calls ``close()`` on the scratch that was given to
    the operator as ``scratch``. Without one, operators make their own, which goes with the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def forget(self) -> None:
        """Lets Spark clear the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t.scratch_path)

    def close(self) -> None:
        """Deletes all tables; results that read them can't be read any more."""
        self._delete(self.root)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table, written before, has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows
