"""Tables that a job writes once and later jobs read: files in the folder the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A folder of its own under the shared one, deleted on leaving the ``with`` block (or when the driver ends).

    A session without that setting gets a temporary folder if it is local; on a cluster that is an error, as executors
    do not see each other's disks.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="orogen-")
        self.path = f"{root.rstrip('/')}/orogen-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._system = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._system.deleteOnExit(self._folder)
        self.spark = spark

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._system.delete(self._folder, True)

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` written and read again; with ``by``, a folder for each value of that column, so that reads of some values leave the others' files alone."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.written_to = path
        return out

    def delete(self, table: DataFrame) -> None:
        """Delete the files of a table that nothing will read again."""
        self._system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(table.written_to), True)
