"""Written steps in the folder that all executors share.

A written step cuts lineage: what is lost with an executor is read again instead of computed again.
"""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session's setting; where that is missing, one in the session's warehouse."""
    folder = spark.conf.get(SHARED, None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/written_steps"
    return folder.rstrip("/")


def free_name(name: str, taken: list[str]) -> str:
    """A column name that none of `taken` has, whatever its case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def session_of(df: DataFrame) -> SparkSession:
    """The session of df, with this package on the path of Python workers that share the driver's disk.

    On a cluster, pass the package with --py-files.
    """
    spark = df.sparkSession
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH")]))
    return spark


def give_back(spark: SparkSession) -> None:
    """Lets executors give heap that only garbage fills back to the system: Python workers get their memory from it next."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


class Steps:
    """Written steps of one run of an operator."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.count = 0
        self.live: list[str] = []

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Writes df and returns it as read from there."""
        path = self.path(name)
        df.write.parquet(path, compression=compression)
        self.live.append(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        found._written_at = path
        return found

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """The same for the step that the result is read from; all steps before it are removed."""
        before, self.live = self.live, []
        found = self.keep(df, name)
        for path in before:
            self.remove(path)
        return found

    def drop(self, *steps: DataFrame) -> None:
        """Removes steps that nothing reads any more."""
        for step in steps:
            self.live.remove(step._written_at)
            self.remove(step._written_at)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished steps: it does so for frames that the driver has collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def remove(self, path: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
