"""Warehouse tables as Parquet folders."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hourmart.operators.writes import insert_if_absent, replace_groups, upsert
from hourmart.session import written

_COMMITS, _LAYOUT = "_commits", "_layout"


@dataclass(frozen=True)
class Warehouse:
    """Named Parquet tables below one root folder.

    A table is a folder of whole versions and of commits. A commit is an empty file whose name holds
    a rising number and the version it makes current; readers take the highest when they resolve the
    table, and go on reading that version whatever is committed meanwhile. ``refresh`` writes a new
    version and then commits it, so there is one whole table at any moment, wherever a job is lost.
    All other writes replace single partitions of the current version with dynamic overwrite:
    Spark moves the new files in when the job commits, so other partitions are not touched and a
    failed job leaves the old data. What is written over a table it was read from goes through a
    written step first.
    """

    spark: SparkSession
    root: str

    def home(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _hadoop(self, path: str):
        context = self.spark.sparkContext
        made = context._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(context._jsc.hadoopConfiguration()), made

    def commits(self, table: str) -> list[tuple[int, str]]:
        """(number, version) of every commit, oldest first; two with one number stand in version order."""
        files, folder = self._hadoop(f"{self.home(table)}/{_COMMITS}")
        if not files.exists(folder):
            return []
        names = [str(f.getPath().getName()) for f in files.listStatus(folder)]
        return sorted((int(n), version) for n, _, version in (x.partition(".") for x in names if not x.startswith((".", "_"))))

    def version(self, table: str) -> str | None:
        """The current version, or None for a table that was never written."""
        made = self.commits(table)
        return made[-1][1] if made else None

    def path(self, table: str) -> str:
        """The folder of the current version."""
        return f"{self.home(table)}/{self.version(table) or 'none'}"

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        """The table as it is now; with ``schema``, an empty frame when it was never written."""
        if schema is not None and not self._has_files(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.path(table))

    def _has_files(self, table: str) -> bool:
        """Whether the current version holds any; partitioned tables without rows have none."""
        version = self.version(table)
        if version is None:
            return False
        files, folder = self._hadoop(f"{self.home(table)}/{version}")
        return any(not str(f.getPath().getName()).startswith(("_", ".")) for f in files.listStatus(folder))

    def refresh(self, table: str, df: DataFrame, partition_by: list[str] | None = None,
                sort_by: list[str] | None = None, range_by: list[str] | None = None) -> DataFrame:
        """Full refresh: the table afterwards holds exactly ``df``.

        ``sort_by`` orders rows inside files, so row-group statistics can skip
        for range filters. Rows are rebalanced by partition value first:
        adaptive execution splits a large value over several tasks and merges
        small ones, so neither huge tasks nor tiny files appear. With ``range_by``
        they are dealt out by ranges of those columns instead, so that a value
        lies in few files.
        """
        if range_by:
            df = df.repartitionByRange(*range_by)
        elif partition_by:
            df = df.hint("rebalance", *partition_by)
        if sort_by:
            df = df.sortWithinPartitions(*(partition_by or []), *sort_by)
        version = self._new_version()
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.home(table)}/{version}")
        self._commit(table, version)
        return self.read(table)

    def refresh_buckets(self, table: str, df: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
        """Full refresh into buckets by the hash of ``by``, one file each.

        Operators that bring rows together by these columns take what :meth:`read_buckets` returns
        as it lies. There are as many buckets as shuffle partitions unless a number is given.
        """
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        version = self._new_version()
        folder = f"{self.home(table)}/{version}"
        (
            df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by)
            .option("path", folder).saveAsTable(self._name(version))
        )
        layout = F.lit(json.dumps({"by": by, "buckets": buckets})).alias("value")
        self.spark.range(1).select(layout).write.text(f"{folder}/{_LAYOUT}")
        self._commit(table, version)
        return self.read_buckets(table)

    @staticmethod
    def _name(version: str) -> str:
        return "hourmart_" + version.replace("-", "_")

    def read_buckets(self, table: str) -> DataFrame:
        """A bucketed table; another session than the writer's is told of its layout first."""
        version = self.version(table)
        name, folder = self._name(version), f"{self.home(table)}/{version}"
        if not self.spark.catalog.tableExists(name):
            layout = json.loads(self.spark.read.text(f"{folder}/{_LAYOUT}").first()[0])
            columns = ", ".join(f"`{c}`" for c in layout["by"])
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(folder).schema)
            self.spark.sql(
                f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({columns}) "
                f"SORTED BY ({columns}) INTO {layout['buckets']} BUCKETS LOCATION '{folder}'")
        return self.spark.table(name)

    def _new_version(self) -> str:
        return f"v-{uuid.uuid4().hex}"

    def _commit(self, table: str, version: str) -> None:
        """Makes a whole version the current one: one empty file appears, nothing is moved."""
        made = self.commits(table)
        files, marker = self._hadoop(
            f"{self.home(table)}/{_COMMITS}/{made[-1][0] + 1 if made else 0:012d}.{version}")
        files.create(marker, False).close()

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Removes all but the newest ``keep`` versions, and what jobs that were lost left behind.

        Call it when no reader of an older version and no writer is at work. Commits go last, so a
        crash on the way leaves the table as it is.
        """
        made = self.commits(table)
        kept = {version for _, version in made[-keep:]}
        files, home = self._hadoop(self.home(table))
        if not made:
            return
        for entry in files.listStatus(home):
            if str(entry.getPath().getName()).startswith("v-") and str(entry.getPath().getName()) not in kept:
                files.delete(entry.getPath(), True)
        for number, version in made[:-keep]:
            files.delete(self._hadoop(f"{self.home(table)}/{_COMMITS}/{number:012d}.{version}")[1], False)

    def overwrite_partitions(self, table: str, df: DataFrame, partition_by: list[str]) -> None:
        """Replace the partitions ``df`` has rows for; ``df`` must not read the table."""
        current = self.version(table)
        version = current or self._new_version()
        (
            df.hint("rebalance", *partition_by).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
            .parquet(f"{self.home(table)}/{version}")
        )
        if current is None:
            self._commit(table, version)

    def touched(self, table: str, incoming: DataFrame, partition: str) -> DataFrame:
        """Existing rows of the partitions that ``incoming`` falls in.

        A semi-join on the partition column, so dynamic partition pruning can
        leave the other folders unread.
        """
        parts = incoming.select(partition).distinct()
        existing = self.read(table, incoming.schema).join(parts, partition, "left_semi")
        return existing.select(*incoming.columns)

    def replace(self, table: str, incoming: DataFrame, keys: list[str], partition: str) -> None:
        """Drop every (``keys``) group that ``incoming`` names, then add ``incoming``."""
        result = replace_groups(self.touched(table, incoming, partition), incoming, keys)
        self.overwrite_partitions(table, written(result, table), [partition])

    def upsert(self, table: str, incoming: DataFrame, keys: list[str], update: list[str],
               partition: str) -> None:
        """Insert or update by key, rewriting only the partitions touched."""
        result = upsert(self.touched(table, incoming, partition), incoming, keys, update)
        self.overwrite_partitions(table, written(result, table), [partition])

    def insert_absent(self, table: str, incoming: DataFrame, keys: list[str], partition: str
                      ) -> None:
        result = insert_if_absent(self.touched(table, incoming, partition), incoming, keys)
        self.overwrite_partitions(table, written(result, table), [partition])

    def has_rows(self, table: str, where: str) -> bool:
        return self._has_files(table) and not self.read(table).where(where).isEmpty()

    def write_once(self, table: str, df: DataFrame, batch: str) -> None:
        """Add the rows of a named batch, unless that batch is already there.

        The batch is a partition, committed as a whole, so a retried job neither
        doubles nor loses its rows.
        """
        if not self.has_rows(table, f"batch = '{batch}'"):
            self.overwrite_partitions(table, df.withColumn("batch", F.lit(batch)), ["batch"])
