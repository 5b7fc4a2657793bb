"""A table in the shared folder of which a merge rewrites only the partitions that it touches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.graph import kept

MANIFEST = "version long, batch string, mark string, part int, folder string"
Combine = Callable[[DataFrame, DataFrame], DataFrame]


class StoredTable:
    """Rows dealt by a hash of ``key`` into ``parts`` partitions, each with the folder that holds it now; a ``numbered`` key is the partition's number itself.

    A merge writes new folders for its partitions, then publishes them by one
    appended file of the manifest, with the batch's name and a high-water mark. So
    readers see all of a merge or nothing of it, other partitions keep their
    files, and a batch that comes again changes nothing. One writer at a time;
    folders that no version names are left for a later ``vacuum`` by their owner.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, parts: int = 16, numbered: bool = False):
        self.spark, self.path, self.schema, self.key, self.parts, self.numbered = spark, path, schema, key, parts, numbered

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def head(self) -> tuple[int, dict[int, str], str | None]:
        """(version, folder of each partition, mark); at most ``parts`` rows."""
        log = self.manifest()
        last = log.agg(F.max("version").alias("version"))
        rows = log.join(F.broadcast(last), "version").collect()
        return (rows[0].version if rows else 0), {r.part: r.folder for r in rows if r.part is not None and r.folder}, (rows[0].mark if rows else None)

    def mark(self) -> str | None:
        """The high-water mark of the last merge."""
        return self.head()[2]

    def seen(self, batch: str) -> bool:
        return not self.manifest().where(F.col("batch") == batch).isEmpty()

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows as of now, of some partitions or of all."""
        folders = self.head()[1]
        return self._rows([f for p, f in sorted(folders.items()) if only is None or p in only])

    def _rows(self, folders: list[str]) -> DataFrame:
        # with no folder named, an empty table
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def place(self) -> Column:
        return F.pmod(F.col(self.key) if self.numbered else F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def merge(self, incoming: DataFrame, batch: str, combine: Combine, mark: str | None = None, stable: bool = False, dealt: bool = False) -> list[int]:
        """The partitions that ``combine(old rows, incoming rows)`` has rewritten; none if the batch was merged before.

        ``combine`` sees whole partitions: all rows, old and incoming, of the keys
        that fall there. Without a mark the former one stays. ``stable`` rows are already stored
        and are not kept again; with ``dealt``, ``combine`` returns the rows of a partition together and in order.
        """
        if self.seen(batch):
            return []
        version, folders, former = self.head()
        fresh = incoming if stable else kept(incoming)
        touched = sorted(r.p for r in fresh.select(self.place().alias("p")).distinct().collect())
        if touched:
            old = self._rows([folders[p] for p in touched if p in folders])
            here = f"{self.path}/data/{uuid.uuid4().hex}"
            names = [f.name for f in self.schema]
            new = combine(old, fresh).select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("_part", self.place())
            new = new if dealt else new.repartition(len(touched), "_part").sortWithinPartitions("_part", *names[:1])
            new.write.partitionBy("_part").parquet(here)
            written = {r["_part"] for r in self.spark.read.schema(StructType([*self.schema.fields, StructField("_part", IntegerType())])).parquet(here).select("_part").distinct().collect()}
            folders = {p: f for p, f in folders.items() if p not in touched} | {p: f"{here}/_part={p}" for p in written}
        rows = [(version + 1, batch, mark if mark is not None else former, p, f) for p, f in sorted(folders.items())] or [(version + 1, batch, mark if mark is not None else former, None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return touched


def replace_by(*keys: str) -> Combine:
    """Incoming rows replace all old rows of their keys."""
    return lambda old, new: old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def add_new(*keys: str) -> Combine:
    """Incoming rows are added whose keys are not there."""
    return lambda old, new: old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))
