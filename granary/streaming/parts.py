"""A table that micro-batches merge into, part by part.

Rows lie in parts (months, hash buckets of a key).  Batch N writes the parts that it touches as
``batch=N/part=P`` and nothing else; the newest complete folder of a part holds its rows.  What a
batch writes depends on its own rows and on folders of earlier batches alone, so a batch that is
run again writes the same folders again and adds nothing twice, whenever the first run ended.
After a batch, each part that it touched keeps this version and the one before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class PartTable:
    """``schema`` holds the columns without ``part``, which is a string and tells where a row lies."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _found(self, pattern: str) -> list[str]:
        return [f.getPath().toString() for f in self._files.globStatus(self._path(f"{self.path}/{pattern}")) or []]

    def versions(self) -> dict[str, dict[int, str]]:
        """Folders of every part by the number of the batch that wrote them; complete batches only."""
        complete = {p.rsplit("/", 2)[-2] for p in self._found("table/batch=*/_SUCCESS")}
        out: dict[str, dict[int, str]] = {}
        for p in self._found("table/batch=*/part=*"):
            batch, part = p.rsplit("/", 2)[-2:]
            if batch in complete:
                out.setdefault(part, {})[int(batch.partition("=")[2])] = p
        return out

    def read(self, parts: set[str] | None = None, before: int | None = None) -> DataFrame:
        """Rows of all parts, or of some (``part=...``), as they were before a batch."""
        folders = []
        for part, by_batch in self.versions().items():
            known = [n for n in by_batch if before is None or n < before]
            if known and (parts is None or part in parts):
                folders.append(by_batch[max(known)])
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        # Each folder is a root of its own, so no partition column is read from its path.
        return self.spark.read.schema(self.schema).parquet(*folders)

    def merge(self, rows: DataFrame, part: Column, number: int, combine: Callable[[DataFrame], DataFrame]) -> set[str]:
        """Adds a batch: the parts that ``rows`` lie in become ``combine(old rows and new ones)``.

        ``combine`` gets the columns of the table and ``is_new``, and may keep a key's rows in its part
        only.  Returns the parts that the batch touched.
        """
        staged = f"{self.path}/new/batch={number}"
        # Written first, so that the batch is computed once.
        rows.select(*self.schema.names, part.cast("string").alias("part")).write.mode("overwrite").parquet(staged)
        new = self.spark.read.schema(StructType([*self.schema.fields]).add("part", "string")).parquet(staged)
        # As many names as the batch has parts.
        names = [r.part for r in new.select("part").distinct().collect()]
        touched = {f"part={'__HIVE_DEFAULT_PARTITION__' if p is None else p}" for p in names}
        if touched:
            new = new.select(*self.schema.names, F.lit(True).alias("is_new"))
            old = self.read(touched, number).withColumn("is_new", F.lit(False))
            merged = combine(old.unionByName(new)).select(*self.schema.names)
            merged.withColumn("part", part.cast("string")).hint("rebalance", "part").write.mode("overwrite").partitionBy(
                "part").parquet(f"{self.path}/table/batch={number}")
        self._drop_old(touched, number)
        return touched

    def _drop_old(self, touched: set[str], number: int) -> None:
        for part, by_batch in self.versions().items():
            earlier = sorted(n for n in by_batch if n < number)
            for n in earlier[:-1] if part in touched else []:
                self._files.delete(self._path(by_batch[n]), True)
        for p in self._found("new/batch=*"):
            if int(p.rpartition("=")[2]) < number:
                self._files.delete(self._path(p), True)
        for p in self._found("table/batch=*"):
            if int(p.rpartition("=")[2]) < number and not self._found(f"table/{p.rsplit('/', 1)[-1]}/part=*"):
                self._files.delete(self._path(p), True)


def bucket(keys: list[str], buckets: int) -> Column:
    """Part of a key by its hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def month(day: str) -> Column:
    """Part of a day."""
    return F.date_format(day, "yyyy-MM")


def newest(keys: list[str], columns: list[str], rank: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Keeps the row of greatest ``rank`` of each key; of equal ones a new row."""
    def combine(rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct(*columns), F.struct(*rank, "is_new"))
        return rows.groupBy(*keys).agg(best.alias("c")).select(*keys, "c.*")

    return combine
