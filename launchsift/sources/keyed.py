"""Append-only tables that are looked up by key, a batch of keys at a time.

Rows lie in slots by the hash of their key.  Every batch adds a small file; when there are
many of them they are sorted into the slots, one file each, and a slot with many small files
gets one of them all.  A lookup reads the few new files and the slots of its keys alone; a
short list of keys also stands in the scan's filter, so that bloom filters and the statistics
of sorted pages leave out the rest.  What a lookup reads thus does not grow with the table.

A row in two files is harmless, as only the newest version of a key counts.  New files are
therefore written before old ones go, and a step that is repeated after a crash changes
nothing.  One writer at a time folds files; a second one on the same table sets ``waiting``
beyond what it will ever put, and is started again if a file went while it read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchsift.sources.files import exists, listed, remove

#: So many keys of a lookup are named in the scan's filter, in lists of ten (Spark's limit for
#: passing a list on to Parquet).
NAMED, LIST = 100, 10
#: Files are sorted by key, and a scan opens only the pages that can hold a named key.
PAGE = ("parquet.page.row.count.limit", "1000")


@dataclass(frozen=True)
class Keyed:
    """A table at ``path`` with one current row per ``key``: the one with the highest ``newest``."""

    path: str
    key: str
    schema: T.StructType
    newest: tuple[str, ...]
    slots: int = 64
    #: Batches that wait as files of their own, and small files of a slot before they become one.
    waiting: int = 16
    small: int = 8
    #: A file of at least so many bytes is left as it is.
    large: int = 128 * 1024 * 1024
    rows_per_file: int = 4_000_000

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.slots)).cast("int")

    def _read(self, spark: SparkSession, paths: list[str], base: str) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType()), T.StructField("slot", T.IntegerType())])
        if not paths:
            return spark.createDataFrame([], full)
        return spark.read.schema(full).option("basePath", base).parquet(*paths)

    def _waiting(self, spark: SparkSession) -> list[str]:
        return [p for p, _ in listed(spark, f"{self.path}/waiting")]

    def _stored(self, spark: SparkSession, slots: list[int] | None = None) -> DataFrame:
        """All versions of all rows, or of the rows of some slots."""
        base = f"{self.path}/sorted"
        whole = self._read(spark, [base] if exists(spark, base) else [], base)
        new = self._read(spark, self._waiting(spark), f"{self.path}/waiting").withColumn("slot", self._slot())
        if slots is not None:
            whole, new = whole.filter(F.col("slot").isin(slots)), new.filter(F.col("slot").isin(slots))
        return whole.unionByName(new)

    def _current(self, rows: DataFrame) -> DataFrame:
        value = F.struct(*[f.name for f in self.schema.fields if f.name != self.key])
        latest = rows.groupBy(self.key).agg(F.max_by(value, F.struct(*self.newest)).alias("_row"))
        return latest.select(self.key, "_row.*")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The current row of every key."""
        return self._current(self._stored(spark))

    def lookup(self, asked: DataFrame, batch: str | None = None) -> DataFrame:
        """The current rows of the keys in ``asked``, without what ``batch`` itself has put."""
        spark = asked.sparkSession
        keys = asked.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        some = keys.select(self.key, self._slot()).limit(NAMED + 1).collect()
        named = [r[0] for r in some]
        if len(named) <= NAMED:
            lists = [named[k : k + LIST] for k in range(0, len(named), LIST)]
            wanted = reduce(or_, [F.col(self.key).isin(part) for part in lists], F.lit(False))
            found = self._stored(spark, sorted({r[1] for r in some})).filter(wanted)
        else:
            # At most ``slots`` numbers.
            slots = [r[0] for r in keys.select(self._slot()).distinct().collect()]
            found = self._stored(spark, slots).join(keys, self.key, "left_semi")
        if batch is not None:
            found = found.filter(F.col("batch") != batch)
        return self._current(found)

    def put(self, rows: DataFrame, batch: str) -> None:
        """Adds versions of rows; the same batch again replaces what it had put."""
        rows = rows.select(*[f.name for f in self.schema.fields])
        writer = rows.sortWithinPartitions(self.key).write.mode("overwrite").option(*PAGE)
        writer.parquet(f"{self.path}/waiting/batch={batch}")
        self.fold(rows.sparkSession)

    def _sort_in(self, rows: DataFrame) -> None:
        spread = rows.withColumn("slot", self._slot()).repartition("slot").sortWithinPartitions("slot", self.key)
        (
            spread.write.mode("append")
            .option(*PAGE)
            .option("maxRecordsPerFile", self.rows_per_file)
            .option(f"parquet.bloom.filter.enabled#{self.key}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{self.key}", str(self.rows_per_file // 4))
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .partitionBy("slot")
            .parquet(f"{self.path}/sorted")
        )

    def fold(self, spark: SparkSession) -> None:
        """Sorts waiting batches into the slots and joins small files, if there are many.

        Rows keep the name of their batch, so a batch that is repeated after it was folded
        still does not see itself.
        """
        done = self._waiting(spark)
        if len(done) < self.waiting:
            return
        self._sort_in(self._read(spark, done, f"{self.path}/waiting").drop("slot"))
        for path in done:
            remove(spark, path)
        base = f"{self.path}/sorted"
        crowded = []
        for slot, _ in listed(spark, base):
            files = [p for p, size in listed(spark, slot) if size < self.large]
            if len(files) > self.small:
                crowded += files
        if crowded:
            self._sort_in(self._read(spark, crowded, base).drop("slot").distinct())
            for path in crowded:
                remove(spark, path)
