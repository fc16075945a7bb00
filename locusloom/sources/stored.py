"""Keyed tables that are kept on storage and changed there, bucket by bucket.

Rows lie below ``<path>/data/bucket=<k>``, the bucket being a hash of the key. A change reads only the buckets that its keys
fall into and overwrites those alone; files of other buckets stay. ``<path>/commits`` lists the changes that are done, so a
change that is repeated under its name (a retried micro-batch) does nothing. A change that was cut off between the two is
made again with the same result, since the newest row per key, or the replacing rows, stay the same.

One writer at a time. The number of buckets is fixed when the table is made; choose it so that a bucket fits a few tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.functions.session import cut_lineage
from locusloom.operators.tables import upsert

_BUCKET = "bucket"


class StoredTable:
    """A table of ``schema`` with key columns ``keys`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.schema}, {_BUCKET} int").parquet(f"{self.path}/data")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{self.schema}, {_BUCKET} int")

    def read(self) -> DataFrame:
        return self._stored().drop(_BUCKET)

    def commits(self) -> list[str]:
        """Names of the changes that are done."""
        try:
            rows = self.spark.read.schema("name string, at timestamp").parquet(f"{self.path}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r.name for r in rows.select("name").distinct().collect())

    def _done(self, name: str) -> bool:
        return name in self.commits()

    def _touched(self, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The changes with their bucket, and the stored rows of the same buckets."""
        mine = cut_lineage(self._bucketed(changes))
        hit = [r[0] for r in mine.select(_BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        return mine, self._stored().filter(F.col(_BUCKET).isin(hit))

    def _overwrite(self, rows: DataFrame, name: str) -> None:
        whole = cut_lineage(rows)  # read in full before the buckets it came from are replaced
        whole.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(f"{self.path}/data")
        log = self.spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("at"))
        log.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def upsert(self, incoming: DataFrame, version: Sequence[Column], name: str) -> bool:
        """Newest row per key of both; false when the change ``name`` was done before."""
        if self._done(name):
            return False
        mine, stored = self._touched(incoming)
        self._overwrite(upsert(stored, mine.select(*stored.columns), [*self.keys], version), name)
        return True

    def replace(self, rows: DataFrame, key: Sequence[str], name: str) -> bool:
        """All rows of the ``key`` values that ``rows`` has give way to ``rows``. ``key`` must hold the table's key columns or
        be them, since a bucket is found by these."""
        if list(key) != self.keys:
            raise ValueError("rows are replaced by the table's own key")
        if self._done(name):
            return False
        mine, stored = self._touched(rows)
        kept = stored.join(mine.select(*self.keys).distinct(), self.keys, "left_anti")
        self._overwrite(kept.unionByName(mine.select(*stored.columns)), name)
        return True

    def sink(self, version: Sequence[Column]):
        """A ``foreachBatch`` function that upserts every micro-batch once."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch, version, f"batch-{batch_id}")

        return write
