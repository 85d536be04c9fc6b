"""Tables that take inserts in batches: a repeated batch adds nothing, and every insert gives the rows that it added.

A batch is a folder of its own, and counts once Spark's mark of success lies in it.  What a lost driver left half written has none
and is written anew by the same batch.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Inserts:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _done(self, folder: str) -> bool:
        mark, store = self._files(f"{folder}/_SUCCESS")
        return store.exists(mark)

    def batches(self) -> list[str]:
        """The folders of the batches that count, by name: a listing, no data."""
        root, store = self._files(self.path)
        names = [f"{self.path}/{s.getPath().getName()}" for s in store.listStatus(root)] if store.exists(root) else []
        return sorted(n for n in names if self._done(n))

    def table(self) -> DataFrame:
        """All rows that are in."""
        there = self.batches()
        return self.spark.read.schema(self.schema).parquet(*there) if there else self.spark.createDataFrame([], self.schema)

    def insert(self, rows: DataFrame, batch: str) -> DataFrame:
        """Adds the rows whose keys are not in yet, one of each key, and gives them; a batch that is in gives what it added then.

        Of rows of equal keys the least by all columns goes in.  Rows with a null key are told apart like others: null equals null.
        """
        folder = f"{self.path}/batch={batch}"
        if not self._done(folder):
            rest = [c for c in rows.columns if c not in self.keys]
            once = rows.groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("rest")).select(*self.keys, "rest.*") if rest else rows.distinct()
            known = self.table().select(*(F.col(k).alias(f"known_{k}") for k in self.keys))
            same = [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in self.keys]
            once.join(known, same, "left_anti").select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(self.schema).parquet(folder)
