"""Token counts kept by signed deltas: totals by source, language and tokenizer version.

A change row says how many documents and tokens a key gains or loses: an insert counts +, a delete
-, a revision takes its old count back and adds its new one, perhaps under another key.  A batch is
summed by key (before and after the shuffle: there are few keys, however hot) and committed under
its name as one folder; it counts once it holds its success mark, so a batch that died midway
leaves nothing and is written anew, and a batch that is sent again changes nothing.  Totals are sums
over the committed batches; ``compact`` folds them into one.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    return counts.select(*(F.col(k).cast("string").alias(k) for k in KEYS), F.lit(sign).cast("long").alias("docs"), (sign * n).alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """Changes for new documents: a row each, of the keys and ``n_tokens`` (null: 0).  Null keys are keys too."""
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    """Changes for documents that go, counted as when they came."""
    return _signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes for documents counted anew: their old rows and their new ones."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """The totals below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda *parts: hadoop.Path("/".join((self.path, *parts)))
        self._store = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Folder names of the committed batches, less those that a committed compaction has folded."""
        if not self._store.exists(self._at()):
            return []
        names = sorted(s.getPath().getName() for s in self._store.listStatus(self._at()))
        done = [n for n in names if n.startswith(("batch=", "fold=")) and self._store.exists(self._at(n, "_SUCCESS"))]
        folds = [n for n in done if n.startswith("fold=")]
        if not folds:
            return done
        last = max(folds, key=lambda n: int(n[5:]))
        listed = {r[0] for r in self.spark.read.text("/".join((self.path, "folded", last[5:]))).collect()}  # a line a batch
        return [last, *(n for n in done if n.startswith("batch=") and n not in listed)]

    def has(self, batch: str) -> bool:
        return self._store.exists(self._at("batch=" + quote(batch, safe=""), "_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False, and nothing happens, if a batch of that name is committed."""
        if self.has(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/batch={quote(batch, safe='')}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; keys without documents and tokens are left out."""
        return self._totals(self.committed())

    def _totals(self, names: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Folds all committed batches into one; their names stay taken.

        One listing names what is folded: a batch that commits meanwhile is not in it and counts beside the fold.
        """
        names = self.committed()
        if len(names) < 2:
            return
        last = max((int(n[5:]) for n in names if n.startswith("fold=")), default=0)
        before = [r[0] for r in self.spark.read.text(f"{self.path}/folded/{last}").collect()] if last else []
        done = [(n,) for n in sorted({*before, *(n for n in names if n.startswith("batch="))})]
        sums = self._totals(names).withColumnsRenamed({"n_docs": "docs", "n_tokens": "tokens"})
        self.spark.createDataFrame(done, "name string").coalesce(1).write.mode("overwrite").text(f"{self.path}/folded/{last + 1}")
        sums.write.mode("overwrite").parquet(f"{self.path}/fold={last + 1}")
