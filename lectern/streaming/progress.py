"""Events of a document's way through the reader, as a stream: one for each paragraph, in order, and one at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 5000


def events(docs: DataFrame) -> DataFrame:
    """(doc_id, step, event) of (doc_id, text): a paragraph of over ``LONGEST`` signs is an error, and so is then the document.

    Paragraphs are lines that are not blank, numbered with the blank ones; a text without any gives no event.
    """
    text = r"transform(split(text, '\\n'), (p, i) -> struct(i + 1 as step, length(trim(p)) as size))"
    found = docs.withColumn("ps", F.expr(f"filter({text}, p -> p.size > 0)")).where("size(ps) > 0")
    each = f"transform(ps, p -> struct(p.step as step, if(p.size > {LONGEST}, 'paragraph_error', 'paragraph_complete') as event))"
    last = f"struct(element_at(ps, -1).step + 1 as step, if(exists(ps, p -> p.size > {LONGEST}), 'error', 'complete') as event)"
    return found.select("doc_id", F.explode(F.expr(f"concat({each}, array({last}))")).alias("e")).select("doc_id", F.col("e.step").cast("bigint").alias("step"), "e.event")


class EventSink:
    """The events of a stream in files, each exactly once: a micro-batch that is run again replaces what it wrote.

    A document's events lie in one file, in order.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def put(self, batch: DataFrame, number: int) -> None:
        ordered = batch.repartition("doc_id").sortWithinPartitions("doc_id", "step")
        ordered.write.mode("overwrite").parquet(f"{self.path}/events/batch={number}")

    def run(self, stream: DataFrame) -> None:
        """Takes all that the source holds and that no run before has taken."""
        writer = stream.writeStream.option("checkpointLocation", f"{self.path}/log").foreachBatch(self.put)
        writer.trigger(availableNow=True).start().awaitTermination()
