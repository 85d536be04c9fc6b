"""Queries over the file source and the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.base import ORACLE, with_views
from lectern.plans.segments import view
from lectern.registry import query
from lectern.sources.inserts import Inserts
from lectern.sources.page_lines import PageLines
from lectern.storage import shared_dir
from lectern.streaming import events as streams
from lectern.streaming.progress import EventSink, events

BOX = "(select distinct doc_id, page from text_lines where doc_id % 3 = 0)"
LINE_ROWS = f"""select doc_id, page, 'page' as kind, 0 as no, null as text, 0e0 as x0, 0e0 as y0, 612e0 as x1, 792e0 as y1, null as font from (select distinct doc_id, page from text_lines) p
    union all select doc_id, page, 'table', 1, null, 72e0, 60e0 + 17 * (doc_id % 10), 300e0, 180e0 + 17 * (doc_id % 10), null from {BOX} b
    union all select doc_id, page, 'line', row_number() over (partition by doc_id, page order by y, line_no), line, x_start * 1e0, y * 1e0, x_end * 1e0, (y + font) * 1e0, font * 1e0 from text_lines"""


@query("SRC11", with_views(f"select doc_id, page, kind, cast(no as integer) as no, text, x0, y0, x1, y1, font from ({LINE_ROWS}) r", ORACLE))
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, page heights and table boxes of all documents, from layout files that are written first."""
    spans = "array(named_struct('text', split_part(line, ' ', 1), 'size', font), named_struct('text', ' ', 'size', 99), named_struct('text', substr(line, length(split_part(line, ' ', 1)) + 1), 'size', font))"
    one = f"named_struct('y', y, 'no', line_no, 'bbox', array(x_start * 1e0, y * 1e0, x_end * 1e0, (y + font) * 1e0), 'spans', {spans})"
    table = "if(doc_id % 3 = 0, array(array(72e0, 60e0 + 17 * (doc_id % 10), 300e0, 180e0 + 17 * (doc_id % 10))), cast(array() as array<array<double>>))"
    blocks = f"array(named_struct('type', 1, 'lines', slice(array_sort(collect_list({one})), 1, 0)), named_struct('type', 0, 'lines', array_sort(collect_list({one}))))"
    pages = view(spark, sf_dir, f"select to_json(struct(doc_id, page, 612 as width, 792 as height, {table} as tables, {blocks} as blocks)) as value from text_lines group by doc_id, page", "documents")
    path = f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"
    pages.write.text(path)
    spark.dataSource.register(PageLines)
    return spark.read.format("page_lines").load(path)


RETURNED = "select 'first' as batch, id, title from docs where created_h > 300 union all select 'second', id, title from docs where created_h > 100 and created_h <= 300"


@query("SNK1", with_views(RETURNED, ORACLE))
def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two inserts of documents give back: the second brings rows that are in, and the first is sent again."""
    table = Inserts(spark, f"{shared_dir(spark)}/inserts-{uuid.uuid4().hex}", "id bigint, title string", ["id"])
    docs = view(spark, sf_dir, "select id, title, created_h from docs", "documents")
    first = docs.where("created_h > 300").drop("created_h")
    table.insert(first, "first")
    second = table.insert(docs.where("created_h > 100").drop("created_h"), "second")
    again = table.insert(first, "first")
    return again.select(F.lit("first").alias("batch"), "id", "title").unionByName(second.select(F.lit("second").alias("batch"), "id", "title"))


PROGRESS = """select doc_id, paragraph_no as step, case when length(paragraph) > 5000 then 'paragraph_error' else 'paragraph_complete' end as event from paragraphs
    union all select doc_id, max(paragraph_no) + 1, case when max(length(paragraph)) > 5000 then 'error' else 'complete' end from paragraphs group by doc_id"""


@query("SNK2", with_views(PROGRESS, ORACLE))
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all documents, through a stream into the event sink."""
    sink = EventSink(f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}")
    sink.run(events(streams.source(spark, sf_dir, "documents").select("doc_id", "text")))
    return spark.read.parquet(f"{sink.path}/events").select("doc_id", "step", "event")

