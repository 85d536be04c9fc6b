"""The line source and the sinks: ranges of files, repeated batches, and restarts."""

import json
import os

import pytest

from lectern.plans.lines import stats  # noqa: F401  the statistics that the source's lines feed
from lectern.sources.inserts import Inserts
from lectern.sources.page_lines import PageLines, page_rows
from lectern.streaming.progress import EventSink, events


def page(doc, number, *lines, tables=()):
    return {"doc_id": doc, "page": number, "width": 612, "height": 792, "tables": [list(t) for t in tables], "blocks": [{"type": 1, "lines": [{"bbox": [0, 0, 1, 1], "spans": [{"text": "picture"}]}]}, {"type": 0, "lines": list(lines)}]}


def line(text, y, *sizes):
    return {"bbox": [72.0, y, 540.0, y + 12], "spans": [{"text": t, "size": s} for t, s in zip(text.split("|"), sizes, strict=True)]}


def test_rows_of_a_page():
    got = list(page_rows(page(1, 2, line(" One| |two ", 60.0, 10, 99, 12), line(" ", 80.0, 9), tables=[(1, 2, 3, 4)])))
    assert got == [(1, 2, "page", 0, None, 0.0, 0.0, 612.0, 792.0, None), (1, 2, "table", 1, None, 1.0, 2.0, 3.0, 4.0, None), (1, 2, "line", 1, "Onetwo", 72.0, 60.0, 540.0, 72.0, 12.0)]
    assert list(page_rows({"doc_id": None, "page": 1, "height": 5})) == [(None, 1, "page", 0, None, 0.0, 0.0, 0.0, 5.0, None)]


@pytest.mark.parametrize("size", [1, 37, 200, 1 << 20])
def test_ranges_read_every_page_once(spark, tmp_path, size):
    pages = [page(d, n, line(f"line {d} {n} é" * (d + 1), 60.0, 11)) for d in range(4) for n in range(1, 4)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("\n".join(map(json.dumps, pages[:7])) + "\n\n")
    (tmp_path / "y.json").write_text("\n".join(map(json.dumps, pages[7:])))
    (tmp_path / "_SUCCESS").write_text("")
    spark.dataSource.register(PageLines)
    got = spark.read.format("page_lines").option("range", size).load(str(tmp_path))
    want = [r for p in pages for r in page_rows(json.loads(json.dumps(p)))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_source_feeds_the_statistics(spark, tmp_path):
    """Lines of the source as ``text_lines``: the statistics of AGG18 over them."""
    from lectern.plans.base import SPARK

    (tmp_path / "p.json").write_text(json.dumps(page(5, 1, *[line(f"Body line {i}", 90.0 + 14 * i, 11) for i in range(9)], line("Title", 60.0, 18))))
    spark.dataSource.register(PageLines)
    spark.read.format("page_lines").load(str(tmp_path)).where("kind = 'line'").selectExpr("doc_id", "no as line_no", "page", "y0 as y", "x0 as x_start", "x1 as x_end", "font", "text as line").createOrReplaceTempView("text_lines")
    (r,) = spark.sql(stats(SPARK)).collect()
    assert (r.doc_id, r.body_font, r.line_gap, r.title_font) == (5, 11.0, 14.0, 18.0)


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    table = Inserts(spark, f"file://{tmp_path}/t", "k long, v string", ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert told(table.table()) == []
    assert told(table.insert(rows((1, "a"), (2, "b"), (2, "a"), (None, "n")), "one")) == [(1, "a"), (2, "a"), (None, "n")]
    assert told(table.insert(rows((2, "c"), (3, "d"), (None, "m")), "two")) == [(3, "d")]
    assert told(table.insert(rows((9, "z")), "one")) == [(1, "a"), (2, "a"), (None, "n")]
    assert told(table.table()) == [(1, "a"), (2, "a"), (3, "d"), (None, "n")]
    os.remove(tmp_path / "t" / "batch=two" / "_SUCCESS")  # as if the driver had been lost while it wrote
    assert told(table.table()) == [(1, "a"), (2, "a"), (None, "n")]
    assert told(table.insert(rows((2, "c"), (3, "d"), (None, "m")), "two")) == [(3, "d")]
    assert told(table.insert(rows(), "three")) == [] and len(table.batches()) == 3


def test_a_restart_loses_and_repeats_no_event(spark, tmp_path):
    put = lambda name, *r: spark.createDataFrame(list(r), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    read = lambda: events(spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    put("a", (1, "one\n\n two \n"), (2, None), (3, "\n \n"))
    sink = EventSink(f"{tmp_path}/out")
    sink.run(read())
    first = [(1, 1, "paragraph_complete"), (1, 3, "paragraph_complete"), (1, 4, "complete")]
    stored = lambda: sorted(map(tuple, spark.read.parquet(f"{sink.path}/events").select("doc_id", "step", "event").collect()))
    assert stored() == first
    put("b", (4, "x" * 5001 + "\nshort"))

    class Fails(EventSink):
        def put(self, batch, number):
            super().put(batch, number)
            raise RuntimeError("lost after the write, before the commit")

    with pytest.raises(Exception, match="lost after the write"):
        Fails(sink.path).run(read())
    sink.run(read())
    sink.run(read())
    assert stored() == first + [(4, 1, "paragraph_error"), (4, 2, "paragraph_complete"), (4, 3, "error")]
