"""A data source of positioned lines: ``spark.read.format("page_lines").load(path)``.

The files below ``path`` are JSON lines, a page each, as a layout extractor gives them: ``doc_id``, ``page``, ``height``,
``blocks`` (``type`` 0 for text, ``lines`` with ``bbox`` and ``spans`` of ``text`` and ``size``) and ``tables`` (boxes).  Files are read in
ranges of some megabytes, so one large file is many tasks.  A row is a page, a table's box or a line.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE = 32 << 20
SCHEMA = "doc_id bigint, page int, kind string, no int, text string, x0 double, y0 double, x1 double, y1 double, font double"


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _store(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)


def page_rows(page: dict) -> Iterator[tuple]:
    """The rows of one page.  Blank spans and lines and blocks that hold no text are left out; a line's font is the upper median of its spans."""
    doc, number = page["doc_id"], page["page"]
    yield doc, number, "page", 0, None, 0.0, 0.0, float(page.get("width") or 0), float(page["height"]), None
    for no, box in enumerate(page.get("tables") or (), 1):
        yield doc, number, "table", no, None, *map(float, box), None
    no = 0
    for block in page.get("blocks") or ():
        for line in block.get("lines") or () if block.get("type", 0) == 0 else ():
            spans = [s for s in line.get("spans") or () if (s.get("text") or "").strip()]
            text = "".join(s["text"] for s in spans).strip()
            if text:
                no += 1
                sizes = sorted(float(s.get("size", 12)) for s in spans)
                yield doc, number, "line", no, text, *map(float, line.get("bbox") or (0, 0, 0, 0)), sizes[len(sizes) // 2]


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        import pyarrow.fs as fs

        store, root = _store(self.path)
        there = store.get_file_info(root)
        files = [there] if there.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        named = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, at, min(f.size, at + self.size)) for f in sorted(named, key=lambda f: f.path) for at in range(0, f.size, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """The pages whose lines start in the range."""
        store, _ = _store(self.path)
        with io.BufferedReader(store.open_input_file(partition.path), 1 << 20) as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the end of a line that starts before
            f.seek(at)
            while at < partition.stop and (raw := f.readline()):
                at += len(raw)
                if raw.strip():
                    yield from page_rows(json.loads(raw))


class PageLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))
