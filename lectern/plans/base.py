"""Queries written once for two SQL dialects: Spark runs one, the other is its oracle.

``both(name, sql)`` registers ``sql(d)``, where ``d`` spells what the dialects spell differently.  The
logical tables of a text library (documents, sentences, notes, feeds, review events) are views over
the given tables, named in ``VIEWS`` and put before a query that names them.  Times are whole hours
or days after 2024-01-01, and every query that needs a present has one as a number.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.registry import query

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


class Dialect:
    """What Spark and the oracle spell differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def lit(self, text: str) -> str:
        """A string literal."""
        text = text.replace("'", "''" if not self.spark else "\\'")
        return f"'{text}'"

    def pattern(self, p: str) -> str:
        return "'" + (p.replace("\\", "\\\\").replace("'", "\\'") if self.spark else p.replace("'", "''")) + "'"

    def rr(self, x: str, p: str, to: str) -> str:
        """Replace every match."""
        to = to if self.spark else re.sub(r"\$(\d)", r"\\\1", to)
        return f"regexp_replace({x}, {self.pattern(p)}, '{to}'" + (")" if self.spark else ", 'g')")

    def like(self, x: str, p: str) -> str:
        """Does the pattern match anywhere?"""
        return f"({x} rlike {self.pattern(p)})" if self.spark else f"regexp_matches({x}, {self.pattern(p)})"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def count(self, x: str, p: str) -> str:
        """How often the pattern matches."""
        return f"cast(regexp_count({x}, {self.pattern(p)}) as bigint)" if self.spark else f"cast(len(regexp_extract_all({x}, {self.pattern(p)})) as bigint)"

    def all(self, x: str, p: str, group: int = 0) -> str:
        """Every match, as an array."""
        return f"regexp_extract_all({x}, {self.pattern(p)}, {group})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.pattern(by)})" if self.spark else f"regexp_split_to_array({x}, {self.pattern(by)})"

    def size(self, x: str) -> str:
        return f"cast({'size' if self.spark else 'len'}({x}) as bigint)"

    def fn(self, x: str, kind: str, var: str, body: str) -> str:
        """A higher-order function: kind transform or filter."""
        name = kind if self.spark else {"transform": "list_transform", "filter": "list_filter"}[kind]
        return f"{name}({x}, {f'{var} ->' if self.spark else f'lambda {var}:'} {body})"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})" if self.spark else f"list_distinct({x})"

    def ordered_distinct(self, x: str) -> str:
        """The elements in the order of their first places."""
        return f"array_distinct({x})" if self.spark else f"list_transform(list_sort(list_transform(list_distinct({x}), lambda e: {{'at': list_position({x}, e), 'e': e}})), lambda s: s.e)"

    def join(self, x: str, sep: str) -> str:
        return f"array_join({x}, '{sep}')" if self.spark else f"array_to_string({x}, '{sep}')"

    def days(self, ts: str) -> str:
        """Whole days after 2024-01-01."""
        return f"datediff({ts}, date'2024-01-01')" if self.spark else f"date_diff('day', date '2024-01-01', cast({ts} as date))"

    def explode(self, select: str, source: str, array: str, name: str) -> str:
        """A row for each element, with its place from 1 as ``<name>_no``."""
        if self.spark:
            return f"(select {select}, {name}_at + 1 as {name}_no, {name} from {source} lateral view posexplode({array}) x as {name}_at, {name})"
        return f"(select {select}, unnest(range(1, len({array}) + 1)) as {name}_no, unnest({array}) as {name} from {source})"

    def string_agg(self, x: str, order: str, sep: str) -> str:
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order}, {x} as item))), y -> y.item), '{sep}')"
        return f"string_agg({x}, '{sep}' order by {order})"

    def url(self, x: str, part: str) -> str:
        found = {"host": (r"^https?://([^/?#:]+)", 1), "path": (r"^https?://[^/?#]+([^?#]*)", 1), "query": (r"^[^?#]*\?([^#]*)", 1)}[part]
        return self.extract(x, *found)


SPARK, ORACLE = Dialect(True), Dialect(False)

VIEWS: dict[str, Callable[[Dialect], str]] = {
    "docs": lambda d: """select doc_id as id, split_part(text, chr(10), 1) as title, lang as source_language, source, text as raw_content,
        case doc_id % 4 when 0 then 'Academic' when 1 then 'Literature' when 2 then 'News' else 'Essays' end as category,
        doc_id % 3 <> 0 as is_public, doc_id % 7 = 0 as is_archived, cast(doc_id % 720 as bigint) as created_h,
        case when doc_id % 5 = 0 then null else cast((doc_id * 7) % 720 as bigint) end as activity_h, cast(doc_id % 150 as bigint) as owner,
        case doc_id % 23 % 6 when 0 then 'uploaded' when 1 then 'explore' when 2 then 'rss' else 'web' end as source_type,
        case when doc_id % 13 < 2 then cast(doc_id % 720 as bigint) + 240 end as expires_h from documents""",
    "paragraphs": lambda d: "select doc_id, paragraph_no, trim(paragraph) as paragraph from "
    + d.explode("doc_id", "documents", d.split("text", r"\n"), "paragraph")
    + " p where trim(paragraph) <> ''",
    "sentences": lambda d: "select doc_id, paragraph_no, sentence_no, doc_id * 10000000000 + paragraph_no * 100000 + sentence_no as id, sentence from "
    + d.explode("doc_id, paragraph_no", "paragraphs", d.split("paragraph", r"\. "), "sentence")
    + " s where sentence <> ''",
    "review_events": lambda d: "select user_id, event_id % 40 as item, ts, event_id, value >= 50 as ok, case when value < 100 then 'again' when value < 250 then 'hard' else 'good' end as rating from events",
    "item_state": lambda d: """select user_id, item, least(5, count(*) - coalesce(max(case when not ok then n end), 0)) as level, count(*) as reviews,
        max(day) as last_day from (select user_id, item, ok, row_number() over (partition by user_id, item order by ts, event_id) as n, """
    + d.days("ts")
    + " as day from review_events) e group by user_id, item",
    "articles": lambda d: f"select page_id, {d.extract('html', '<title>([^<]*)</title>', 1)} as title, url, {d.url('url', 'host')} as host, html from pages",
    "feed_runs": lambda d: "select user_id % 40 as feed, event_id, ts, event_type <> 'error' as ok from events",
    "glossary": lambda d: "select p_partkey as id, p_name as term, p_type as translation, p_brand as tag, cast(p_size % 6 as bigint) as mastery, p_partkey % 200 as doc_id from part",
    "notebooks": lambda d: "select c_custkey as id, c_name as name, c_nationkey as group_id, c_mktsegment as kind from customer",
    "notes": lambda d: "select o_orderkey as id, o_custkey as notebook, case when o_orderstatus = 'F' then null else o_orderpriority end as content, o_totalprice as weight from orders",
    "text_lines": lambda d: """select doc_id, line_no, (line_no - 1) // 10 + 1 as page, 60 + 17 * ((line_no - 1) % 10) as y, x_start, x_start + least(428, 4 * length(line)) as x_end,
        case when length(line) < 40 then 16 when line_no % 11 = 0 then 10 else 12 end as font, line from
        (select doc_id, paragraph_no as line_no, case when doc_id % 5 = 0 and paragraph_no % 2 = 0 then 330 else 72 end as x_start, paragraph as line from paragraphs) p
        union all select distinct doc_id, 1000000 + (paragraph_no - 1) // 10, (paragraph_no - 1) // 10 + 1, 30, 72, 300, 10, 'Running header of document ' || doc_id from paragraphs where doc_id % 4 = 0""".replace("//", "div" if d.spark else "//"),
    "token_usage": lambda d: "select user_id, cast(sum(cast(floor(value) as bigint)) as bigint) as tokens, count(*) as calls from events where event_type in ('purchase', 'click') group by user_id",
    "limits": lambda d: "select * from (values (0, 'free', 300), (1, 'starter', 1500), (2, 'pro', 6000), (3, 'premium', 50000)) as l(code, plan, cap)",
}


def with_views(sql: str, d: Dialect) -> str:
    """``sql`` with the definitions of the views that it names, and theirs, before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                add(VIEWS[name](d))
                if name not in need:
                    need.append(name)

    add(sql)
    if not need:
        return sql
    own = ", " + sql.removeprefix("with ") if sql.startswith("with ") else " " + sql
    return "with " + ", ".join(f"{n} as ({VIEWS[n](d)})" for n in need) + own


def both(name: str, sql: Callable[[Dialect], str]) -> None:
    """Registers a query and its oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = re.sub(r"([{}])", r"\1\1", with_views(sql(SPARK), SPARK))
        named = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", text)]
        tables = {f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in named}
        for t in named:
            text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{t_{t}}}", text)
        return spark.sql(text, **tables)

    run.__name__ = name.lower()
    query(name, with_views(sql(ORACLE), ORACLE))(run)
