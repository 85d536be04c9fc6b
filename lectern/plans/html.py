"""Blocks of HTML pages: a stack parser gives the elements of the content in tree order, SQL makes blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.html_tree import elements
from lectern.plans.segments import merged_blocks
from lectern.registry import query

LEAST, LONG, PIECE, WHOLE = 50, 2000, 800, 1500
# Fixed value: how lines about the page, and no part of it, begin.
ABOUT = "(?i)^(Posted by|Filed under|Tags:|Share:|Follow:|Subscribe:|Copyright|©|Read more|Continue reading|Advertisement|Sponsored)"
SENTENCES = r"split({}, '(?<=[.!?])\\s+(?=[A-Z])')"


def pieces(text: str, most: int = PIECE) -> str:
    """The array of ``text`` cut at sentence ends into pieces of up to ``most`` signs; a longer sentence is a piece."""
    step = f"if(length(p.now) + length(s) > {most} and p.now <> '', struct(concat(p.done, array(p.now)) as done, s as now), struct(p.done as done, if(p.now = '', s, concat(p.now, ' ', s)) as now))"
    return f"filter(transform(aggregate({SENTENCES.format(text)}, struct(cast(array() as array<string>) as done, '' as now), (p, s) -> {step}, p -> concat(p.done, array(p.now))), x -> trim(x)), x -> x <> '')"


def html_blocks(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, block_no, kind, level, content) of every page (page_id, html).

    Short elements and lines about the page are left out, a heading or paragraph that the page has already counts once, long
    texts are cut at sentence ends; a page without any block has its plain text cut; short blocks are merged.  Headings have
    their level, other blocks none.  Null and empty pages have no blocks; other columns are not read.
    """

    @F.pandas_udf("array<struct<tag:string,text:string,caption:string>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in parts:
            yield html.map(elements)

    rows = pages.select("page_id", F.posexplode(found("html")).alias("at", "e")).select("page_id", "at", "e.*")
    text = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ''), '&[a-zA-Z0-9#]+;', ' '), '\\s+', ' '))"
    rows = rows.withColumn("content", F.when(F.col("tag").isin("#direct", "#all", "figcaption"), F.col("text")).otherwise(F.expr(text)))
    kept = rows.where(f"tag in ('#direct', 'figcaption', '#all') or ( length(content) >= {least} and not content rlike '{ABOUT}')")
    heading = "tag rlike '^h[1-6]$'"
    kind = f"case when {heading} then concat('heading:', right(tag, 1)) when tag = 'li' then 'list' when tag = 'blockquote' then 'quote' when tag = 'figure' then 'figure' when tag = 'img' then 'image' when tag in ('table', '#all') then tag else 'paragraph' end"
    shown = "case when tag = 'figure' then concat('[Figure: ', caption, ']') when tag = 'img' then concat('[Image: ', caption, ']') when tag = 'table' then concat('[Table: ', caption, ']') else content end"
    long = f"(length(content) > {LONG} and tag not in ('#direct', 'figcaption', '#all'))"
    once = f"(({heading} or tag = 'p') and not {long})"
    nth = f"row_number() over (partition by page_id, {once}, if({heading}, 'h', tag), if({once}, lower(content), cast(at as string)) order by at)"
    kept = kept.withColumn("nth", F.expr(nth)).where(f"nth = 1 or not {once}")
    cut = kept.selectExpr("page_id", "at", f"posexplode(if({long}, transform({pieces('content')}, x -> struct('paragraph' as kind, x as content)), array(struct({kind} as kind, {shown} as content)))) as (k, b)")
    whole = cut.groupBy("page_id").agg(F.expr("transform(array_sort(collect_list(if(b.kind <> '#all', struct(at, k, b), null))), x -> x.b) as blocks"), F.expr("max(if(b.kind = '#all', b.content, null)) as text"))
    plain = r"transform(split(text, '\\n\\s*\\n'), x -> trim(regexp_replace(x, '\\s+', ' ')))"
    alone = f"filter(if(size({plain}) < 3 and length(text) > 1000, {pieces('text')}, {plain}), x -> length(x) > 50)"
    blocks = whole.selectExpr("page_id", f"if(size(blocks) = 0 and length(text) > 100, transform({alone}, x -> struct('paragraph' as kind, x as content)), blocks) as blocks")
    one = f"size(blocks) = 1 and length(get(blocks, 0).content) > {WHOLE} and size({SENTENCES.format('get(blocks, 0).content')}) > 10"
    blocks = blocks.selectExpr("page_id", f"if({one}, transform({pieces('get(blocks, 0).content')}, x -> struct('paragraph' as kind, x as content)), blocks) as blocks")
    merged = blocks.select("page_id", F.posexplode(F.expr(merged_blocks("blocks", least))).alias("at", "b"))
    return merged.selectExpr("page_id", "at + 1 as block_no", "split_part(b.kind, ':', 1) as kind", "cast(nullif(split_part(b.kind, ':', 2), '') as int) as level", "b.content")


@query("BLK3")
def page_tree_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every page."""
    return html_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet"))
