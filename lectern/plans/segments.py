"""Sentences by archetype, clean-up, block merging, alignment of sentences, repair rules, polite forms and table export.

Where both dialects can say a rule it is written once; the others run on Spark alone, and the tests hold them against
rows worked out by hand from the rules.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions import similarity
from lectern.functions.anchors import LAST_RESORT, anchored
from lectern.functions.char_diff import readable, script
from lectern.functions.sentences import PROFILES, clean_text, cut_sentences, in_open_scope, join_lines, split_sentences
from lectern.plans.base import SPARK, Dialect, both, with_views
from lectern.registry import query
from lectern.storage import kept

UNITS = "array<struct<sentence:string,type:string>>"
#: The archetype of a document's category.
ARCHETYPE = {"Academic": "academic", "Literature": "literary", "Essays": "essay", "News": "generic"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str, **given: DataFrame) -> DataFrame:
    """``sql`` over the logical views, which read these tables, or the rows ``given`` in their place."""
    text = re.sub(r"([{}])", r"\1\1", with_views(sql, SPARK))
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables} | given
    for t in read:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{t_{t}}}", text)
    return spark.sql(text, **{f"t_{t}": rows for t, rows in read.items()})


#: Rows of an Arrow batch that a task holds as Python's texts at a time.
SLICE = 200


def _per_row(rows: DataFrame, keep: list[str], columns: list[str], make, kind: str) -> DataFrame:
    """``keep`` and ``out``, what ``make`` gives for the ``columns`` of each row.

    A task turns a slice of rows into Python's objects at a time and hands its results on before the next one, so
    what it holds doesn't grow with the batches, which are of 10,000 rows whatever their length.
    """
    asked = rows.select(*keep, *columns)
    schema = T.StructType([*(asked.schema[k] for k in keep), T.StructField("out", T.DataType.fromDDL(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [make(*r) for r in zip(*(part.column(i).to_pylist() for i in range(len(keep), part.num_columns)), strict=True)]
                out = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(made, arrow.field("out").type)], schema=arrow)

    return asked.mapInArrow(run, schema)


def _per_text(rows: DataFrame, keep: list[str], column: str, make, kind: str) -> DataFrame:
    """``keep`` and ``out``, what ``make`` gives for the text of each row; a null text is empty."""
    return _per_row(rows, keep, [column], lambda x: make(x if isinstance(x, str) else ""), kind)


PARAGRAPHS = r"filter(transform(split(text, '\\n\\s*\\n'), p -> trim(both ' \\t\\r\\n' from p)), p -> p <> '')"
both("SEG1", lambda d: "select doc_id, paragraph_no, trim(" + d.rr("paragraph", r"^\s+|\s+$", "") + ") as paragraph from " + d.explode("doc_id", "documents", d.split("text", r"\n\s*\n"), "paragraph") + " p where " + d.rr("paragraph", r"\s+", "") + " <> ''")


@query("SEG2")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the line breaks inside its sentences joined."""
    return _per_text(documents(spark, sf_dir), ["doc_id"], "text", join_lines, "string").withColumnRenamed("out", "text")


@query("SEG3")
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without tags, entities and zero-width signs, line breaks joined."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return _per_text(pages, ["page_id"], "html", clean_text, "string").withColumnRenamed("out", "text")


@query("SEG4")
def open_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that leave a bracket or quotation open."""
    rows = view(spark, sf_dir, "select id, sentence from sentences", "documents")
    return _per_text(rows, ["id"], "sentence", in_open_scope, "boolean").withColumnRenamed("out", "is_open")


def _sentences(name: str, archetype: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = documents(spark, sf_dir).select("doc_id", F.posexplode(F.expr(PARAGRAPHS)).alias("at", "paragraph"))
        cut = _per_text(texts, ["doc_id", "at"], "paragraph", lambda t: cut_sentences(clean_text(t), archetype), UNITS)
        return cut.select("doc_id", (F.col("at") + 1).alias("paragraph_no"), F.posexplode("out").alias("no", "unit")).select("doc_id", "paragraph_no", (F.col("no") + 1).alias("sentence_no"), "unit.*")

    run.__name__, run.__doc__ = f"{archetype}_sentences", f"The sentences of every paragraph, cut as {archetype} text."
    query(name)(run)


for _name, _archetype in zip(("SEG7", "SEG8", "SEG9", "SEG10"), PROFILES, strict=True):
    _sentences(_name, _archetype)


@query("SEG11")
def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every paragraph, cut by the archetype of the document's category, cleaned, bare marks left out."""
    rows = view(spark, sf_dir, "select id, category, raw_content as text from docs", "documents")

    paragraphs = rows.select("id", "category", F.posexplode(F.expr(PARAGRAPHS)).alias("at", "paragraph"))
    units = _per_row(paragraphs, ["id", "at"], ["paragraph", "category"], lambda t, kind: split_sentences(t, ARCHETYPE.get(kind, "generic")), UNITS)
    cut = units.select("id", "at", F.posexplode("out").alias("no", "unit"))
    return cut.select("id", (F.col("at") + 1).alias("paragraph_no"), (F.col("no") + 1).alias("sentence_no"), "unit.*")


def merged_blocks(blocks: str, shortest: int = 80, longest: int = 800) -> str:
    """The array ``blocks`` of (kind, content) with short paragraphs joined to the ones before, and noise left out.

    A fold that keeps the finished blocks and the one in hand; two paragraphs join if the first is short or
    holds few sentences, or the second is very short, and together they stay below ``longest``.
    """
    few = "size(split(c.content, '[.!?]+')) <= 3 and length(c.content) < 200"
    short = f"length(c.content) < {max(shortest, 80)} or (length(c.content) < 150 and length(n.content) < 150) or ({few}) or length(n.content) < 60"
    joins = f"c.kind = 'paragraph' and n.kind = 'paragraph' and c.content <> '' and n.content <> '' and ({short}) and length(c.content) + length(n.content) < {longest}"
    glued = "struct('paragraph' as kind, concat(c.content, if(c.content rlike '[.!?]$', ' ', '. '), n.content) as content)"
    inner = re.sub(r"\bc\.", "s.now.", joins), re.sub(r"\bc\.", "s.now.", glued)
    step = f"if({inner[0]}, struct(s.done as done, {inner[1]} as now), struct(concat(s.done, array(s.now)) as done, n as now))"
    fold = f"aggregate(slice(bs, 2, size(bs)), struct(slice(bs, 1, 0) as done, bs[0] as now), (s, n) -> {step}, s -> concat(s.done, array(s.now)))"
    real = "length(b.content) >= 10 and (b.kind <> 'paragraph' or exists(split(b.content, '[.!?]+'), x -> length(trim(x)) > 3))"
    fold = re.sub(r"\bbs\b", "w.bs", fold)
    return f"transform(array(struct({blocks} as bs)), w -> if(size(w.bs) = 0, w.bs, filter({fold}, b -> {real})))[0]"


@query("BLK6")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document as blocks, short ones merged."""
    kind = "case when length(line) < 60 and line rlike '^[A-Z][^.!?]*$' then 'heading' else 'paragraph' end"
    lines = r"filter(split(text, '\\n'), x -> trim(x) <> '')"
    blocks = f"transform({lines}, line -> struct({kind} as kind, trim(line) as content))"
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.expr(merged_blocks(blocks))).alias("at", "block"))
    return rows.select("doc_id", (F.col("at") + 1).alias("block_no"), "block.kind", "block.content")


def _pairs(name: str, measure, doc: str, common: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("x"))
        after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
        pairs = turns.join(after, ["conv_id", "turn"])
        if not common:
            return pairs.select("conv_id", "turn", F.expr(measure("x", "y")).alias("similarity"))
        words = pairs.select("*", F.expr(similarity.tokens("x")).alias("xs"), F.expr(similarity.tokens("y")).alias("ys"))
        counted = _per_row(words.select("conv_id", "turn", "x", "y", "xs", "ys"), ["conv_id", "turn", "x", "y"], ["xs", "ys"], similarity.lcs, "int").withColumnRenamed("out", "common")
        return counted.select("conv_id", "turn", F.expr(measure("x", "y", "common")).alias("similarity"))

    run.__name__, run.__doc__ = name.lower(), doc
    query(name)(run)


_pairs("MTH5", similarity.token_lcs, "Consecutive turns by their longest common subsequence of tokens.", common=True)
_pairs("MTH7", similarity.fuzzy, "Consecutive turns by tokens that are nearly equal.")
_pairs("MTH8", similarity.advanced, "Consecutive turns by four measures weighted by length.", common=True)

# Polite Korean endings and their plain forms, applied in this order.
PLAIN = (
    ("입니다", "이다"), ("였습니다", "이었다"), ("이었습니다", "이었다"), ("됩니다", "된다"), ("되었습니다", "되었다"), ("될 것입니다", "될 것이다"),
    ("합니다", "한다"), ("했습니다", "했다"), ("할 것입니다", "할 것이다"), ("하겠습니다", "하겠다"), ("하고 있습니다", "하고 있다"), ("되고 있습니다", "되고 있다"),
    ("하는 것입니다", "하는 것이다"), ("것입니다", "것이다"), ("겁니다", "것이다"), ("일 것입니다", "일 것이다"), ("중입니다", "중이다"), ("없습니다", "없다"),
    ("있습니다", "있다"), ("같습니다", "같다"), ("많습니다", "많다"), ("적습니다", "적다"), ("해 주시기 바랍니다", "하도록 한다"), ("부탁드립니다", "하도록 한다"),
    ("권장드립니다", "권장한다"), ("권고드립니다", "권고한다"), ("주시길 바랍니다", "하도록 한다"), ("주세요", "하도록 한다"), ("해 주세요", "하도록 한다"), ("하세요", "한다"),
    ("입니까?", "인가?"), ("습니까?", "는가?"), ("겠습니까?", "겠는가?"), ("습니다", "다"), ("니다", "다"), ("니까", "냐"),
)
# Fixed value: what marks a polite sentence.
POLITE = "[가-힣]습니다|[가-힣]니다|[가-힣]니까|입니다|됩니다|합니다|하십시오|하시기 바랍니다|주시기 바랍니다|하세요|주세요|드립니다|바랍니다"
STEMS = "연구", "문서를 번역", "결과는 중요", "이 방법이 필요", "내일 시작"


def korean(d: Dialect) -> str:
    """Every sentence with a polite ending, and what reaches every rule: each stem with each ending, and with none."""
    endings = [a for a, _ in PLAIN] + ["", " 하십시오", "; 그리고 — 끝났다"]
    values = ", ".join(f"({i}, '{s}')" for i, s in enumerate(STEMS)), ", ".join(f"({i}, '{e}')" for i, e in enumerate(endings))
    every = f"select -1 - s.i * 100 - e.i as id, s.x || e.x as sentence from (values {values[0]}) s(i, x) join (values {values[1]}) e(i, x) on e.i >= 0"
    return f"({every} union all select s.id, s.sentence || e.x from sentences s join (values {values[1]}) e(i, x) on e.i = s.id % {len(endings)})"


def _plain(d: Dialect) -> str:
    marks = "replace(replace(sentence, ';', '.'), '—', ' — ')"
    x = f"trim({d.rr(marks, '[ ]+', ' ')})"
    for polite, plain in PLAIN:
        x = f"replace({x}, '{polite}', '{plain}')"
    return f"select id, sentence, {d.like('sentence', POLITE)} as polite, {x} as plain from {korean(d)} k"


both("STR11", _plain)

#: Stored documents that reach every rule of the repair check, alone and together.
STORED = """(select t.id, t.source, nullif(nullif(case t.id % 4 when 0 then '[]' when 1 then 'none' else '[{}]' end, 'none'), '') as blocks, nullif(t.id % 5, 4) as version,
    nullif(t.id % 3, 0) as anchors, case when t.id % 7 = 3 then 'pending' else 'completed' end as state, case when t.id % 6 = 1 then t.id % 40 end as feed,
    case t.id % 8 when 1 then 'html' when 2 then 'text' end as kind from docs t)"""
# The messages of the repair check.
BROKEN = {
    "missing structuredContent": "blocks is null",
    "empty structuredContent": "blocks = '[]'",
    "structuredVersion": "coalesce(version, 0) < 2",
    "missing anchorSchemaVersion": "coalesce(anchors, 0) = 0",
    "stuck in pending state": "state = 'pending'",
    "RSS document missing V2 processing": "(source in ('RSS', 'NPR') or coalesce(feed, 0) <> 0) and coalesce(kind, '') <> 'html'",
}
both(
    "FLT24",
    lambda d: "select * from (select id, trim("
    + " || ".join(f"case when {rule} then '{name}; ' else '' end" for name, rule in BROKEN.items())
    + f") as reasons from {STORED} s) r where reasons <> ''",
)

#: Tables in HTML: head and body, attributes, tags and quotes in cells, an empty cell, a short row, and none at all.
TABLES_HTML = (
    (1, '<table class="t"><tr><th>Name</th><th>Size</th></tr><tr><td>one "a"</td><td> 5 </td></tr></table>'),
    (2, "<p>x</p><table><thead><tr><th></th><th>B</th></tr></thead><tbody><tr><td><b>bold</b> cell</td></tr><tr></tr></tbody></table><table><tr><td>second</td></tr></table>"),
    (3, "<p>no table</p>"),
)


#: A row of the table that a conversation is shown as.
TURN_ROW = "('<tr><th>' || role || '</th><td>' || replace(replace(text, '<', ' '), '&', ' ') || '</td></tr>')"


def _table_rows(d: Dialect) -> str:
    """(id, row_no, cells) of the first table of every document; rows without a cell are left out."""
    rows = "(select * from (values " + ", ".join(f"({i}, {d.lit(h)})" for i, h in TABLES_HTML) + f") t(id, html) union all select page_id + 1000, html from pages union all select 1000000 + conv_id, '<table>' || {d.string_agg(TURN_ROW, 'turn', '')} || '</table>' from conversations group by conv_id)"
    first = d.extract("html", r"(?is)<table[^>]*>(.*?)</table>", 1)
    found = d.explode("id", f"(select id, {d.all(first, '(?is)<tr[^>]*>(.*?)</tr>', 1)} as trs from {rows} h)", "trs", "tr")
    cells = d.fn(d.all("tr", "(?is)<t[hd][^>]*>(.*?)</t[hd]>", 1), "transform", "c", f"trim({d.rr('c', '<[^>]*>', '')})")
    return f"(select id, tr_no as row_no, {cells} as cells from {found} f)"


def _csv(d: Dialect) -> str:
    quoted = d.fn("cells", "transform", "c", f"chr(34) || replace(c, chr(34), {'repeat(chr(34), 2)'}) || chr(34)")
    return f"select id, {d.string_agg('line', 'row_no', chr(10))} as csv from (select id, row_no, {d.join(quoted, ',')} as line from {_table_rows(d)} r where {d.size('cells')} > 0) l group by id"


both("SRC14", _csv)


def candidates(ours: DataFrame, theirs: DataFrame, least: float) -> DataFrame:
    """(doc_id, norm, key, likeness): the stored normal forms (doc_id, key, norm) of a document that are at least ``least`` like one of ours.

    Likeness ``least`` needs ``least`` of a form's distinct tokens in the other, repeats counted, so of its tokens in the order of
    their rarity in the document all but that many (less one) are an index: two forms that are alike share one of these.
    Common words come last, so they bring no two forms together that share nothing else.
    """
    alias = "doc_id", "key", "norm"

    def counted(rows: DataFrame) -> DataFrame:
        words = rows.select("doc_id", "key", F.explode(F.filter(F.split("norm", " "), lambda w: w != "")).alias("w")).groupBy("doc_id", "key", "w").agg(F.count("*").alias("c"))
        return words.select("doc_id", "key", "w", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("nth"))

    forms = ours.select("doc_id", "norm").distinct().withColumn("key", F.xxhash64("norm"))
    stored = counted(theirs)
    common = stored.groupBy("doc_id", "w", "nth").agg(F.count("*").alias("many"))

    def index(tokens: DataFrame) -> DataFrame:
        by_form = Window.partitionBy("doc_id", "key")
        ranked = tokens.join(common, ["doc_id", "w", "nth"], "left").select(
            "doc_id", "key", "w", "nth", F.row_number().over(by_form.orderBy(F.coalesce("many", F.lit(0)), "w", "nth")).alias("place"),
            F.count("*").over(by_form).alias("n"), F.count_if(F.col("nth") == 1).over(by_form).alias("different"),
        )
        return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("different") * F.lit(least) - 1e-9) + 1).select("doc_id", "w", "nth", "key")

    met = index(counted(forms.select(*alias))).withColumnRenamed("key", "own").join(index(stored), ["doc_id", "w", "nth"]).select("doc_id", "own", "key").distinct()
    texts = met.join(forms.select("doc_id", F.col("key").alias("own"), F.col("norm")), ["doc_id", "own"]).join(theirs.select("doc_id", "key", F.col("norm").alias("theirs")), ["doc_id", "key"])
    return texts.withColumn("likeness", F.expr(similarity.light("norm", "theirs"))).where(F.col("likeness") >= least).select("doc_id", "norm", "key", "likeness")


ANCHORED = "doc_id bigint, block_no bigint, no bigint, id bigint, how string, likeness double, start_id bigint, end_id bigint, matched bigint, sentences bigint"


def anchoring(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """``ANCHORED`` rows: the matches of every block sentence, and the anchors of blocks (``no`` null).

    ``blocks``: (doc_id, block_no, no, text), ``stored``: (doc_id, id, text).  Block by block, each sentence takes the first free
    stored sentence of its normal form, else the free one most like it that reaches its threshold; a block
    without any takes what is at least 0.30 alike.  Ids in the range of a block's matches are free no more; a block whose range
    holds a taken one gets no anchor.  The last anchor is extended to the document's last sentence.

    Both are dealt by document once; a task holds one document's sentences at a time and finds what is alike by their
    rarest tokens, only for sentences that have no free equal.  Rows of a null document, block, number or text take no part.
    """
    from lectern.plans.scalars import normal

    def normed(rows: DataFrame, *columns) -> DataFrame:
        return rows.where("doc_id is not null and text is not null").select("doc_id", *columns, F.expr(normal(SPARK, "text")).alias("norm"))

    number = lambda name, of: F.col(of).cast("bigint").alias(name)
    asking = normed(blocks.where("block_no is not null and no is not null"), number("block_no", "block_no"), number("no", "no"), F.expr(threshold("text")).cast("double").alias("least"))
    forms = normed(stored.where("id is not null"), F.lit(None).cast("bigint").alias("block_no"), number("no", "id"), F.lit(None).cast("double").alias("least"))
    rows = asking.unionByName(forms).select("doc_id", "block_no", "no", "norm", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = (r for _, of in itertools.groupby(flat, lambda r: r[0]) for r in anchored(of))
        names = [(n, pa.string() if n == "how" else pa.float64() if n == "likeness" else pa.int64()) for n in (c.split()[0] for c in ANCHORED.split(", "))]
        while part := list(itertools.islice(out, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), names, strict=True)], schema=pa.schema(names))

    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", F.col("block_no").asc_nulls_first(), "no", "norm")
    # written once, so that nobody who reads them twice deals and compares the texts again; they are numbers and no texts
    return kept(dealt.mapInArrow(run, ANCHORED), "anchors")


def threshold(x: str) -> str:
    """The least likeness that counts as a match: by length, lower with digits, signs, Hangul and few words; 0.35 to 0.85."""
    base = f"case when length({x}) < 10 then 0.35e0 when length({x}) < 20 then 0.4e0 when length({x}) < 40 then 0.5e0 when length({x}) < 80 then 0.55e0 when length({x}) < 150 then 0.6e0 when length({x}) < 300 then 0.65e0 else 0.7e0 end"
    less = (("[0-9]", "0.05e0"), (r"[^A-Za-z0-9_\\s가-힣]", "0.03e0"), ("[가-힣]", "0.02e0"))
    out = base + "".join(f" - if({x} rlike '{p}', {v}, 0e0)" for p, v in less) + rf" - if(size(split({x}, '\\s+')) < 3, 0.1e0, 0e0)"
    return f"greatest(0.35e0, least(0.85e0, {out}))"


#: Block sentences made from stored ones: as they are, in capitals, with another first word, and with the last third cut.
EDITED = """select doc_id, paragraph_no as block_no, id as no, case id % 4 when 0 then sentence when 1 then upper(sentence) when 2 then 'Changed ' || substr(sentence, instr(sentence, ' ') + 1)
    else left(sentence, cast(length(sentence) * 2 / 3 as int)) end as text from sentences"""


def _anchoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchoring(view(spark, sf_dir, EDITED, "documents"), view(spark, sf_dir, "select doc_id, id, sentence as text from sentences", "documents"))


@query("JN26")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sentence of every block sentence, none for two blocks."""
    return _anchoring(spark, sf_dir).where("no is not null").select("doc_id", "block_no", "no", "id", "how", F.col("likeness").alias("similarity"))


@query("ANC1")
def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor of every block."""
    return _anchoring(spark, sf_dir).where("no is null").select("doc_id", "block_no", "start_id", "end_id", "matched", "sentences")


@query("STR18")
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer keeps, lacks and adds: every sentence against what became of it, in readable steps."""
    steps = {0: "keep", -1: "cut", 1: "put"}

    answers = f"select s.id, s.sentence, e.text as answer from sentences s join ({EDITED}) e on e.no = s.id"
    rows = view(spark, sf_dir, answers, "documents")
    told = _per_row(rows, ["id"], ["sentence", "answer"], lambda x, y: [(steps[op], t) for op, t in readable(script(x, y))], "array<struct<op:string,text:string>>")
    return told.select("id", F.posexplode("out").alias("at", "step")).select("id", (F.col("at") + 1).alias("step_no"), "step.op", "step.text")
