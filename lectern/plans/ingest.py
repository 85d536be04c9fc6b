"""Ingest, dates, tags and edits: what the other modules leave open and built-in functions can say."""

from __future__ import annotations

from lectern.plans.base import both
from lectern.plans.scalars import SPACES, snippet, words

both("SRC6", lambda d: f"select doc_id, {snippet(d, 'text', 500)} as snippet, {words(d, 'text')} as word_count, lang from documents")
both("SRC7", lambda d: """select page_id, host, n from (select page_id, host, row_number() over (partition by host order by page_id) as n
    from (select host, title, url, min(page_id) as page_id from articles group by host, title, url) a) b where n <= 10""")
both("STR13", lambda d: f"select page_id, trim({d.rr(d.rr(d.rr('html', '<[^>]*>', ' '), '&[#a-zA-Z0-9]+;', ' '), SPACES + '+', ' ')}) as plain from pages")
both("STR14", lambda d: f"select doc_id, paragraph_no, {d.extract('paragraph', '^#+ *([^#]+)$', 1)} as marked, case when length(paragraph) < 60 and paragraph like '%:' then paragraph else '' end as titled from paragraphs")
both("DT6", lambda d: "select o_orderkey, " + (
    "cast(add_months(cast(o_orderdate as date), 1) as string) as month_later, cast(add_months(cast(o_orderdate as date), 12) as string) as year_later" if d.spark
    else "cast(cast(o_orderdate + interval 1 month as date) as varchar) as month_later, cast(cast(o_orderdate + interval 1 year as date) as varchar) as year_later") + " from orders")
# the next run of five schedules, in days; day 0 of the tables' time is a Monday, day_no 0 a Sunday
both("DT7", lambda d: f"""select event_id, day + case when h < 12 then 0.5e0 else 1e0 end as half_day, day + 1 + 2 / 24e0 as next_night, day + 1 + 3 / 24e0 as cleanup,
    day + case when day_no = 0 then 1 when day_no = 6 then 2 when h >= 9 then 1 else 0 end + 9 / 24e0 as weekday, day + case when (8 - day_no) % 7 = 0 then 7 else (8 - day_no) % 7 end + 6 / 24e0 as monday
    from (select event_id, {d.days('ts')} as day, hour(ts) as h, ({d.days('ts')} + 1) % 7 as day_no from events) e""")
both("MTH12", lambda d: f"""select p_partkey, round(1.05e0 / (0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b + 0.05e0), 6) as with_white from (select p_partkey, {', '.join(
    f"case when {c} / 255e0 <= 0.03928e0 then {c} / 255e0 / 12.92e0 else power(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end as {c}" for c in 'rgb')}
    from (select p_partkey, p_partkey * 37 % 256 as r, p_partkey * 91 % 256 as g, p_partkey * 151 % 256 as b from part) c) l""")
TAGS = "case when p_partkey % 2 = 0 then '[\"' || p_brand || '\",\"' || p_type || '\"]' else p_brand || ', ' || p_type end"
both("ARR1", lambda d: f"select id, {d.join('coalesce(from_json(x, ' + chr(39) + 'array<string>' + chr(39) + '), ' + d.split('x', ', *') + ')' if d.spark else 'case when json_valid(x) then from_json(x, ' + chr(39) + chr(91) + chr(34) + 'VARCHAR' + chr(34) + chr(93) + chr(39) + ') else ' + d.split('x', ', *') + ' end', '|')} as tags from (select p_partkey as id, {TAGS} as x from part) t")
both("JSN1", lambda d: f"select id, {'from_json(x, ' + chr(39) + 'array<string>' + chr(39) + ') is not null' if d.spark else 'json_valid(x)'} as valid from (select p_partkey as id, {TAGS} as x from part) t")
both("JN18", lambda d: "select doc_id, paragraph_no, sentence_id from " + d.explode(
    "doc_id, paragraph_no", "(select doc_id, paragraph_no, min(id) as first_id, max(id) as last_id from sentences group by doc_id, paragraph_no)",
    "sequence(first_id, last_id)" if d.spark else "range(first_id, last_id + 1)", "sentence_id") + " r")
both("JN29", lambda d: "select b.id, n.id as note, n.content from notebooks b left join (select notebook, max(id) as last_id from notes group by notebook) l on l.notebook = b.id left join notes n on n.id = l.last_id")
both("WIN5", lambda d: """select doc_id, paragraph_no, length(paragraph) - lag(length(paragraph)) over (partition by doc_id order by paragraph_no) as shift,
    coalesce(lag(length(paragraph)) over (partition by doc_id order by paragraph_no) > 80, false) as after_long, lead(length(paragraph)) over (partition by doc_id order by paragraph_no) as next_length from paragraphs""")
def pieces(d) -> str:
    """Pieces of a text by the reader's page, by the book import, and, at most 400, by the paper import."""
    plain = d.rr(d.rr("text", r"\s+", " "), r"(^|[^A-Za-z0-9_])((?i:et al|vs|cf|etc))\.", "$1$2●")
    papers = d.split(d.rr(f"trim({plain})", r"([.!?])\s+([A-Z])", "$1¶¶$2"), "¶¶")
    papers = d.fn(papers, "transform", "p", "trim(replace(p, '●', '.'))")
    # What captions and unwanted paragraphs look like.
    captions = r"^(?i:Figure|Table|Equation|Algorithm|Fig\.|Tab\.|Ref\.|References|Bibliography|Acknowledgments)"
    unwanted = (captions, r"^[0-9.)\]]+\s", r"^[A-Z\s0-9.\-]{15,}$", r"^\s*[\[(].*[\])]\s*$", r"^(?i:Abstract|Introduction|Conclusion|Discussion|Method|Results|Related Work)$")
    papers = d.fn(papers, "filter", "p", "length(p) > 15 and length(p) < 800 and " + d.size(d.split("p", " ")) + " >= 3 and " + " and ".join(f"not {d.like('p', u)}" for u in unwanted))
    bare = lambda by: d.fn(d.split("text", by), "transform", "p", d.rr("p", r"^\s+|\s+$", ""))
    kinds = {
        "page": (d.fn(bare(r"[.!?]+[\"')\]]*\s+"), "filter", "p", "p <> ''"), 1_000_000_000),
        "book": (d.fn(bare("[.!?]+"), "filter", "p", "length(p) > 10 and length(p) < 500"), 1_000_000_000),
        "paper": (papers, 400),
    }
    return " union all ".join(f"select doc_id, '{kind}' as splitter, piece_no, piece as sentence from " + d.explode("doc_id", "documents", array, "piece") + f" {kind} where piece_no <= {most}" for kind, (array, most) in kinds.items())


both("SEG12", pieces)
both("SRT7", lambda d: f"select doc_id, paragraph_no, {'element_at' if d.spark else 'list_extract'}(w, cast(doc_id % {d.size('w')} as int) + 1) as pick from (select doc_id, paragraph_no, {d.split('paragraph', ' +')} as w from paragraphs) p")
both("BLK5", lambda d: f"select doc_id, paragraph_no, case when {d.like('paragraph', '^#+ ')} or {d.like('paragraph', '^[*][*].+[*][*]$')} then 'heading' else 'paragraph' end as kind from paragraphs")
both("FLT27", lambda d: """select 'group' as kind, cast(n_nationkey as bigint) as id, n_name as name from nation where n_regionkey = 1 union all select 'notebook', id, name from notebooks where group_id = 3
    union all select 'session', event_id, event_type from events where user_id = 3 and event_type in ('click', 'view') union all select 'word', id, term from glossary where doc_id = 8 and term like '%a%'
    union all select 'attempt', event_id, rating from review_events where user_id = 3 and item = 5""")
both("DML5", lambda d: """select id, notebook, content, cast(null as bigint) as copied_from from notes
    union all select 100000000 + id, notebook + 1, content, id from notes where notebook % 10 = 0""")
both("DML8", lambda d: "select n.id, n.notebook from notes n left join (select id from notebooks where group_id in (1, 2, 3)) gone on gone.id = n.notebook where gone.id is null")
# group 7 goes and its notebooks lose it; those of one kind move to group 3
both("DML18", lambda d: "select id, name, case when kind = 'BUILDING' and id % 10 = 1 then 3 when group_id = 7 then null else group_id end as group_id from notebooks")
