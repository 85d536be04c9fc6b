"""Positioned lines of a page: statistics, reading order, headings, continuation, tables and running headers; blocks packed in order."""

from __future__ import annotations

from lectern.plans.base import Dialect, both
from lectern.plans.scalars import normal, words

# How a sentence ends, the abbreviations that end none, and what the next line starts with if it goes on.
ENDED = r"""[.!?]["'\x{201D}\x{2019}\])]*\s*([0-9]+|[*\x{2020}\x{2021}\x{00A7}\x{00B6}])?\s*$"""
ABBREVIATED = r"(^|[^a-z0-9_])(i\.e\.|e\.g\.|etc\.|et\s+al\.|ibid\.|vs\.|vol\.|fig\.|dr\.|mr\.|ms\.|prof\.)\s*$"
GOES_ON = r"^((and|or|but|that|which|who|whom|whose|where|when|while|because|since|although|though|if|as|to|of|in|on|at|by|with|from|for|into|onto|upon|depending|including)([^a-z0-9_]|$)|[0-9%$(])"
HEADERS = """(select doc_id, lower(trim(line)) as text from text_lines group by doc_id, lower(trim(line))
    having count(distinct page) >= 3 and length(lower(trim(line))) between 20 and 120 and count(case when y < 95 then 1 end) >= 3)"""


def stats(d: Dialect) -> str:
    half = lambda v: f"max(case when at_{v} = floor(n_{v} / 2) + 1 then {v} end)"
    placed = lambda v: f"row_number() over (partition by doc_id, {v} is null order by {v}, line_no) as at_{v}, count({v}) over (partition by doc_id) as n_{v}"
    return f"""select doc_id, coalesce({half('font_in')}, 12) as body_font, {half('gap')} as line_gap, max(x_end - x_start) as widest, {half('width')} as body_width,
        max(case when page = 1 and y > 55 and y < 277 then font end) as title_font from
        (select *, {placed('font_in')}, {placed('gap')}, {placed('width')} from
        (select doc_id, line_no, page, y, x_start, x_end, font, case when y > 79 and y < 713 then font end as font_in, case when y > 79 and y < 713 and font <= 15 then x_end - x_start end as width,
            case when y - lag(y) over (partition by doc_id, page order by y, line_no) between 1 and 49 then y - lag(y) over (partition by doc_id, page order by y, line_no) end as gap from text_lines) g) p group by doc_id"""


both("AGG18", stats)
both("AGG20", lambda d: f"select doc_id, text from {HEADERS} h")
both("PDF11", lambda d: f"select l.doc_id, l.line_no, l.page, l.line from text_lines l left join {HEADERS} h on h.doc_id = l.doc_id and h.text = lower(trim(l.line)) where h.doc_id is null")
both("JN24", lambda d: """select l.doc_id, l.line_no, max(case when b.doc_id is not null then 1 else 0 end) as is_table from text_lines l
    left join (select doc_id, page, 72 as x0, 60 + 17 * (doc_id % 10) as y0, 300 as x1, 180 + 17 * (doc_id % 10) as y1 from (select distinct doc_id, page from text_lines where doc_id % 3 = 0) p) b
    on b.doc_id = l.doc_id and b.page = l.page and l.x_start >= b.x0 - 2 and l.x_end <= b.x1 + 2 and l.y + l.font / 2e0 between b.y0 - 2 and b.y1 + 2 group by l.doc_id, l.line_no""")
both("JN25", lambda d: """select a.doc_id, a.line_no, b.line_no as other from (select doc_id, line_no, page, y, line_no * 7 % 50 as c0, line_no * 7 % 50 + length(line) as c1 from text_lines) a
    join (select doc_id, line_no, page, y, slot, line_no * 11 % 60 as c0, line_no * 11 % 60 + 20 as c1 from text_lines cross join (values (-1), (0), (1)) s(slot)) b
    on b.doc_id = a.doc_id and b.page = a.page and floor(b.y / 20) + b.slot = floor(a.y / 20) and abs(a.y - b.y) <= 20 and a.c0 <= b.c1 and b.c0 <= a.c1""")
HEADING = lambda d: f"({d.like('line', '^[0-9]+([.][0-9]+)*[.]? [A-Z]')} or {d.like('lower(trim(line))', '^(abstract|introduction|methods?|results|discussion|conclusions?|references)$')} or (font >= 16 and not {d.like('line', '[.!?,;:]$')}))"
both("WIN11", lambda d: f"select doc_id, line_no, max(case when {HEADING(d)} then line_no end) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as section, coalesce(max(case when lower(line) like 'references%' then 1 end) over (partition by doc_id order by line_no rows between unbounded preceding and current row), 0) as in_references from text_lines")


def continues(d: Dialect, a: str, b: str) -> str:
    """Does the line ``b`` go on with the sentence of ``a``?"""
    ended = f"({d.like(a, ENDED)} and not {d.like(f'lower({a})', ABBREVIATED)})"
    open_ = " or ".join(f"{d.count(a, '[' + chr(92) + o + ']')} > {d.count(a, '[' + chr(92) + c + ']')}" for o, c in ("()", "[]", "{}"))
    quotes = d.count(a, '["\\x{201C}\\x{201D}]')
    return f"""coalesce(case when {a} = '' or {b} = '' then false when {d.like(a, '-$')} then true when {ended} then false when {d.like(a, '[,;:]$')} then true
        else not ({open_}) and {quotes} % 2 = 0 and {words(d, a)} >= 3 and ({d.like(b, '^[a-z]')} or {d.like(f'lower({b})', GOES_ON)}) end, false)"""


both("PDF16", lambda d: """select doc_id, page, line_no, row_number() over (partition by doc_id, page order by section, kind, y, line_no) as place from
    (select l.doc_id, l.page, l.line_no, l.y, case when c.two and full_width = 0 then case when x_start < c.boundary then 0 else 1 end when full_width = 1 then 2 else 0 end as kind,
        coalesce(sum(case when c.two then full_width else 0 end) over (partition by l.doc_id, l.page order by l.y, l.line_no rows between unbounded preceding and 1 preceding), 0) as section from
        (select *, case when x_end - x_start >= 337 then 1 else 0 end as full_width from text_lines) l
        join (select doc_id, page, count(case when x_start > 245 then 1 end) * 100 >= 15 * count(*) as two, (max(case when x_start <= 245 then least(x_end, 306) end) + min(case when x_start > 245 then x_start end)) / 2e0 as boundary
            from text_lines group by doc_id, page) c on c.doc_id = l.doc_id and c.page = l.page) o""")
both("SRC12", lambda d: "select conv_id, row_y, text, x_start, x_end from (select conv_id, min(y) as row_y, " + d.string_agg("word", "x, word_no", " ") + """ as text, min(x) as x_start, max(x + width) as x_end from
    (select conv_id, word_no, word, x, y, width, sum(case when y - before > 5.6e0 then 1 else 0 end) over (partition by conv_id order by y, word_no) as row_no from
    (select *, lag(y) over (partition by conv_id order by y, word_no) as before from (select conv_id, word_no, word, 72 + 40 * (word_no % 10) as x, turn * 2000 + 17 * cast(floor(word_no / 10) as bigint) + word_no % 3 as y, 6 * length(word) as width from """
    + d.explode("conv_id, turn", "conversations", d.split("text", " +"), "word") + " e) w) b) r group by conv_id, row_no) l")
both("BLK1", lambda d: f"""select page_id, case when marks >= 3 or (length(html) > 3000 and quality > 0.6e0) then 'html' else 'text' end as mode from (select page_id, html, quality,
    {' + '.join(f"case when contains(html, '{t}') then 1 else 0 end" for t in ('<article', '<section', '<main', '<h1', '<h2', '<ul', '<ol', '<table', '<blockquote'))} as marks
    from (select page_id, html, length({d.rr('html', '<[^>]*>', '')}) * 1e0 / greatest(1, length(html)) as quality from pages) q) m""")
both("BLK7", lambda d: "select distinct page_id, trim(p) as paragraph from " + d.explode("page_id", "pages", d.all("html", "<p>([^<]*)", 1), "p") + f" e where length(trim(p)) >= 50 and {words(d, 'p')} >= 8")
both("BLK8", lambda d: "select page_id, p_no, trim(p) as paragraph from " + d.explode("page_id", "pages", f"case when html like '%<p>%' then {d.all('html', '<p>([^<]*)', 1)} else {d.split(d.rr('html', '<[^>]*>', chr(1)), chr(1) + '+')} end", "p") + " e where trim(p) <> ''")
both("BLK10", lambda d: """select p.doc_id, p.paragraph_no, p.paragraph from paragraphs p left join (select doc_id, count(*) as n from text_lines where font = 16 group by doc_id) b on b.doc_id = p.doc_id where b.n is null
    union select doc_id, line_no, line from text_lines where doc_id in (select doc_id from text_lines where font = 16)""")
both("SEG13", lambda d: "select doc_id, " + ", ".join(f"left(trim({d.extract('lower(text)', '(?s)' + p, 1)}), {n}) as {c}" for c, p, n in (
    ("abstract", r"(?:^|\n)abstract[:.\n]\s*(.*?)(?:\nintroduction|$)", 2000), ("introduction", r"(?:^|\n)(?:1[.]? )?introduction[:.\n]\s*(.*?)(?:\n2[. ]|\nmethod|$)", 3000), ("conclusion", r"(?:^|\n)(?:[0-9][.]? )?conclusions?[:.\n]\s*(.*?)(?:\nreferences|$)", 2000))) + " from documents")


def pack(d: Dialect, rows: str, most: int, most_rows: int) -> str:
    """(doc_id, no, chunk): rows (doc_id, no, size) in order, a new chunk where size or count would go over."""
    if d.spark:
        step = f"if(a.n > 0 and (a.size + e.size > {most} or a.n >= {most_rows}), named_struct('at', a.at + 1, 'size', e.size, 'n', 1L, 'out', concat(a.out, array(a.at + 1))), named_struct('at', a.at, 'size', a.size + e.size, 'n', a.n + 1L, 'out', concat(a.out, array(a.at))))"
        zero = "named_struct('at', 1L, 'size', 0L, 'n', 0L, 'out', cast(array() as array<bigint>))"
        chunks = f"aggregate(parts, {zero}, (a, e) -> {step}, a -> a.out)"
        return f"(select doc_id, inline(zip_with(parts, {chunks}, (x, c) -> named_struct('no', x.no, 'chunk', c))) from (select doc_id, array_sort(collect_list(struct(no, size))) as parts from {rows} r group by doc_id) g)"
    return f"""(with recursive r as (select doc_id, no, size, row_number() over (partition by doc_id order by no) as k from {rows} x),
        f as (select doc_id, no, k, cast(1 as bigint) as chunk, cast(size as bigint) as used, cast(1 as bigint) as n from r where k = 1
        union all select r.doc_id, r.no, r.k, case when f.used + r.size > {most} or f.n >= {most_rows} then f.chunk + 1 else f.chunk end, case when f.used + r.size > {most} or f.n >= {most_rows} then r.size else f.used + r.size end,
            case when f.used + r.size > {most} or f.n >= {most_rows} then 1 else f.n + 1 end from f join r on r.doc_id = f.doc_id and r.k = f.k + 1) select doc_id, no, chunk from f)"""


TOKENS = "(select doc_id, id as no, cast(ceil(length(sentence) / 4.0) as bigint) as size from sentences)"


def chunks(d: Dialect) -> str:
    return f"""select c.doc_id, c.chunk, count(*) as sentences, min(c.no) as first_id, min(case when c.back <= 3 then c.no end) as context_from from
        (select doc_id, no, chunk, row_number() over (partition by doc_id, chunk order by no desc) as back from {pack(d, TOKENS, 1200, 30)} p) c group by c.doc_id, c.chunk"""


both("SEG15", chunks)
both("SEG16", lambda d: f"select doc_id, chunk, count(*) as sentences, min(no) as first_id from {pack(d, '(select doc_id, id as no, cast(length(sentence) as bigint) as size from sentences)', 800, 1000000)} p group by doc_id, chunk")
both("PAG1", lambda d: f"select doc_id, chunk as page, count(*) as blocks, min(no) as first_block from {pack(d, '(select doc_id, paragraph_no as no, cast(24 * ceil(length(paragraph) / 60.0) + 16 as bigint) as size from paragraphs)', 720, 1000000)} p group by doc_id, chunk")
