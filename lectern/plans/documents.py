"""Documents to paragraphs, sentences and blocks, where built-in functions can say it."""

from __future__ import annotations

from lectern.plans.base import both

SECTIONS = "^(abstract|introduction|methods?|results|discussion|conclusions?|references)$"

both("SEG5", lambda d: f"select id, {d.like('sentence', ': [A-Z][a-z]+( [^ ]+){4,}')} as opens from sentences")
both("SEG6", lambda d: f"select id, {d.like('sentence', '(et al|e[.]g|i[.]e|vs|cf|Fig|Eq)[.]?$')} as abbreviated from sentences")
both("BLK2", lambda d: f"""select doc_id, paragraph_no, case when {d.like('paragraph', '^#+ ')} then 'heading' when {d.like('lower(paragraph)', SECTIONS)} then 'heading'
    when {d.like('paragraph', '^([-*•]|[0-9]+[.)]) ')} then 'list' when length(paragraph) < 60 and not {d.like('paragraph', '[.!?,;:]$')} then 'heading' else 'paragraph' end as kind from paragraphs""")
both("BLK4", lambda d: f"select page_id, {d.size(d.fn(d.split(d.rr('html', '</(p|div|li|h1)>', chr(1)), chr(1)), 'filter', 'x', 'trim(x) <> ' + chr(39) * 2))} as blocks from pages")
both("ANC2", lambda d: "select doc_id, paragraph_no, min(id) as first_id, max(id) as last_id, count(*) as n from sentences group by doc_id, paragraph_no")
both("OUT1", lambda d: "select doc_id, paragraph_no, left(paragraph, 60) as preview from paragraphs where length(paragraph) < 80")
both("PDF13", lambda d: "select event_id, cast(floor(value / 20) as bigint) * 20 as slot, user_id % 3 + 1 as page from events")
#: Books with every marker, one without an end, one without a line after its start, and one without any; then the documents.
BOOKS = """(select * from (values (-1, 'head*** START OF THE PROJECT GUTENBERG EBOOK A ***|body one|*** END OF THE PROJECT GUTENBERG EBOOK A ***tail'), (-2, 'x*** START OF THIS PROJECT GUTENBERG EBOOK|two|*** END OF THIS PROJECT GUTENBERG EBOOK z'),
    (-3, 'START OF THE PROJECT GUTENBERG EBOOK|three'), (-4, '*** START OF THE PROJECT GUTENBERG EBOOK'), (-5, ' no marker ')) b(id, text))"""


def body(d) -> str:
    """What stands between the line of the start mark and the end mark."""
    start, end = "START OF (THE|THIS) PROJECT GUTENBERG EBOOK", "([*]{3} )?END OF THE PROJECT GUTENBERG EBOOK|[*]{3} END OF THIS PROJECT GUTENBERG EBOOK"
    rows = f"(select cast(doc_id as bigint) as id, text from documents union all select cast(id as bigint), replace(text, '|', chr(10)) from {BOOKS} b)"
    cut = d.rr(d.rr("text", r"(?s)^.*?" + start + r"[^\n]*\n", ""), f"(?s)({end}).*$", "")
    return f"select id, {d.rr(cut, chr(94) + chr(92) + 's+|' + chr(92) + 's+$', '')} as body from {rows} r"


both("SRC9", body)
def exported(d) -> str:
    """The sentences of a document as plain text, a Markdown list, CSV lines, and JSON lines with title and number."""
    quoted = "chr(34) || replace(s.sentence, chr(34), chr(34) || chr(34)) || chr(34)"
    escaped = f"chr(34) || replace(replace(s.sentence, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || chr(34)"
    if d.spark:  # a document's sentences are gathered once for all formats
        quote, escape = "replace(x.sentence, chr(34), chr(34) || chr(34))", "replace(replace(x.sentence, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
        lines = {"txt": "x.sentence", "md": "'- ' || x.sentence", "csv": f"cast(x.sentence_no as string) || ',' || chr(34) || {quote} || chr(34)", "json": "'{\"n\":' || cast(x.sentence_no as string) || ',\"text\":' || chr(34) || " + escape + " || chr(34) || '}'"}
        bodies = ", ".join(f"'{kind}', array_join(transform(ss, x -> {line}), chr(10))" for kind, line in lines.items())
        return f"select doc_id, stack({len(lines)}, {bodies}) as (format, body) from (select doc_id, array_sort(collect_list(struct(id, sentence_no, sentence))) as ss from sentences s group by doc_id) g"
    kinds = {"txt": "s.sentence", "md": "'- ' || s.sentence", "csv": f"cast(s.sentence_no as string) || ',' || {quoted}", "json": "'{\"n\":' || cast(s.sentence_no as string) || ',\"text\":' || " + escaped + " || '}'"}
    return " union all ".join(f"select doc_id, '{kind}' as format, {d.string_agg('line', 'id', chr(10))} as body from (select s.doc_id, s.id, {line} as line from sentences s) {kind} group by doc_id" for kind, line in kinds.items())


both("SRC13", exported)
