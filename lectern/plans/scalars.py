"""Scalar functions: normalisation, hashes, snippets, difficulty, URLs, dates, similarity, tags."""

from __future__ import annotations

from lectern.plans.base import Dialect, both

# Fixed value: white space as a browser's \\s has it, beyond ASCII.
SPACES = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TITLE = "split_part(text, chr(10), 1)"


def normal(d: Dialect, x: str) -> str:
    """Lower case, dashes and quotes made plain, all but ASCII word characters and Hangul dropped, white space collapsed."""
    if d.spark:  # what dashes and dots become is dropped as well; signs beyond ASCII are asked for behind one range, as most signs are in it
        beyond = r"[\x{00A0}-\x{FFFF}&&[" + SPACES[3:-1]
        return "trim(" + d.rr(d.rr(f"lower({x})", rf"[^\w\s{beyond}\x{{AC00}}-\x{{D7A3}}]]]+", ""), rf"[\s{beyond}]]]+", " ") + ")"
    x = d.rr(f"lower({x})", r"[\x{2013}\x{2014}]", "-")
    x = d.rr(x, r"\x{2026}", "...")
    x = d.rr(x, r"[^a-z0-9_A-Z\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{AC00}-\x{D7A3}]", "")
    return f"trim({d.rr(x, SPACES + '+', ' ')})"


def words(d: Dialect, x: str) -> str:
    return d.size(d.fn(d.split(x, SPACES + "+"), "filter", "w", "w <> ''"))


def snippet(d: Dialect, x: str, n: int) -> str:
    """At most ``n`` characters, cut at the last space if that is beyond 70 %, with an ellipsis."""
    flat = f"trim({d.rr(d.rr(x, '<[^>]*>', ' '), SPACES + '+', ' ')})"
    cut = f"left({flat}, {n})"
    last = f"({n} - instr(reverse({cut}), ' '))"
    return f"case when length({flat}) <= {n} then {flat} when instr({cut}, ' ') > 0 and {last} > {0.7 * n} then left({cut}, cast({last} as int)) || '…' else {cut} || '…' end"


both("STR1", lambda d: f"select doc_id, {normal(d, 'text')} as normal from documents")
both("STR2", lambda d: f"select doc_id, {'sha1' if d.spark else 'sha1'}({normal(d, d.rr(d.rr('text', '<[^>]*>', ''), '&[a-zA-Z0-9#]+;', ' '))}) as hash from documents")
both("STR3", lambda d: "select page_id, replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') as plain from pages")
both("STR4", lambda d: f"select doc_id, {snippet(d, 'text', 500)} as snippet from documents")
both("STR5", lambda d: f"select doc_id, {snippet(d, 'text', 150)} as snippet from documents")
both("STR6", lambda d: f"select doc_id, {words(d, 'text')} as word_count from documents")
both("STR7", lambda d: f"""select id, case when category = 'Academic' then 'advanced' when avg_len >= 6 then 'advanced' when avg_len >= 4.5 then 'intermediate' else 'beginner' end as difficulty
    from (select id, category, length({d.rr('raw_content', SPACES + '+', '')}) / greatest(1.0, {words(d, 'raw_content')}) as avg_len from docs) x""")
both("STR8", lambda d: f"""select doc_id, minutes, case when minutes >= 60 then cast(cast(floor(minutes / 60) as bigint) as {'string' if d.spark else 'varchar'}) || 'h' else cast(minutes as {'string' if d.spark else 'varchar'}) || 'm' end as shown
    from (select doc_id, cast(greatest(1, floor({words(d, 'text')} / 200.0 + 0.5)) as bigint) as minutes from documents) m""")
ASIAN = r"[\x{3131}-\x{318E}\x{AC00}-\x{D7A3}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
both("STR9", lambda d: f"select doc_id, cast(ceil({d.count('text', ASIAN)} / 2.0 + (length(text) - {d.count('text', ASIAN)}) / 4.0) as bigint) as tokens from documents")
both("STR10", lambda d: f"""select doc_id, case when {d.like('text', '[' + chr(92) + 'x{AC00}-' + chr(92) + 'x{D7A3}]')} then 'ko' when {d.like('text', '[' + chr(92) + 'x{3040}-' + chr(92) + 'x{30FF}]')} then 'ja'
    when {d.like('text', '[' + chr(92) + 'x{4E00}-' + chr(92) + 'x{9FFF}]')} then 'zh' when {d.like('text', '[' + chr(92) + 'x{0600}-' + chr(92) + 'x{06FF}]')} then 'ar'
    when {d.like('text', '[' + chr(92) + 'x{0400}-' + chr(92) + 'x{04FF}]')} then 'ru' else 'en' end as script from documents""")
# Languages as their speakers name them.
LANGUAGES = {
    "en": "English", "ko": "한국어", "ja": "日本語", "zh": "中文", "es": "Español", "fr": "Français", "de": "Deutsch", "pt": "Português",
    "it": "Italiano", "ru": "Русский", "ar": "العربية", "hi": "हिन्दी", "vi": "Tiếng Việt", "th": "ไทย", "id": "Bahasa Indonesia",
}
CODES = "(select cast(doc_id as bigint) as id, lang as code from documents union all select * from (values " + ", ".join(f"({-i - 1}, '{c}')" for i, c in enumerate([*LANGUAGES, "xx"])) + ") c(id, code))"
both("STR12", lambda d: "select id, code, case code " + " ".join(f"when '{c}' then '{n}'" for c, n in LANGUAGES.items()) + f" else upper(code) end as language from {CODES} c")
both("STR15", lambda d: f"select doc_id, {d.rr(TITLE, '[.]+$', '')} as heading from documents")
both("STR17", lambda d: f"select a.conv_id, a.turn, {normal(d, 'a.text')} = {normal(d, 'b.text')} as same from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
both("STR19", lambda d: f"select page_id, {d.extract('html', '<title>([^<]*)</title>', 1)} as title, {d.extract('html', '<h1>([^<]*)</h1>', 1)} as heading from pages")
both("STR21", lambda d: "select doc_id, right(text, 800) as tail, left(text, 5000) as sample from documents")
HOST = lambda d: d.rr(f"lower({d.url('url', 'host')})", "^www[.]", "")
both("URL4", lambda d: f"select page_id, lower({d.url('url', 'host')}) as host, {d.url('url', 'path')} as path, url like 'https:%' as secure from pages")


def sorted_query(d: Dialect) -> str:
    parts = d.fn(d.split(d.url("url", "query"), "&"), "filter", "p", "p <> ''")
    return d.join(f"{'array_sort' if d.spark else 'list_sort'}({parts})", "&")


def normal_url(d: Dialect) -> str:
    """http, no www, lower-case host, no slash at the end, query sorted, no fragment."""
    path = d.rr(d.url("url", "path"), "/$", "")
    return f"'http://' || {HOST(d)} || {path} || case when {d.url('url', 'query')} <> '' then '?' || {sorted_query(d)} else '' end"


both("URL1", lambda d: f"select page_id, {normal_url(d)} as normal from pages")
both("URL2", lambda d: f"select page_id, {'sha2' if d.spark else 'sha256'}({normal_url(d)}{', 256' if d.spark else ''}) as url_hash from pages")
both("URL3", lambda d: "select distinct page_id, scheme || www || " + HOST(d) + " || slash as candidate from pages cross join (values ('http://'), ('https://')) a(scheme) cross join (values (''), ('www.')) b(www) cross join (values (''), ('/')) c(slash)")
both("DT1", lambda d: "select id, created_h + 24 * case category when 'News' then 30 when 'Essays' then 60 when 'Literature' then 90 when 'Academic' then 180 else 30 end as expires_h from docs")
both("DT2", lambda d: "select user_id, item, last_day + cast(power(2, least(level, 5)) as bigint) as next_day from item_state")
both("DT3", lambda d: f"select user_id, {d.days('ts + interval ' + chr(39) + '9' + chr(39) + ' hour')} as kst_day, count(*) as n from events group by 1, 2")
both("DT4", lambda d: f"select {'date_format(ts, ' + chr(39) + 'yyyy-MM' + chr(39) + ')' if d.spark else 'strftime(ts, ' + chr(39) + '%Y-%m' + chr(39) + ')'} as month, count(*) as n from events group by 1")
both("MTH1", lambda d: "select event_id, round(0.2 * least(1.0, ln(value + 1) / ln(3601)) + 0.4 * (user_id % 2) + 0.4 * (user_id % 3) / 2, 6) as score from events")
both("MTH2", lambda d: "select l_orderkey, l_linenumber, cast(least(100, floor(l_quantity / 50 * 100 + 0.5)) as bigint) as progress from lineitem")
# whole texts of consecutive turns, every character
both("MTH3", lambda d: f"""select conv_id, turn, distance, round(case when longest = 0 then 1e0 else 1e0 - distance * 1e0 / longest end, 6) as similarity from (select x.conv_id, x.turn,
    cast(levenshtein({d.rr('x.text', '[^ -~]', '?')}, {d.rr('y.text', '[^ -~]', '?')}) as bigint) as distance, greatest(length(x.text), length(y.text)) as longest
    from conversations x join conversations y on x.conv_id = y.conv_id and y.turn = x.turn + 1) p""")
both("MTH4", lambda d: f"""select conv_id, turn, round(case when {d.size('a')} = 0 and {d.size('b')} = 0 then 1e0 else {d.size('array_intersect(a, b)' if d.spark else 'list_intersect(a, b)')} * 1e0 /
    {d.size(d.distinct('concat(a, b)' if d.spark else 'list_concat(a, b)'))} end, 6) as jaccard from
    (select x.conv_id, x.turn, {d.distinct(d.split('lower(x.text)', ' +'))} as a, {d.distinct(d.split('lower(y.text)', ' +'))} as b from conversations x join conversations y on x.conv_id = y.conv_id and y.turn = x.turn + 1) p""")
def least_likeness(d: Dialect, x: str) -> str:
    """0.35 to 0.7 by length, lower with digits, other signs, Hangul and fewer than three words."""
    base = "".join(f"when length({x}) < {n} then {v}e0 " for n, v in ((10, 0.35), (20, 0.4), (40, 0.5), (80, 0.55), (150, 0.6), (300, 0.65)))
    less = (("[0-9]", 0.05), (r"[^A-Za-z0-9_\s\x{AC00}-\x{D7A3}]", 0.03), (r"[\x{AC00}-\x{D7A3}]", 0.02))
    out = f"case {base}else 0.7e0 end" + "".join(f" - case when {d.like(x, p)} then {v}e0 else 0e0 end" for p, v in less)
    return f"round(greatest(0.35e0, least(0.85e0, {out} - case when {d.size(d.split(x, ' +'))} < 3 then 0.1e0 else 0e0 end)), 6)"


both("MTH9", lambda d: f"select id, {least_likeness(d, 'sentence')} as threshold from sentences")
both("MTH11", lambda d: f"select page_id, {d.count('html', '<p[ >]')} as opened, {d.count('html', '</p>')} as closed, round(length({d.rr('html', '<[^>]*>', '')}) * 1e0 / length(html), 6) as density from pages")
# the first ten words of a title of over three letters, in their order, without the commonest
both("ARR5", lambda d: f"select doc_id, {d.join(('slice(%s, 1, 10)' if d.spark else 'list_slice(%s, 1, 10)') % d.ordered_distinct(d.fn(d.split('lower(' + TITLE + ')', ' +'), 'filter', 'w', "length(w) > 3 and w not in ('the', 'and', 'for', 'with', 'from')")), ' ')} as keywords from documents")
both("CLS1", lambda d: "select id, case when source_type = 'uploaded' then 'uploaded' when source_type = 'rss' then 'rss' else 'saved' end as origin from docs")
both("CLS2", lambda d: "select id, coalesce(nullif(category, ''), case when source_type = 'rss' then 'News' else 'Other' end) as category from docs")
#: Papers that reach every rule, and the pages as papers without an abstract.
PAPERS = """(select * from (values (1, 'Deep Learning for Maps', ''), (2, 'A Neural Network Survey', ''), (3, 'Transformers at Work', ''), (4, 'On Stones', 'a State-of-the-Art result'),
    (5, 'A Survey of Stones', ''), (6, 'Rivers: a Review', ''), (7, 'Overview', ''), (8, 'On Rivers', 'a comprehensive list'), (9, 'On Rivers', '')) p(id, title, abstract) union all select page_id + 1000, title, '' from articles)"""
both("CLS4", lambda d: f"""select id, case when {d.like('lower(title)', 'deep learning|neural network|transformer')} or contains(lower(abstract), 'state-of-the-art') then 'advanced' else 'intermediate' end as difficulty from {PAPERS} p""")
