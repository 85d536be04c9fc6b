"""Reading and practice: saved sentences, feeds, notes, quizzes and the text measures between two sentences."""

from __future__ import annotations

from lectern.plans.base import Dialect, both
from lectern.plans.scalars import HOST, normal, words

# Fixed value: words that are no keyword of a title.
STOP = """the a an is are was were be been being have has had do does did will would could should may might must shall can need to of in for on with at by
from as into through during before after above below between under again further then once here there when where why how all each few more most other some
such no nor not only own same so than too very just and but if or because until while this that these those what which who whom it its""".split()

#: Consecutive turns of a conversation: the pairs that the text measures compare.
PAIRS = "(select a.conv_id, a.turn, a.text as x, b.text as y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"
STATE = """(select s.user_id, s.item, s.level, d.title, d.source_language, p.paragraph, n.content as note, n.weight from item_state s
    join docs d on d.id = s.item join paragraphs p on p.doc_id = d.id and p.paragraph_no = 1 left join notes n on n.id = s.user_id * 40 + s.item)"""


def tokens(d: Dialect, x: str) -> str:
    return d.fn(d.split(x, r"\s+"), "filter", "w", "w <> ''")


def bag(d: Dialect, x: str) -> str:
    return tokens(d, d.rr(f"lower({x})", r"[^A-Za-z0-9_\s]", ""))


both("JN4", lambda d: f"select user_id, item, title, paragraph, note, case when level >= 4 then 'mastered' when level >= 1 then 'learning' else 'new' end as status from {STATE} s where level > 0 or note is not null")
both("JN5", lambda d: f"select user_id, item, level, row_number() over (partition by user_id order by weight desc nulls last, item desc) as place from {STATE} s where source_language in ('en', 'de')")
both("JN8", lambda d: "select g.id, g.term, p.doc_id, p.paragraph_no, d.title from glossary g join docs d on d.id = g.doc_id join paragraphs p on p.doc_id = d.id and p.paragraph_no = g.mastery + 1")
both("JN19", lambda d: f"select b.item_id from benchmark b left join (select distinct {d.extract('url', '/([0-9]+)', 1)} as external from pages) p on p.external = cast(b.item_id as string) where p.external is null")
both("JN22", lambda d: f"""select distinct p.page_id, f.feed from (select page_id, sha1(scheme || www || host || slash) as hash from (select page_id, {HOST(d)} as host from pages) h
    cross join (values ('http://'), ('https://')) a(scheme) cross join (values (''), ('www.')) b(www) cross join (values (''), ('/')) c(slash)) p
    join (select min(page_id) as feed, sha1('http://' || {HOST(d)} || '/') as hash from pages group by 2) f on f.hash = p.hash""")
both("AGG11", lambda d: """select b.id, b.name, g.n_name as group_name, n.notes, n.highlights, n.weight from notebooks b left join nation g on g.n_nationkey = b.group_id
    join (select notebook, count(*) as notes, count(*) - count(content) as highlights, round(sum(weight), 2) as weight from notes group by notebook) n on n.notebook = b.id""")
both("AGG17", lambda d: """select d.id, coalesce(s.sentences, 0) as sentences, coalesce(s.paragraphs, 0) as paragraphs, coalesce(t.terms, 0) as terms,
    case when coalesce(s.sentences, 0) > 100 or coalesce(t.terms, 0) > 50 then 'high' when coalesce(s.sentences, 0) > 20 then 'medium' else 'low' end as warning
    from docs d left join (select doc_id, count(*) as sentences, count(distinct paragraph_no) as paragraphs from sentences group by doc_id) s on s.doc_id = d.id
    left join (select doc_id, count(*) as terms from glossary group by doc_id) t on t.doc_id = d.id""")
both("AGG22", lambda d: f"""select doc_id, blocks, anchored, round(anchored * 1e0 / blocks, 6) as coverage, case when anchored * 100 >= blocks * 95 then 'ok' when anchored * 100 >= blocks * 90 then 'warn' else 'low' end as state
    from (select p.doc_id, count(*) as blocks, count(h.hash) as anchored from (select doc_id, sha1({normal(d, 'paragraph')}) as hash from paragraphs) p
    left join (select distinct sha1({normal(d, 'paragraph')}) as hash from paragraphs where doc_id % 2 = 0) h on h.hash = p.hash group by p.doc_id) c""")
both("SRC3", lambda d: f"select doc_id, paragraph_no, sentence_no, trim(sentence) as sentence, sha1({normal(d, 'sentence')}) as hash from sentences")
both("SRC4", lambda d: f"""select kind, id, trim(body) as body, case when trim(body) = '' then 'pending' when kind = 'html' then 'ps_committed' else 'completed' end as state from
    (select 'html' as kind, page_id as id, {d.rr('html', '<[^>]*>', ' ')} as body from pages union all select 'text', doc_id, text from documents) b""")
both("SRC5", lambda d: "select conv_id, turn, sentence_no, trim(sentence) as sentence from " + d.explode("conv_id, turn", "(select * from conversations where role <> 'system')", d.split("text", r"\. "), "sentence") + " s where trim(sentence) <> ''")
#: A feed holds fifty items, so a host with very many pages has many feeds.
FEED = "(select host, feed, " + "{}" + " as xml from (select *, cast(floor(page_id / 50) as bigint) as feed from articles) a group by host, feed)"
both("SRC8", lambda d: f"""select host, feed, {d.extract('item', '<title>([^<]*)</title>', 1)} as title, {d.extract('item', '<link>([^<]*)</link>', 1)} as link, {d.extract('item', 'abs/([0-9]+[.][0-9]+)', 1)} as id from """
    + d.explode("host, feed", FEED.format(d.string_agg("'<item><title>' || title || '</title><link>' || replace(replace(url, '<', ''), '&', ';') || '</link><id>abs/' || (1000 + page_id % 9000) || '.' || page_id || '</id></item>'", "page_id", "")), d.all("xml", "<item>.*?</item>"), "item") + " i")
both("SRC10", lambda d: "select page_id, item_no, item from " + d.explode("page_id", "pages", d.all(d.extract("html", "<ul>(.*?)</ul>", 1), "<li>(?:<a[^>]*>)?([^<]*)", 1), "item") + " i where item_no <= 100")
both("FLT10", lambda d: "select event_id, user_id, md5(cast(event_id as string)) as token_hash from events where event_type <> 'click' and ts + interval '24' hour > timestamp '2024-01-15 00:00:00'")
both("FLT17", lambda d: """select n.id, n.notebook, case when n.content is null then 'highlight' else 'note' end as kind from notes n join notebooks b on b.id = n.notebook
    where (n.content is null or n.id % 3 = 0) and (b.kind in ('BUILDING', 'MACHINERY') or n.id % 10 = 0) and lower(coalesce(n.content, '') || ' ' || b.name || ' ' || b.kind) like '%in%'""")
both("FLT22", lambda d: f"""select page_id, not ((width > 0 and height > 0 and (width < 100 or height < 100)) or src like '%ad%' or src like '%banner%' or src like '%icon%' or src like '%logo%' or alt like '%ad%') as significant,
    {d.like('lower(src)', '[.](jpg|jpeg|png|webp|gif|svg)|image|photo|thumbnail|pic|wp-content|uploads|media|assets|cdn|imgur|flickr')} as image
    from (select page_id, url as src, page_id * 37 % 400 as width, page_id * 53 % 300 as height, title as alt from articles) i""")
LINES = """(select doc_id, paragraph_no, case when paragraph_no %% 2 = 0 then %s || '-' else paragraph end as l, lead(trim(paragraph)) over (partition by doc_id order by paragraph_no) as r from paragraphs)"""  # every other line ends in a hyphen
both("STR16", lambda d: f"""select doc_id, paragraph_no, joins, case when joins then l || r else l || ' ' || r end as merged from
    (select *, {d.like('l', '[A-Za-z]-$')} and ({d.like('r', '^[A-Z]')} or {words(d, 'r')} <= 2) as joins from {LINES % d.rr('paragraph', '[.!?]+$', '')} s where r is not null) t""")
both("STR20", lambda d: f"""select page_id, {d.extract('html', '<html lang="([^"]*)"', 1)} as lang, {d.extract('html', '<meta property="og:title" content="([^"]*)"', 1)} as og_title,
    {d.extract('html', '<meta charset="([^"]*)"', 1)} as charset, {d.extract('html', '<meta property="article:author" content="([^"]*)"', 1)} as author, coalesce(nullif({d.extract('html', '<h1>([^<]*)</h1>', 1)}, ''), {d.extract('html', '<title>([^<]*)</title>', 1)}) as title from pages""")
both("URL5", lambda d: f"""select page_id, case when url like '%arxiv.org/abs/%' then replace(url, '/abs/', '/html/') when url like '%arxiv.org/pdf/%' then {d.rr("replace(url, '/pdf/', '/html/')", '[.]pdf($|[?])', '$1')} else url end as shown,
    {d.like('lower(url)', '^https?://([^/?#]*[.])?arxiv[.]org([:/?#]|$)')} as is_arxiv from (select page_id, case page_id % 3 when 0 then url when 1 then 'https://arxiv.org/abs/' || page_id || '.0' else 'http://export.arxiv.org/pdf/' || page_id || '.1.pdf?download=1' end as url from pages) u""")
ROOT_URL = r"^(https?://[^/?#]+)"
both("URL6", lambda d: f"""select page_id, href_no, case when {d.like('href', '^https?://')} then href when href like '//%' then 'http:' || href when href like '/%' then {d.extract('url', ROOT_URL, 1)} || href
    else {d.extract('url', '^(https?://[^/?#]+[^?#]*/)', 1)} || href end as absolute from """ + d.explode("page_id, url", "pages", d.all("html", 'href="([^"]*)"', 1), "href") + " h")
both("DT5", lambda d: f"""select event_id, {"date_format(ts, 'yyyy. M. d.')" if d.spark else "strftime(ts, '%Y. %-m. %-d.')"} as shown,
    case when 30 - {d.days('ts')} < 1 then 'today' when 30 - {d.days('ts')} < 7 then cast(30 - {d.days('ts')} as string) || ' days ago' when 30 - {d.days('ts')} < 365 then 'this year' else 'earlier' end as bucket from events""")


def light(d: Dialect) -> str:
    """Two bags' Jaccard, or six tenths of it and four of the words met in lock-step."""
    if d.spark:
        met = "aggregate(a, 0, (j, t) -> if(j < size(b) and t = b[j], j + 1, j))"
    else:
        met = "cast(list_reduce(a, lambda j, t: case when cast(j as int) < len(b) and t = b[cast(j as int) + 1] then cast(cast(j as int) + 1 as varchar) else j end, '0') as int)"
    both_in = d.size("array_intersect(a, b)" if d.spark else "list_intersect(list_distinct(a), list_distinct(b))")
    either = d.size(d.distinct("concat(a, b)" if d.spark else "list_concat(a, b)"))
    return f"""select conv_id, turn, round(case when x = y then 1e0 when size_a = 0 or size_b = 0 then 0e0 else greatest(jaccard, jaccard * 0.6e0 + met * 0.4e0 / greatest(size_a, size_b)) end, 6) as similarity
        from (select conv_id, turn, x, y, {d.size('a')} as size_a, {d.size('b')} as size_b, {met} as met, {both_in} * 1e0 / nullif({either}, 0) as jaccard
        from (select conv_id, turn, x, y, {tokens(d, 'x')} as a, {tokens(d, 'y')} as b from {PAIRS} p) t) m"""


both("MTH6", light)


def practice(d: Dialect) -> str:
    """Words in common, each as often as both have it, over the longer answer, and a tenth for equal order."""
    at = lambda side: "(select conv_id, turn, w, count(*) as n from " + d.explode("conv_id, turn", f"(select conv_id, turn, {bag(d, side)} as ws from {PAIRS} p)", "ws", "w") + " e group by conv_id, turn, w)"
    return f"""select p.conv_id, p.turn, round(case when a = b then 1e0 when {d.size('a')} = 0 or {d.size('b')} = 0 then 0e0 else coalesce(m.met, 0) * 1e0 / greatest({d.size('a')}, {d.size('b')}) end, 6) as similarity
        from (select conv_id, turn, {bag(d, 'x')} as a, {bag(d, 'y')} as b from {PAIRS} q) p
        left join (select l.conv_id, l.turn, sum(least(l.n, r.n)) as met from {at('x')} l join {at('y')} r on l.conv_id = r.conv_id and l.turn = r.turn and l.w = r.w group by l.conv_id, l.turn) m
        on m.conv_id = p.conv_id and m.turn = p.turn"""


both("MTH10", practice)
both("LRN21", lambda d: f"select conv_id, turn, similarity >= 0.85e0 as accepted from ({practice(d)}) s")
both("ARR2", lambda d: "select id, tag from " + d.explode("id", "(select p_partkey as id, case when p_partkey % 2 = 0 then '[\"' || p_brand || '\",' || p_size || ',\"' || p_type || '\"]' else '[]' end as x from part)",
    d.all("x", '"([^"]*)"', 1), "tag") + " t")
TAGGED = {"artificial-intelligence": ("artificial intelligence", "ai"), "machine-learning": ("machine learning", "ml"), "research": ("research", "study"), "climate": ("climate", "environment"), "philosophy": ("philosophy", "ethics"), "society": ("society", "culture")}
both("ARR3", lambda d: "select doc_id, tag from (" + " union all ".join(f"select doc_id, '{tag}' as tag from documents where contains(lower(text), '{a}') or contains(lower(text), '{b}')" for tag, (a, b) in TAGGED.items())
    + f") t union select doc_id, replace({d.rr('lower(source)', '[^a-z0-9_ ]', '')}, ' ', '-') from documents where length(source) > 2")
APPROVED = ["learning", "the ", "und", "research", "que "]
both("ARR4", lambda d: "select doc_id, approved <> '' as approved, approved as matched from (select doc_id, trim(" + " || ".join(f"case when contains(lower(text), '{k}') then '{k.strip()} ' else '' end" for k in APPROVED) + ") as approved from documents) m")
both("JSN2", lambda d: "select conv_id, turn, block_no, block from " + d.explode("conv_id, turn", "(select conv_id, turn, case when turn % 2 = 0 then '[\"' || role || '\",\"' || turn || '\"]' else role end as x from conversations)",
    f"case when x like '[%' then {d.all('x', chr(34) + '([^' + chr(34) + ']*)' + chr(34), 1)} else {'array(x)' if d.spark else '[x]'} end", "block") + " b")
both("JSN3", lambda d: f"""select conv_id, id, text from (select conv_id, cast({d.extract('item', '"id":"?([0-9]+)', 1)} as bigint) as id, trim({d.extract('item', '"text":"([^"]*)"', 1)}) as text,
    row_number() over (partition by conv_id, {d.extract('item', '"id":"?([0-9]+)', 1)} order by item_no desc) as back from """
    + d.explode("conv_id", "(select conv_id, " + d.string_agg("'{\"id\":' || case when turn % 2 = 0 then '\"' || (turn % 3) || '\"' else cast(turn % 3 as string) end || ',\"text\":\" ' || role || turn || ' \"}'", "turn", ",") + " as x from conversations group by conv_id)", d.all("x", r"\{[^}]*\}"), "item") + " i) l where back = 1 and text <> ''")
# Categories of older documents and what they became.
RENAMED = (
    ("뉴스", "News"), ("문학", "Literature"), ("논문", "Academic"), ("에세이/오피니언", "Essays"), ("칼럼·에세이", "Essays"), ("교육", "Academic"), ("기타", "Essays"),
    ("classic", "Literature"), ("science", "Academic"), ("Non-fiction", "Essays"), ("Opinion", "Essays"), ("Other", "Essays"), ("Educational", "Academic"),
)
OLD = "(select * from (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate([a for a, _ in RENAMED] + ["News", "Unheard of"])) + ") o(id, category))"
RENAME = "(select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in RENAMED) + ") r(old, now))"
both("CLS3", lambda d: f"""select a.page_id as id, case when contains(lower(a.title), 'wired') or contains(lower(a.title), 'voa') then 'News' else 'Essays' end as category from articles a
    union all select -1 - o.id, coalesce(r.now, o.category) from {OLD} o left join {RENAME} r on r.old = o.category
    union all select -100 - f.id, case when contains(lower(f.title), 'wired') or contains(lower(f.title), 'voa') then 'News' else 'Essays' end from (select * from (values (1, 'WIRED Top Stories'), (2, 'VOA News'), (3, 'Aeon')) f(id, title)) f""")
both("LRN4", lambda d: """select doc_id, id, term, mastery, case when mastery < 2 then 1 when mastery < 4 then 2 else 3 end as quiz, case when draw < 30 then 'choice' when draw < 50 then 'blank' when draw < 70 then 'order' else 'typing' end as format
    from (select doc_id, id, term, mastery, (id * 7919 + 13) % 100 as draw, count(*) over (partition by doc_id) as terms from glossary where mastery < 5) g where terms >= 3""")
both("LRN5", lambda d: """select user_id, status, due, item, place from (select user_id, item, place, due, case when items < 5 then 'insufficient' when due = 0 then 'noDue' else 'ready' end as status from
    (select user_id, item, count(*) over (partition by user_id) as items, cast(sum(case when ready then 1 else 0 end) over (partition by user_id) as bigint) as due,
        row_number() over (partition by user_id order by case when ready then 0 else 1 end, (item * 7919 + user_id * 104729) % 1009, item) as place
    from (select user_id, item, last_day + cast(power(2, least(level, 5)) as bigint) <= 25 as ready from item_state) r) c) s where place = 1 or (status = 'ready' and place <= least(7, due))""")
both("LRN6", lambda d: "select g.id, g.term, coalesce(nullif(g.translation, ''), g.term) as answer, d.title, g.mastery from glossary g join docs d on d.id = g.doc_id where d.is_public")
both("LRN7", lambda d: """select doc_id, paragraph_no, word_no, word from (select doc_id, paragraph_no, word_no, word, count(*) over (partition by doc_id, paragraph_no) as n,
    row_number() over (partition by doc_id, paragraph_no order by (doc_id * 31 + paragraph_no * 17 + word_no * 7919) % 1009, word_no) as place from """
    + d.explode("doc_id, paragraph_no", "paragraphs", d.split("paragraph", " +"), "word") + " w) r where place <= greatest(1, cast(floor(n * 3 / 10.0) as bigint))")
# the remainder first: the product of an id of document 116,473 or later is beyond a bigint
both("LRN12", lambda d: f"""select level, id from (select level, id, row_number() over (partition by level order by ({'id % 10007' if d.spark else 'id'} * 7919 + 101) % 10007, id) as place
    from (select case when length(sentence) < 40 then 'easy' when length(sentence) < 100 then 'medium' else 'hard' end as level, id from sentences) s) r where place <= 10""")
both("LRN17", lambda d: "select u.user_id, l.plan, l.cap - u.tokens as remaining, u.tokens >= l.cap as over, case l.code when 0 then 0 when 1 then 10 when 2 then 50 else 500 end - u.calls as documents_left from token_usage u join limits l on l.code = u.user_id % 4")
both("LRN18", lambda d: """select user_id, item, kind, version, ts from (select user_id, item, kind, ts, row_number() over (partition by user_id, item order by step, event_id) as version from
    (select user_id, item, 'user' as kind, ts, 1 as step, event_id from review_events where ok
     union all select user_id, item, 'ai', min(ts) - interval '1' minute, 0, min(event_id) from review_events where ok group by user_id, item) e) v""")
both("DML4", lambda d: """select id, notebook, case when original then coalesce(fresh, content) else content end as content from
    (select n.id, n.notebook, n.content, n.id % 5 <> 0 as original, case when n.id % 7 = 0 then 'edited ' || n.id end as fresh from notes n) e""")
both("DML7", lambda d: """select 'events' as part, event_id as id from events where user_id <> 17 union all select 'docs', id from docs where owner <> 17
    union all select 'sentences', s.id from sentences s join docs d on d.id = s.doc_id where d.owner <> 17 union all select 'audit', event_id from events where event_type = 'error'""")
both("DML15", lambda d: "select lang, id from (select d.source_language as lang, d.id, row_number() over (partition by d.source_language order by length(d.raw_content) desc, d.id) as place from docs d left join labels l on l.doc_id = d.id where l.doc_id is null) r where place = 1")
both("DML19", lambda d: """select n.id, coalesce(a.id, b.id, 900000 + n.notebook) as assigned, a.id is null and b.id is null as created from notes n
    left join notebooks a on a.id = n.notebook and a.id % 3 = 0 left join (select kind, min(id) as id from notebooks group by kind) b on b.kind = n.content""")
both("DML22", lambda d: "select 1 as id, min(ts) as created_at, max_by(ts, event_id) as updated_at, max_by(value, event_id) as cap, max_by(event_type, event_id) as note, count(*) as writes from events where event_type in ('purchase', 'error') having count(*) > 0")


def snippets(d: Dialect) -> str:
    """The sentence that says most about the title among the 24 after the first; contents lines are none."""
    marked = d.rr(d.rr("text", r"\s+", " "), "([.!?]) ", "$1" + chr(1))
    keys = d.fn(d.split(d.rr(f"lower({'split_part(text, chr(10), 1)'})", r"[^A-Za-z0-9_\s\x{AC00}-\x{D7A3}]", " "), r"\s+"), "filter", "w", "length(w) >= 2 and w not in (" + ", ".join(f"'{w}'" for w in STOP) + ")")
    key = lambda i: f"keys[{i - 1 if d.spark else i}]"
    third = "get(keys, {})" if d.spark else "keys[{}]"
    hits = " + ".join(f"case when contains(lower(s), {third.format(i if d.spark else i + 1)}) then 10 else 0 end" for i in range(3))
    contents = f"""(length(s) < 30 or {d.like('s', '[0-9]+$')} or {d.like('s', '[.]{2,}')} or (not {d.like('s', '[.!?]')} and length(s) < 60)
        or {d.like('lower(s)', '^(chapter|section|part|table of contents|contents|index) ')} or {d.like('s', '^[0-9]+[.)] ')})"""
    return f"""select doc_id, case when best > 0 then best_s when long_s is not null then long_s when any_s is not null then any_s else first_s end as snippet from (select doc_id,
        max(case when place = 1 then score end) as best, max(case when place = 1 then s end) as best_s, max(case when s_no = long_no then s end) as long_s, max(case when s_no = any_no then s end) as any_s, max(case when s_no = 1 then s end) as first_s from
        (select doc_id, s_no, s, score, row_number() over (partition by doc_id order by score desc nulls last, s_no) as place, min(case when s_no > 1 and not toc and length(s) >= 60 then s_no end) over (partition by doc_id) as long_no,
            min(case when s_no > 1 and not toc then s_no end) over (partition by doc_id) as any_no from
        (select doc_id, s_no, s, toc, case when s_no between 2 and 25 and not toc then {hits} + case when s_no between 3 and 21 then 5 else 0 end + case when length(s) between 60 and 200 then 3 else 0 end
            + case when {d.like('s', '[.!?]$')} then 2 else 0 end end as score from
        (select doc_id, s_no, s, keys, {contents} as toc from {d.explode('doc_id, keys', f'(select doc_id, {keys} as keys, {d.split(marked, chr(1))} as ss from documents)', 'ss', 's')} e where trim(s) <> '') t) c) r group by doc_id) b"""


both("SEG14", snippets)
