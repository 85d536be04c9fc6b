"""Joins and aggregates over documents, sentences, notes, feeds and events."""

from __future__ import annotations

from lectern.plans.base import both

both("JN1", lambda d: "select s.id, s.sentence from sentences s join docs t on s.doc_id = t.id where t.owner = 8 order by s.id")
both("JN2", lambda d: """select s.id, i.level, n.content as note from sentences s left join (select item, level from item_state where user_id = 3) i on s.id % 40 = i.item
    left join (select id, content from notes where notebook % 50 = 3) n on n.id = s.id""")
both("JN3", lambda d: """select s.id, coalesce(i.level > 2, false) as bookmarked, case when i.level is null then 'new' when i.level >= 3 then 'mastered' else 'learning' end as status
    from sentences s left join (select item, level from item_state where user_id = 5) i on s.id % 40 = i.item""")
both("JN6", lambda d: """select s.id, i.last_day from item_state i join sentences s on s.id % 40 = i.item where i.user_id = 3 order by i.last_day asc nulls last, s.id desc limit 30""")
both("JN7", lambda d: "select s.id from sentences s where exists (select 1 from docs t where t.id = s.doc_id and (t.owner = 8 or t.owner is null))")
both("JN9", lambda d: "select l.l_orderkey, l.l_linenumber, n.content from lineitem l join notes n on l.l_orderkey = n.id where n.notebook = 10")
both("JN10", lambda d: "select b.id, n.id as note, coalesce(t.title, 'Unknown Document') as title from notebooks b join notes n on n.notebook = b.id left join sentences s on s.id = n.id left join docs t on t.id = s.doc_id where b.group_id = 3")
both("JN11", lambda d: "select g.id, g.term, t.title from glossary g left join docs t on g.doc_id = t.id")
both("JN12", lambda d: "select t.id, coalesce(nullif(l.plan, 'free'), '') as alias from docs t left join limits l on t.id % 5 = l.code where t.source_type = 'rss'")
both("JN13", lambda d: "select u.user_id, l.plan, l.cap from token_usage u join limits l on u.user_id % 4 = l.code")
both("JN14", lambda d: "select n.id from notes n where exists (select 1 from lineitem l where l.l_orderkey = n.id and l.l_returnflag = 'N')")
both("JN15", lambda d: "select g.id, coalesce(case when g.mastery > 3 then g.translation end, t.title, g.term) as shown from glossary g left join docs t on t.id = g.id")
both("JN16", lambda d: "select user_id, max_by(event_id, event_id) as latest, count(*) as n from review_events group by user_id")
# an inclusive range of lines, expanded to an equi join on the line
#: Anchors of any length, some inside others: from every third paragraph, and from every tenth over up to a hundred.
ANCHORS = """(select doc_id, paragraph_no as block, paragraph_no as a, paragraph_no + case when paragraph_no % 10 = 1 then (doc_id * 7 + paragraph_no) % 100 else (doc_id + paragraph_no) % 5 end as z
    from paragraphs where paragraph_no % 3 = 0 or paragraph_no % 10 = 1)"""
#: Numbers to a bucket of the interval index: an anchor stands in every bucket that it touches, a number in one.
BUCKET = 16


def contained(d: Dialect) -> str:
    """The anchors that hold each paragraph: by an index of buckets, where the oracle compares all of a document."""
    if not d.spark:
        return f"select s.doc_id, s.paragraph_no, b.block from paragraphs s join {ANCHORS} b on b.doc_id = s.doc_id and s.paragraph_no between b.a and b.z"
    index = f"(select doc_id, block, a, z, bucket from {ANCHORS} r lateral view explode(sequence(a div {BUCKET}, z div {BUCKET})) x as bucket)"
    return f"select s.doc_id, s.paragraph_no, b.block from paragraphs s join {index} b on b.doc_id = s.doc_id and b.bucket = s.paragraph_no div {BUCKET} and s.paragraph_no between b.a and b.z"


both("JN17", contained)
both("JN20", lambda d: "select t.id from docs t where t.is_public and t.expires_h < 700 and not exists (select 1 from docs p where not p.is_public and p.title = t.title)")
both("JN21", lambda d: "select t.id, exists (select 1 from labels l where l.doc_id = t.id) as labelled from docs t" if not d.spark else "select t.id, l.doc_id is not null as labelled from docs t left join (select distinct doc_id from labels) l on l.doc_id = t.id")
both("JN23", lambda d: "select a.page_id, coalesce(x.title, h.title) as title from articles a left join articles x on x.page_id = a.page_id + 1 and x.host = a.host left join (select host, min(title) as title from articles group by host) h on h.host = a.host")
both("JN27", lambda d: "select distinct l_orderkey as note from lineitem where l_partkey = 5")
both("JN28", lambda d: f"select doc_id, count(*) as paragraphs, {d.string_agg('paragraph', 'paragraph_no', '|')} as body from paragraphs group by doc_id")
# documents of null id delete nothing, and a sentence of a null document stays
both("JN30", lambda d: "select s.id from sentences s where not exists (select 1 from docs t where t.owner = 8 and t.id = s.doc_id)")
both("AGG1", lambda d: "select b.id, b.name, count(n.content) as notes from notebooks b left join notes n on n.notebook = b.id group by b.id, b.name")
both("AGG2", lambda d: "select count(*) as total, count_if(not coalesce(is_public, false)) as private, count_if(is_public) as public from docs")
both("AGG3", lambda d: """select sum(due) as due, sum(case when kind = 'sentence' then due end) as sentences, sum(case when kind = 'term' then due end) as terms from
    (select 'sentence' as kind, count_if(last_day is null or last_day + power(2, level) <= 30) as due from item_state union all select 'term', count_if(id % 11 = 0 or id % 60 + power(2, mastery) <= 40) from glossary) x""")
both("AGG4", lambda d: """select t.id, coalesce(g.n, 0) as terms, coalesce(o.n, 0) as notes from docs t left join (select doc_id, count(*) as n from glossary group by doc_id) g on g.doc_id = t.id
    left join (select id % 300 as doc_id, count(*) as n from notes group by 1) o on o.doc_id = t.id where coalesce(g.n, 0) > 0 or coalesce(o.n, 0) > 0""")
both("AGG5", lambda d: "select category, is_public, source, count(*) as n from docs group by category, is_public, source")
both("AGG6", lambda d: "select count_if(source_type = 'uploaded') as uploaded, count_if(source_type = 'rss') as rss, count_if(source_type not in ('uploaded', 'rss')) as saved from docs")
both("AGG7", lambda d: "select count(*) as feeds, count_if(good >= 80) as fine, count_if(errors > 50) as bad, round(avg(good), 4) as mean_score from (select feed, count_if(not ok) as errors, 100e0 * count_if(ok) / count(*) as good from feed_runs group by feed) f")
both("AGG8", lambda d: f"""select r.feed, r.rate, r.stale, u.used, least(100, cast(floor(100.0 * u.used / l.cap + 0.5) as bigint)) as quota from
    (select feed, least(100, cast(floor(100.0 * count_if(ok) / count(*) + 0.5) as bigint)) as rate, max({d.days('ts')}) < 22 as stale from feed_runs group by feed) r
    join (select user_id % 40 as feed, sum(tokens) as used from token_usage group by 1) u on u.feed = r.feed join limits l on l.code = r.feed % 4""")
both("AGG9", lambda d: "select user_id, cast(sum(tokens) as bigint) as tokens, round(sum(tokens) * 2e-6, 6) as cost from token_usage group by rollup(user_id)")
both("AGG10", lambda d: "select user_id, count(*) as total, count_if(level = 2) as mastered, count_if(level = 1) as learning, count_if(level = 0) as new from item_state group by user_id")
both("AGG12", lambda d: "select distinct l.l_partkey as id from lineitem l join notes n on n.id = l.l_orderkey where n.content is null")
both("AGG13", lambda d: "select count(*) as every, count_if(content is null) as highlights, count_if(content is not null) as notes from notes")
both("AGG14", lambda d: "select distinct tag from glossary order by tag")
both("AGG15", lambda d: f"""select grp, unfiled, {d.size('ids')} as notebooks, {d.join('ids', ',')} as ids from (select coalesce(n.n_name, 'Unfiled') as grp, n.n_name is null as unfiled,
    {'transform(array_sort(collect_list(b.id)), x -> cast(x as string))' if d.spark else 'list_transform(list_sort(list(b.id)), lambda x: cast(x as varchar))'} as ids from notebooks b left join nation n on n.n_nationkey = b.group_id and n.n_nationkey < 20 group by 1, 2) g order by unfiled, grp""")
both("AGG16", lambda d: "select doc_id, count(*) as n from sentences group by doc_id")
both("AGG19", lambda d: f"""select doc_id, running, pages from (select l.doc_id, l.running, count(distinct l.page) as pages, max(t.pages) as total from
    (select doc_id, page, {d.rr(d.rr('lower(trim(line))', '[0-9]+', '#'), '[ ]+', ' ')} as running from text_lines) l join (select doc_id, count(distinct page) as pages from text_lines group by doc_id) t on t.doc_id = l.doc_id
    where length(l.running) between 6 and 79 group by l.doc_id, l.running) x where pages >= least(3, total)""")
both("AGG21", lambda d: "select conv_id, count_if(length(trim(text)) > 0) as done, count(*) as total from conversations group by conv_id")
both("WIN1", lambda d: """select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id, role = 'system' order by turn desc) as n from conversations) c where role = 'system' or n <= 5""")
both("WIN2", lambda d: """select s.user_id, s.item, coalesce(v.version, 0) + 1 as next_version from item_state s
    left join (select user_id, item, max(version) as version from (select user_id, item, row_number() over (partition by user_id, item order by ts, event_id) as version from review_events where ok) h group by user_id, item) v
    on v.user_id = s.user_id and v.item = s.item""")
both("WIN3", lambda d: f"select event_id, gap from (select event_id, {d.days('ts')} - lag({d.days('ts')}) over (partition by user_id order by ts, event_id) as gap from events) g where gap > 0 and gap < 50")
both("WIN4", lambda d: """select doc_id, paragraph_no, near - short as near from (select doc_id, paragraph_no, cast(length(paragraph) < 60 as int) as short,
    cast(sum(cast(length(paragraph) < 60 as int)) over (partition by doc_id order by paragraph_no rows between 4 preceding and 4 following) as bigint) as near from paragraphs) x""")
both("WIN6", lambda d: "select id, weight from notes order by weight desc, id limit 10")
both("WIN7", lambda d: "select id, cast(floor((row_number() over (partition by doc_id order by id) - 1) / 5) as bigint) + 1 as chapter from sentences")
both("WIN8", lambda d: """with pool as (select id, created_h from docs where source = 'src1'), newest as (select id from pool order by created_h desc, id limit 30)
    select p.id from pool p left join newest k on k.id = p.id where k.id is null""")
both("WIN9", lambda d: f"select doc_id, {d.string_agg('sentence', 'id', ' ')} as snippet from (select *, row_number() over (partition by doc_id order by id) as n from sentences) s where n <= 25 group by doc_id")
both("WIN10", lambda d: """select user_id, item, island, count(*) as run from (select user_id, item, ok, sum(case when ok then 0 else 1 end) over (partition by user_id, item order by ts, event_id rows unbounded preceding) as island
    from review_events) x where ok group by user_id, item, island""" if d.spark else """select user_id, item, cast(island as bigint) as island, count(*) as run from (select user_id, item, ok, sum(case when ok then 0 else 1 end) over (partition by user_id, item order by ts, event_id rows unbounded preceding) as island
    from review_events) x where ok group by user_id, item, island""")
