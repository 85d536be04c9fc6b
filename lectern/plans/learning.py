"""Learning state, quotas and lifecycle: folds of review events in closed form, and writes as DataFrames."""

from __future__ import annotations

from lectern.plans.base import both
from lectern.plans.reading import OLD, RENAME

both("LRN1", lambda d: "select user_id, item, level, case when level >= 3 then 'mastered' when level > 0 then 'learning' else 'new' end as status, last_day + cast(power(2, level) as bigint) as next_day from item_state")
both("LRN2", lambda d: """select user_id, item, least(5, count_if(rating = 'good' and n > last_again) + max(case when n = 1 and rating = 'hard' and last_again = 0 then 1 else 0 end)) as level from
    (select *, coalesce(max(case when rating = 'again' then n end) over (partition by user_id, item), 0) as last_again from
    (select user_id, item, rating, row_number() over (partition by user_id, item order by ts, event_id) as n from review_events) a) b group by user_id, item""")
both("LRN3", lambda d: "select user_id, item, level from (select *, row_number() over (partition by user_id order by (last_day + power(2, level) <= 30) desc, level, item) as n from item_state) q where n <= 10")
# the newest 20 public documents by the reader's three leading categories and ten title words, or, for a reader of under three documents, by saves and views
KEYWORDS = "(select distinct w from (select w from ({}) k where length(w) > 3 and w not in ('the', 'and', 'for', 'with', 'from')) u order by w limit 10)"


def recommended(d, owner: int) -> str:
    words = KEYWORDS.format("select title_word as w from " + d.explode("id", f"(select id, {d.split('lower(title)', '[ ]+')} as ws from docs where owner = {owner}) t", "ws", "title_word") + " e")
    return f"""select {owner} as reader, id, score from (select t.id, case when m.n < 3 then t.saved + t.viewed * 0.1e0 else case r.n when 1 then 30 when 2 then 20 when 3 then 10 else 0 end + 5 * coalesce(h.hits, 0) + t.saved * 2 + t.viewed * 0.1e0
        + case when t.created_h > 552 then 3 when t.created_h > 0 then 1 else 0 end end as score from (select id, title, category, created_h, id % 5 as saved, id % 30 as viewed from docs where is_public and not is_archived order by created_h desc, id limit 20) t
        cross join (select count(*) as n from docs where owner = {owner}) m
        left join (select category, row_number() over (order by c desc, category) as n from (select category, count(*) as c from docs where owner = {owner} group by category) c) r on r.category = t.category
        left join (select p.id, count(*) as hits from (select id, lower(title) as title from docs where is_public and not is_archived order by created_h desc, id limit 20) p join {words} k on contains(p.title, k.w) group by p.id) h on h.id = t.id) s"""


both("LRN8", lambda d: f"select * from ({recommended(d, 8)} order by score desc, id limit 6) a union all select * from ({recommended(d, 900)} order by score desc, id limit 6) b")
both("LRN9", lambda d: f"""select user_id, mean, weak, n, this_week, last_week, case when last_week = 0 then case when this_week > 0 then 100e0 else 0e0 end else round((this_week - last_week) * 100e0 / last_week, 4) end as growth from
    (select user_id, round(avg(value), 4) as mean, count_if(value < 70) as weak, count(*) as n, count_if({d.days('ts')} between 23 and 29) as this_week, count_if({d.days('ts')} between 16 and 22) as last_week from events group by user_id) w""")
both("LRN10", lambda d: """select user_id, item, level, last_day, case when level = 0 then 'new or failed' when level < 3 then 'learning' else 'known' end as reason from item_state
    where last_day is null or last_day + power(2, least(level, 5)) <= 30 order by level, last_day, user_id, item limit 15""")
both("LRN11", lambda d: "select user_id, item, case when level = 0 then 'failed last' when reviews < 2 then 'seldom' else 'low level' end as reason from item_state where level < 2")
both("LRN13", lambda d: "select id, term from glossary where 40 - id % 60 >= power(2, mastery)")
# three others of the document: the next ones in an order of hashes, and the first ones behind the last
both("LRN15", lambda d: f"""with dealt as (select id, doc_id, row_number() over (partition by doc_id order by md5(cast(id as {'string' if d.spark else 'varchar'})), id) as n, count(*) over (partition by doc_id) as terms from glossary)
    select a.id, b.id as other from (select id, doc_id, terms, (n - 1 + k) % terms + 1 as at from dealt join (values (1), (2), (3)) s(k) on k < terms) a join dealt b on b.doc_id = a.doc_id and b.n = a.at""")
both("LRN16", lambda d: """select u.user_id, l.cap - u.tokens as left_over, l.cap - u.tokens <= 500 as blocked, l.plan = 'premium' and l.cap - u.tokens <= 2000 as fallback, u.tokens >= 0.8 * l.cap as warned
    from token_usage u join limits l on u.user_id % 4 = l.code""")
both("LRN19", lambda d: "select id, case when source_language = 'en' then 'de' else 'en' end as target from docs")
both("LRN20", lambda d: "select id, coalesce(nullif(content, ''), 'highlight') as shown, content is not null as edited from notes")
both("DML1", lambda d: """select coalesce(o.user_id, n.user_id) as user_id, coalesce(n.v, o.v) as v from (select user_id, count(*) as v from events where event_type = 'view' group by user_id) o
    full outer join (select user_id, count(*) as v from events where event_type = 'purchase' group by user_id) n on o.user_id = n.user_id""")
both("DML2", lambda d: "select c_custkey as user_id, coalesce(u.tokens, 0) as tokens from customer c left join token_usage u on u.user_id = c.c_custkey")
both("DML3", lambda d: "select b.c_custkey as user_id, coalesce(x.n, 0) + 10 as counter from customer b left join (select user_id, count(*) as n from events group by user_id) x on x.user_id = b.c_custkey")
# what is left of every dependent table, and of the documents, after those of owner 8 go
GONE = "(select id from docs where owner = 8)"
both("DML6", lambda d: " union all ".join(
    f"select '{part}' as part, x.id from {source} x left join {GONE} g on g.id = x.doc_id where g.id is null" for part, source in (
        ("notes", "(select n.id, s.doc_id from notes n join sentences s on s.id = n.id)"),
        ("attempts", "(select event_id as id, item as doc_id from review_events)"),
        ("bridge", "(select l_orderkey as id, l_partkey % 200 as doc_id from lineitem)"),
        ("state", "(select user_id * 40 + item as id, item as doc_id from item_state)"),
        ("sentences", "(select id, doc_id from sentences)"),
        ("paragraphs", "(select doc_id * 100000 + paragraph_no as id, doc_id from paragraphs)"),
        ("notebooks", "(select id, id % 200 as doc_id from notebooks)"),
        ("glossary", "(select id, doc_id from glossary)"),
        ("documents", "(select id, id as doc_id from docs)"),
    )))
both("DML9", lambda d: "select id, 'stored' as policy from docs where is_public and expires_h < 700 union all select id, 'scheduled' from docs where expires_h < 700 and source <> 'src0'")
# documents under the older names, by the table of renamed categories
both("DML10", lambda d: f"select d.id, coalesce(r.now, d.category) as category from (select t.id, coalesce(o.category, t.category) as category from docs t left join {OLD} o on o.id = t.id % 17) d left join {RENAME} r on r.old = d.category")
both("DML12", lambda d: "select feed, case when count_if(not ok) = 0 then 'success' when count_if(ok) = 0 then 'failed' else 'partial' end as status, count_if(not ok) as errors from feed_runs group by feed")
both("DML13", lambda d: "select event_id, feed from feed_runs order by ts desc, event_id desc limit 50")
both("DML14", lambda d: """select page_id, host from (select a.page_id, a.host, row_number() over (partition by a.host order by contains(lower(a.title), 'the') desc, a.page_id) as n from articles a
    join (select url, min(page_id) as first from articles group by url) f on f.url = a.url and f.first = a.page_id) x where n <= 3""")
both("DML17", lambda d: """select user_id, count_if(not ok) as fails from (select user_id, ok, event_id, max(case when ok then event_id end) over (partition by user_id) as last_ok from
    (select user_id, event_type <> 'error' as ok, event_id from events) e) x where last_ok is null or event_id > last_ok group by user_id""")
both("DML20", lambda d: "select id, is_archived or activity_h < 24 as is_archived, coalesce(activity_h, 700) as activity_h from docs")
both("DML21", lambda d: "select t.id from docs t where t.is_public and not exists (select 1 from docs m where m.owner = 8 and not m.is_archived and m.title = t.title)")
