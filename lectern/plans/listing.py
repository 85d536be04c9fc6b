"""Listings: filters, search, sorting and paging of a library's documents, feeds, notes and terms."""

from __future__ import annotations

from lectern.plans.base import both

NOW_H = 700  # hours after 2024-01-01

def sorted_by(rows: str, orders: dict[str, str], limit: str) -> str:
    """The page that each order gives of the same rows, as (sort, id)."""
    return " union all ".join(f"select * from (select '{name}' as sort, id from {rows} {name} order by {order}, id {limit}) p_{name}" for name, order in orders.items())


both("SRC1", lambda d: "select id, title, source_language, source from docs")
both("SRC2", lambda d: "select id, title, category from docs where id = 17")
def own_documents(d) -> str:
    """A user's documents of every status in both orders."""
    status = {"active": "not is_archived", "archived": "is_archived", "all": "true"}
    orders = {"activity": "activity_h desc nulls first, created_h desc", "created": "created_h desc"}
    return " union all ".join(
        f"select '{name}' as status, '{sort}' as sort, id, place from (select id, row_number() over (partition by owner order by {order}, id) as place from docs where owner = 8 and {rule} and title ilike '%e%') {name}_{sort}"
        for name, rule in status.items() for sort, order in orders.items())


both("FLT1", own_documents)
both("FLT2", lambda d: "select id, title from docs where source_type = 'uploaded' and not is_public order by created_h desc, id")
both("FLT3", lambda d: "select id, title from docs where source_type = 'explore' and not is_public order by created_h desc, id")
# a source of null is dropped by <>, as in SQL
# a source that is null is dropped by the comparison
both("FLT4", lambda d: sorted_by(f"""(select id, title, category, created_h, source, id % 17 as saved, id % 29 as viewed from docs where is_public and not is_archived and source <> 'src3' and category in ('Academic', 'News')
    and (title ilike '%an%' or source ilike '%1%'))""", {"recent": "created_h desc", "oldest": "created_h", "title": "title", "saved": "saved desc", "viewed": "viewed desc"}, "limit 50 offset 10"))
both("FLT5", lambda d: f"""select id, title, category, coalesce(nullif({d.rr('left(raw_content, 500)', chr(92) + 's+', ' ')}, ''), '') as snippet,
    {d.size(d.fn(d.split('raw_content', '[ ' + chr(92) + 'n' + chr(92) + 't' + chr(92) + 'r]+'), 'filter', 'w', "w <> ''"))} as word_count
    from docs where is_public and not is_archived order by created_h desc, id limit 24""")
both("FLT6", lambda d: """with hits as (select id, title, source, created_h from docs where (title ilike '%en%' or source ilike '%2%') and is_public)
    select h.id, h.title, h.source, t.total from hits h cross join (select count(*) as total from hits) t order by h.created_h desc, h.id limit 20 offset 20""")
both("FLT7", lambda d: """with hits as (select c_custkey as id, c_name as name, c_acctbal as balance from customer where c_name ilike '%1%' and c_mktsegment = 'BUILDING')
    select h.id, h.name, h.balance, t.pages from hits h cross join (select cast(ceil(count(*) / 20.0) as bigint) as pages from hits) t order by h.balance desc nulls last, h.id limit 20""")
both("FLT8", lambda d: "select event_id, event_type, user_id from events where user_id = 3 and event_type = 'error' order by ts desc, event_id desc limit 10 offset 2")
both("FLT9", lambda d: f"select id, title, expires_h from docs where is_public and expires_h < {NOW_H}")
both("FLT11", lambda d: f"""select feed, last_day from (select feed, max({d.days('ts')}) as last_day, count_if(not ok) as errors from feed_runs group by feed) f
    where errors < 60 and (last_day is null or last_day < 30) order by last_day asc nulls last, feed""")
both("FLT13", lambda d: "select page_id, title, host from articles where page_id % 3 <> 0 order by page_id desc")
# a literal search: % and _ stand for themselves
# the older names of a category count as the category
both("FLT14", lambda d: sorted_by(f"""(select t.id, t.title, t.created_h, t.activity_h, t.source_type from (select *, case id % 9 when 0 then 'Opinion' when 1 then 'Other' else category end as stored from docs) t
    where not is_archived and stored in ('News', 'Essays', 'Opinion', 'Other', 'Non-fiction') and source_type in ('uploaded', 'web', 'rss') and (contains(lower(title), 'the') or contains(lower(raw_content), 'worth') or contains(lower(source), 'src1')))""",
    {"recent": "coalesce(activity_h, created_h) desc", "created": "created_h desc", "title": "title", "oldest": "created_h"}, "limit 100"))
both("FLT15", lambda d: """select id, title from docs where is_public and (contains(lower(title), 'le') or contains(lower(title), 'st') or contains(lower(source), 'src5'))""")
both("FLT16", lambda d: "select id, title from docs where not is_archived order by coalesce(activity_h, created_h) desc, id desc limit 1")
# all of the chosen tags, of a term with three
both("FLT18", lambda d: f"""select id, term, translation, mastery from (select *, {'array' if d.spark else 'list_value'}(tag, split_part(translation, ' ', 1), case when mastery > 3 then 'known' else 'open' end) as tags from glossary) g
    where (term ilike '%a%' or translation ilike '%steel%') and {'array_contains' if d.spark else 'list_contains'}(tags, 'Brand#1') and {'array_contains' if d.spark else 'list_contains'}(tags, 'open') order by mastery, id""")
both("FLT19", lambda d: sorted_by("""(select s.id, s.doc_id, s.sentence, coalesce(i.level, -1) as level from sentences s left join (select item, level from item_state where user_id = 5) i on i.item = s.id % 40
    where s.sentence ilike '%tion%' and coalesce(i.level, -1) < 3)""", {"newest": "id desc", "oldest": "doc_id", "alphabet": "sentence", "level": "level desc"}, "limit 50 offset 5"))
both("FLT20", lambda d: """select id, pos, case when pos > 31 then '…' else '' end || substr(sentence, cast(greatest(1, pos - 30) as int), cast(least(30, pos - 1) + 53 as int)) ||
    case when pos + 53 <= length(sentence) then '…' else '' end as snippet from
    (select id, sentence, cast(instr(lower(sentence), 'the') as bigint) as pos from sentences) s where pos > 0""")
both("FLT21", lambda d: "select page_id, host from articles where not (host = 'example.com' or host like '%.example.com' or host = 'site3.org' or host like '%.site3.org')")
both("FLT23", lambda d: f"select page_id, url from pages where {d.like('url', '^https?://')} and length(url) <= 2000 and not {d.like('url', '^https?://(localhost|127' + chr(92) + '.0' + chr(92) + '.0' + chr(92) + '.1)')}")
both("FLT25", lambda d: """select user_id, fails, fails >= 5 as locked from (select user_id, count_if(event_type = 'error') as fails from events group by user_id) f""")
both("FLT26", lambda d: """select n.notebook, count(*) as found from notes n join notebooks b on n.notebook = b.id where n.content ilike '%urgent%' group by n.notebook""")
both("FLT28", lambda d: "select turn, conv_id from conversations where role = 'user' and not text like '%ing%'")
DELIVERED = "(select page_id, title, url from articles union all select page_id + 1000000, title, url from articles where page_id % 10 = 0)"  # every tenth page is delivered twice
both("FLT29", lambda d: f"select a.page_id from {DELIVERED} a join (select title, url, min(page_id) as first from {DELIVERED} b group by title, url) f on f.title = a.title and f.url = a.url where a.page_id > f.first")
both("SRT1", lambda d: "select id, activity_h, created_h from docs order by activity_h desc nulls first, created_h desc, id limit 40")
both("SRT2", lambda d: "select user_id, item, level from item_state order by (last_day + power(2, level) <= 30) desc, level, user_id, item limit 10")
both("SRT3", lambda d: "select d.id, t.pages from docs d cross join (select cast(ceil(count(*) / 12.0) as bigint) as pages from docs) t order by d.id limit 12 offset 24")
both("SRT4", lambda d: "select owner, max_by(id, created_h * 100000 + id) as latest from docs group by owner")
both("SRT5", lambda d: "select id from docs where owner = 8 order by md5(cast(id as varchar(20)) || ':7'), id limit 1" if not d.spark else "select id from docs where owner = 8 order by md5(cast(id as string) || ':7'), id limit 1")
both("SRT6", lambda d: f"select id, term from glossary order by md5(cast(id as {'string' if d.spark else 'varchar'}) || ':3'), id limit 7")
both("SET1", lambda d: "select id, 'upload' as kind from docs where source_type = 'uploaded' union all select id, 'saved' from docs where source_type = 'explore'")
both("SET2", lambda d: "select l_partkey as id from lineitem where l_returnflag = 'A' union select l_partkey from lineitem where l_returnflag = 'R'")
both("SET3", lambda d: "select doc_id from documents except select doc_id from labels")
both("SET4", lambda d: "select 'sentence' as kind, id, cast(null as bigint) as mastery from sentences union all select 'term', id, mastery from glossary where mastery < 2")
both("SET5", lambda d: "select feed, min(origin) as origin from (select feed, 0 as origin from feed_runs where feed < 10 union all select feed, 1 from feed_runs where ok) f group by feed")
