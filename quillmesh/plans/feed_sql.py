"""The SQL of the queries in feed_plan."""

from quillmesh.plans.urls_plan import _FRESH, _REC

I = "(select distinct on (id) * from feed_items order by id)"  # noqa: E741
_HOST = r"regexp_extract(lower(coalesce(canonical_url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1)"
_OK = "summary is distinct from 'TRIAGE_FAILED'"
_AMOUNT = "case when json_type(structured::json, '$.amount_usd') in ('BIGINT','UBIGINT','DOUBLE','HUGEINT') then (structured::json ->> '$.amount_usd')::double end"


def _get(path: str) -> str:
    return f"nullif(trim(structured::json ->> '$.{path}'), '')"


_SLUG = f"nullif(regexp_replace(lower({_get('round')}), '[^a-z0-9]+', '-', 'g'), '')"
_ROOT = "'st:' || coalesce(dup_of, id)::varchar"
_KEY = f"""case when {_get('company')} is not null then 'co:' || lower({_get('company')}) || '/' || coalesce({_SLUG}, '?')
  when {_get('instrument')} is not null then 'pol:' || coalesce(lower({_get('country')}), '?') || '/' || lower({_get('instrument')}) else 'item:' || id::varchar end"""


def _view(key: str) -> str:
    return f"""select story_key, count(*) as articles, max(score) as score, max(specificity) as specificity, max(angle_strength) as angle_strength, max(amount) as amount_usd,
      epoch_us(min(coalesce(published_at, created_at))) as first_published, epoch_us(max(coalesce(published_at, created_at))) as last_published, epoch_us(max(created_at)) as created_at, max(run_id) as run_id,
      list(id order by coalesce(score, 0) desc, id)[1] as rep_id, list(title order by coalesce(score, 0) desc, id)[1] as title, list(canonical_url order by coalesce(score, 0) desc, id)[1] as canonical_url
      from (select *, {key} as story_key, {_AMOUNT} as amount from {I}) group by 1"""


_RUNS = f"""select r.id, r.urls_new, coalesce(s.n, 0) as scraped, coalesce(m.n, 0) as made,
  case when coalesce(r.urls_new, 0) = 0 and coalesce(r.error, '') = '' then 'ok' when coalesce(s.n, 0) = 0 and coalesce(r.urls_new, 0) > 0 then 'failed'
    when coalesce(s.n, 0) < coalesce(r.urls_new, 0) then 'partial' when coalesce(m.n, 0) < coalesce(s.n, 0) then 'partial' else 'ok' end as status
  from runs r left join (select run_id, count(*) as n from raw_docs group by 1) s on s.run_id = r.id left join (select run_id, count(*) as n from {I} where {_OK} group by 1) m on m.run_id = r.id"""
_BACKLOG = f"""select rd.id, count(f.id) as items, coalesce(bool_or(f.summary = 'TRIAGE_FAILED'), false) as failed from raw_docs rd left join {I} f on f.raw_doc_id = rd.id group by rd.id
  having count(f.id) <> 1 or (bool_or(f.summary = 'TRIAGE_FAILED') and max(coalesce(rd.triage_failures, 0)) < 3)"""
_VOTES = "(select user_id as feed_item_id, arg_max(case when event_type = 'click' then 1 else -1 end, (ts, event_id))::int as vote, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as updated_at from events where event_type in ('click', 'error') group by 1)"
_FIGURES = """count(*) as n, count(*) filter (where score > 0) as scored, count(*) - count(*) filter (where score > 0) as unscored, count(*) filter (where score >= 7) as good, count(*) filter (where vote = 1) as up, count(*) filter (where vote = -1) as down,
  case when count(*) filter (where score > 0) > 0 then floor(100 * (count(*) filter (where score >= 7))::double / (count(*) filter (where score > 0)) + 0.5)::bigint || '%' else '-' end as good_rate,
  case when count(*) filter (where score > 0) > 0 then floor(10 * (sum(score) filter (where score > 0))::double / (count(*) filter (where score > 0)) + 0.5) / 10 end as avg_score"""
_SOURCED = f"(select f.id, f.canonical_url, f.score, coalesce(s.source, 'unknown') as source from {I} f left join (select canonical_url, max(source) as source from seen_urls group by 1) s using (canonical_url) where f.dup_of is null)"
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: t <> ''))"


def _vocab(where: str = "true", more: str = "") -> str:
    return f"select word, count(*) as ndoc from (select unnest({_TOK}) as word from doc_chunks where {where} {more}) where regexp_full_match(word, '[a-z]{{3,}}') group by 1"


_TOPICS = "(select * from (values (1, 'market'), (1, 'prices'), (1, 'spot'), (2, 'dismiss'), (2, 'motion'), (2, 'to'), (3, 'round'), (3, 'seed')) v(ord, lex))"
_LEX = f"(select raw_doc_id, n, md5(text) as text_md5, unnest({_TOK}) as lex from doc_chunks)"
_IDF = f"(select t.ord, t.lex, ln((select greatest(count(*), 1)::double from doc_chunks) / (1 + (select count(*) from {_LEX} x where x.lex = t.lex))) as idf from {_TOPICS} t)"
_BOILER = "(select md5(text) as text_md5 from doc_chunks group by 1 having count(distinct raw_doc_id) >= 3)"
_COVER = f"""(select h.ord, h.raw_doc_id, h.n, h.s / nullif(q.total, 0) as cover from (select i.ord, x.raw_doc_id, x.n, sum(greatest(i.idf, 0)) as s from {_IDF} i join {_LEX} x using (lex) where x.text_md5 not in (select text_md5 from {_BOILER}) group by 1, 2, 3) h
  join (select ord, sum(greatest(idf, 0)) as total from {_IDF} group by 1) q using (ord))"""
_FINE = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_V = f"(select raw_doc_id * 1048576 + n as id, raw_doc_id, n, md5(text) as text_md5, embedding::double[] as v from doc_chunks where {_FINE})"
_Q = f"(select id as q, v from {_V} where raw_doc_id % 100 = 0)"
_NEAR = f"(select *, row_number() over (partition by q order by sim desc, id) as k from (select q, id, raw_doc_id, n, round(list_cosine_similarity(a.v, b.v), 12) as sim from {_Q} a(q, v), {_V} b(id, raw_doc_id, n, text_md5, v)))"
_IV = f"(select i.*, c.v from {I} i left join (select raw_doc_id, arg_min(v, n) as v from {_V} group by 1) c using (raw_doc_id))"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w <> '' {1}))"


def _search(mode: str, where: str, limit: int = 20) -> str:
    """CTEs t (topics), pdoc (page hits), best (matches), listed and beside, of the search over ``mode`` item or story."""
    rows = (
        f"select id, title, canonical_url, summary, angle, relevance, score, tags, created_at, published_at, 1 as articles, v, 'it:' || id as match_key from {_IV} where {_OK}"
        if mode == "item"
        else f"""select l.id, f.title, f.canonical_url, f.summary, f.angle, null::int as relevance, s.score, f.tags, make_timestamptz(s.created_at) as created_at, make_timestamptz(s.last_published) as published_at, s.articles, l.v, s.story_key as match_key
          from ({_view(_ROOT)}) s join {I} f on f.id = s.rep_id left join (select canonical_url, max(id) as id, arg_max_null(v, id) as v from {_IV} group by 1) l on l.canonical_url = f.canonical_url where f.{_OK}"""
    )
    return f"""with t as materialized (select row_number() over (order by n desc, kw) as ord, kw, v as qv from (select kw, count(*) as n, arg_min(v, case when v is not null then id end) as v from (select id, v, unnest(list_distinct(tags)) as kw from {_IV}) where trim(kw) <> '' group by 1 order by n desc, kw limit 3)),
      tw as (select ord, unnest({_WORDS.format('kw', "and w <> 'ai'")}) as lex from t), lex as materialized {_LEX}, boiler as materialized {_BOILER},
      idf as materialized (select ord, lex, greatest(0, ln((select greatest(count(*), 1)::double from doc_chunks) / (1 + (select count(*) from lex x where x.lex = tw.lex)))) as w from tw),
      cov as (select ord, raw_doc_id, n, s / nullif(total, 0) as cover from (select ord, raw_doc_id, n, sum(w) as s from idf join lex using (lex) where text_md5 not in (select text_md5 from boiler) group by all) join (select ord, sum(w) as total from idf group by 1) using (ord)),
      near as (select ord, raw_doc_id, n, sim from (select ord, raw_doc_id, n, sim, row_number() over (partition by ord order by sim desc, id) as k from (select ord, id, raw_doc_id, n, round(list_cosine_similarity(qv, v), 12) as sim from t, {_V} where qv is not null and text_md5 not in (select text_md5 from boiler))) where k <= 40),
      pool as materialized (select *, coalesce(sim, 0) + 0.3 * coalesce(cover, 0) as pscore, coalesce(sim, 0) >= 0.55 or coalesce(cover, 0) >= 0.75 as hit from (select ord, raw_doc_id, n, max(sim) as sim, max(cover) as cover from (select ord, raw_doc_id, n, sim, null as cover from near union all select ord, raw_doc_id, n, null, cover from cov) group by all)),
      one as (select * from (select *, row_number() over (partition by ord, raw_doc_id order by pscore desc, n) as k from pool where hit) where k = 1),
      two as (select ord, raw_doc_id, n as pn2 from (select p.*, row_number() over (partition by p.ord, p.raw_doc_id order by p.pscore desc, p.n) as k from pool p join one o on o.ord = p.ord and o.raw_doc_id = p.raw_doc_id and o.n <> p.n) where k = 1),
      pdoc as materialized (select o.ord, o.raw_doc_id, o.n::int as pn, o.sim as psim, o.cover as pcover, o.pscore, two.pn2::int as pn2 from one o left join two using (ord, raw_doc_id)),
      pkey as (select * from (select *, row_number() over (partition by ord, match_key order by pscore desc, raw_doc_id, pn) as k from (select p.*, unnest(['it:' || i.id, 'st:' || coalesce(i.dup_of, i.id)]) as match_key from pdoc p join {I} i using (raw_doc_id))) where k = 1),
      call as (select *, {where} as in_filter from ({rows})),
      m as (select c.*, t.ord, list_cosine_similarity(c.v, t.qv) as sim, coalesce(len(list_filter(c.tags, lambda g: contains(g, lower(t.kw)))) > 0, false)
        or len(list_intersect({_WORDS.format('t.kw', "and w <> 'ai'")}, {_WORDS.format("concat_ws(' ', c.title, c.summary, c.angle, array_to_string(c.tags, ' '))", '')})) >= greatest(1, ceil(len({_WORDS.format('t.kw', "and w <> 'ai'")}) * 0.6)) as kw_hit, p.pn, p.psim, p.pcover, p.pscore, p.pn2
        from call c cross join t left join pkey p on p.ord = t.ord and p.match_key = c.match_key),
      b as (select *, round(case when kw_hit or coalesce(sim, -1) >= 0.45 then coalesce(sim, 0) + case when kw_hit then 0.15 else 0 end + case when pscore is not null then 0.05 else 0 end else coalesce(psim, 0) end, 6) as rel from m where kw_hit or coalesce(sim, -1) >= 0.45 or pscore is not null),
      best as materialized (select *, row_number() over (partition by ord, in_filter order by rel desc, score desc nulls last, published_at desc nulls last, id) as rn from (select *, row_number() over (partition by id order by ord, match_key) as k from b) where k = 1),
      listed as (select *, false as outside from best where in_filter and rn <= ceil({limit} / 3.0) order by ord, rn, score desc nulls last, published_at desc nulls last, id limit {limit}),
      beside as (select *, true as outside from best where not in_filter order by rel desc, score desc nulls last, id limit 5), found as (select * from listed union all select * from beside)"""


_FOUND = """ select id, ord::int as ord, round(sim, 5) as sim, kw_hit, round(rel, 5) as rel, rn::int as rn, outside, pn, pn2, articles, case when published_at is not null then greatest(0, floor((epoch(timestamptz '2026-04-25 00:00:00+00') - epoch(published_at)) / 86400)::int) end as age_days,
  (select count(*) from best where not in_filter) as outside_total from found"""
_SINCE = "coalesce(published_at, created_at) >= timestamptz '{0} 00:00:00+00'"
_E = "(select vec_id as id, embedding::double[] as v, label from embeddings)"
_OLD = f"(select id, older, sim from (select a.id, b.id as older, round(list_cosine_similarity(a.v, b.v), 12) as sim, row_number() over (partition by a.id order by round(list_cosine_similarity(a.v, b.v), 12) desc, b.id) as k from {_E} a join {_E} b on b.id < a.id) where k = 1)"
_BAND = "case when sim >= {0} then 'merge' when sim >= {1} then 'check' else 'new' end"
_TEXT = "concat_ws(' ', title, summary, angle, array_to_string(tags, ' '))"
_STORY = _view(_ROOT)

SQL = {
    "story_view": _STORY,
    "story_view_structured": _view(_KEY),
    "generated_score": f"select id, coalesce(specificity, 0) + coalesce(angle_strength, 0) as score, specificity, angle_strength from {I}",
    "json_amounts": f"select id, {_AMOUNT} as amount, structured::json ->> '$.round' as round from {I} where structured is not null",
    "deep_duplicates": f"select a.id, a.dup_of from {I} a where exists (select 1 from {I} b where b.id = a.dup_of and b.dup_of is not null)",
    "story_sizes": f"select articles, count(*) as stories from (select {_ROOT} as k, count(*) as articles from {I} group by 1) group by 1",
    "run_status": _RUNS,
    "backlog": _BACKLOG,
    "drain_batch": f"select id from ({_BACKLOG}) order by id limit 12",
    "backlog_when_idle": f"select id from ({_BACKLOG}) where not exists (select 1 from runs where lower(status) = 'running' and started_at > timestamptz '2026-04-24 23:45:00+00')",
    "pages_without_passages": "select id from raw_docs d where not exists (select 1 from doc_chunks c where c.raw_doc_id = d.id)",
    "top_titles": f"select run_id, list(title order by score desc nulls last, coalesce(relevance, -1) desc, id desc)[1] as title, list(id order by score desc nulls last, coalesce(relevance, -1) desc, id desc)[1] as id, count(*) as items from {I} where run_id is not null and {_OK} group by 1",
    "repaired_runs": """select id, case when live then 'failed' else lower(status) end as status, case when live then left(concat_ws('; ', nullif(error, ''), 'stopped'), 2000) else error end as error
      from (select *, coalesce(lower(status) = 'running' and started_at > timestamptz '2026-04-25 00:00:00+00' - interval 60 day, false) as live from runs)""",
    "error_digest": f"""select run_id, count(*) as hosts, array_to_string(list(host order by host)[1:5], ', ') || case when count(*) > 5 then ', …' else '' end as digest
      from (select distinct run_id, {_HOST} as host from raw_docs where run_id is not null) where host <> '' group by 1""",
    "last_runs": "select id, lower(status) as status, urls_new from runs order by id desc limit 5",
    "scorecard_by_source": f"select source, {_FIGURES} from (select s.*, v.vote from {_SOURCED} s left join {_VOTES} v on v.feed_item_id = s.id) group by 1",
    "scorecard_by_host": f"select {_HOST} as host, count(*) as n, count(*) filter (where score >= 7) as good, count(*) filter (where score > 0) as scored, coalesce(sum(score) filter (where score > 0), 0)::bigint as score_sum from {I} where dup_of is null group by 1",
    "scorecard_by_feed": f"""with feeds as (select *, regexp_extract(lower(url), '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1) as fh, coalesce(label, url) as name from sources where kind = 'rss'),
      rows_ as (select *, 0 as vote, {_HOST} as host from {_SOURCED} where source like 'rss%'),
      own as (select host, arg_min(id, (not active, id)) as feed_id from (select distinct host from rows_) h join feeds on host <> '' and fh <> '' and (host = fh or ends_with(host, '.' || fh) or ends_with(fh, '.' || host)) group by 1),
      found as (select coalesce(f.name || case when f.active then '' else ' (off)' end, 'RSS (other site)') as feed, {_FIGURES} from rows_ left join own using (host) left join feeds f on f.id = own.feed_id group by 1)
      select * from found union all select distinct name, 0, 0, 0, 0, 0, 0, '-', null::double from feeds where active and name not in (select feed from found)""",
    "latest_votes": f"select feed_item_id, vote, event_id from {_VOTES}",
    "taste_examples": f"select feed_item_id, vote, title, k::int as k from (select *, row_number() over (partition by vote order by updated_at desc, event_id desc) as k from {_VOTES}) v join {I} i on i.id = v.feed_item_id where k <= 6",
    "boilerplate_passages": "select md5(text) as text_md5, count(distinct raw_doc_id) as pages from doc_chunks where text is not null group by 1 having count(distinct raw_doc_id) >= 2",
    "vocabulary": _vocab(more=f"union all select unnest({_TOK}) from (select concat_ws(' ', title, summary) as text from {I})"),
    "topic_idf": f"select ord, lex, round(idf, 6) as idf from {_IDF}",
    "topic_coverage": f"select ord, raw_doc_id, n, round(cover, 6) as cover from {_COVER} where cover >= 0.75",
    "nearest_passages": f"select q, raw_doc_id, n::int as n, round(sim, 4) as sim from {_NEAR} where k <= 10",
    "hybrid_passages": _search("item", "true") + " select ord::int as ord, raw_doc_id, pn, pn2, round(pscore, 6) as pscore from pdoc",
    "story_urls": f"select {_ROOT} as story_key, (row_number() over (partition by {_ROOT} order by coalesce(score, 0) desc, id))::int as pos, canonical_url from {I}",
    "feed_search_items": _search("item", _SINCE.format("2025-06-01") + " and score >= 5") + _FOUND,
    "feed_search_stories": _search("story", _SINCE.format("2025-04-25")) + _FOUND,
    "feed_search_unknown": _search("story", _SINCE.format("2025-06-01") + " and relevance >= 4") + _FOUND,
    "feed_latest": f"""select id, null::int as ord, null::double as sim, null::boolean as kw_hit, null::double as rel, null::int as rn, false as outside, null::int as pn, null::int as pn2, 1 as articles, case when published_at is not null then greatest(0, floor((epoch(timestamptz '2026-04-25 00:00:00+00') - epoch(published_at)) / 86400)::int) end as age_days,
      0 as outside_total from {I} where {_OK} and score >= 6 order by score desc nulls last, published_at desc nulls last, id limit 20""",
    "feed_next": _search("item", "true", 15) + " select (5 + row_number() over (order by ord, rn, id))::int as n, id from (select *, row_number() over (order by ord, rn) as place from listed) where place > 5 order by ord, rn limit 5",
    "older_twin": f"select id, older, round(sim, 4) as sim from {_OLD}",
    "twin_action": f"select {_BAND.format(0.45, 0.40)} as action, count(*) as items from (select round(sim, 4) as sim from {_OLD}) group by 1",
    "twin_action_default": f"select {_BAND.format(0.87, 0.80)} as action, count(*) as items from {_OLD} group by 1",
    "other_label_twin": f"select id, older, round(sim, 4) as sim from (select a.id, b.id as older, round(list_cosine_similarity(a.v, b.v), 12) as sim, row_number() over (partition by a.id order by round(list_cosine_similarity(a.v, b.v), 12) desc, b.id) as k from {_E} a join {_E} b on b.id < a.id and b.label <> a.label) where k = 1",
    "story_roots": f"""with recursive p as (select e.id, t.older as parent from {_E} e left join (select id, older from {_OLD} where round(sim, 4) >= 0.40) t using (id)),
      up as (select id, id as root from p where parent is null union all select p.id, up.root from p join up on p.parent = up.id) select id, root from up""",
    "vector_faults": """select case when embedding is null then 'null' when len(embedding) <> 64 then 'length' when len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0 then 'not finite' when len(list_filter(embedding, lambda x: x <> 0)) = 0 then 'zero' else 'usable' end as kind, count(*) as passages from doc_chunks group by 1""",
    "recall_top3": f"""with m as (select distinct on (id) id, chat_id, embedding::double[] as v from chat_memory where {_FINE} order by id), s as (select q.id as asked, m.id, round(list_cosine_similarity(m.v, q.v), 6) as sim from m q join m on m.chat_id = q.chat_id and m.id <> q.id where q.id % 100 = 0)
      select asked, id, round(sim, 4) as sim from (select *, row_number() over (partition by asked order by sim desc, id) as k from s) where k <= 3 and sim >= 0.3""",
    "topic_brief": _search("story", "true") + f""", b1 as (select c.match_key, c.title, c.score, c.articles, c.created_at from call c join t on t.ord = 1 where c.created_at >= timestamptz '2026-01-01 00:00:00+00' and (len(list_filter({_WORDS.format('t.kw', '')}, lambda w: not list_contains({_WORDS.format("concat_ws(' ', c.title, c.summary, c.angle, array_to_string(c.tags, ' '))", '')}, w))) = 0 or coalesce(list_cosine_similarity(c.v, t.qv), -1) >= 0.45))
      select match_key, title, score, articles, (select count(*) from b1) as total from b1 order by score desc nulls last, created_at desc, match_key limit 5""",
    "nested_caps": f"""with i as (select id, run_id, score, coalesce(nullif(lower(trim(structured::json ->> '$.company')), ''), 'item ' || id) as entity from {I} where run_id is not null), a as (select *, row_number() over (partition by run_id order by score desc, id) as p from i),
      b as (select *, row_number() over (partition by entity order by score desc, id) as e from a where p <= 4) select id, run_id, entity, score from b where e <= 2 order by score desc, id limit 30""",
    "run_lists": f"select run_id, to_json(list({{'k': k::int, 'id': id, 'score': score}} order by k))::varchar as items from (select run_id, id, score, row_number() over (partition by run_id order by score desc, id) as k from {I} where run_id is not null) where k <= 3 group by 1",
    "silent_polls": f"""with f as (select 'rss:' || regexp_extract(regexp_extract(lower(url), '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1), '([a-z0-9-]+)[.][a-z]+$', 1) as name, max(bootstrapped_at) as b from sources where kind = 'rss' group by 1),
      n as (select source from {_FRESH} x join {_REC} r using (rec_id)) select coalesce(f.name is not null and f.b is null, false) as silent, count(*) as records, count(distinct n.source) as sources from n left join f on f.name = n.source group by 1""",
    "claimed_saves": f"select distinct feed_item_id from {_VOTES} where not (vote = 1 and feed_item_id % 10 <> 0)",
    "brief_windows": "select chat_id, epoch_us(case when n % 3 = 0 then now_ - interval 2 day when n % 3 = 1 then first_ else now_ - interval 7 day end) as since from (select chat_id, max(created_at) as now_, min(created_at) as first_, count(*) as n from (select distinct on (id) * from chat_memory order by id) group by 1)",
    "held_lease": "select kind as key, case when kind = 'rss' then 'next' else arg_max(url, (created_at, id)) end as value from sources group by kind",
    "brief_page": f"""with v as (select s.*, f.summary from ({_STORY}) s join {I} f on f.id = s.rep_id), w as (select * from v where created_at >= epoch_us(timestamptz '2026-01-01 00:00:00+00') and {_OK})
      select rep_id, title, score, articles, (select count(*) from w) as total, (select count(*) from w where score >= 7) as good from w order by score desc nulls last, created_at desc, rep_id limit 5 offset 5""",
    "filtered_items": f"select case when f then 'listed' when not f then 'outside' else 'neither' end as side, count(*) as items from (select coalesce(published_at, created_at) >= timestamptz '2025-06-01 00:00:00+00' and relevance >= 4 and score >= 6 as f from {I} where {_OK}) group by 1",
    "feed_list": f"""with w as {_TOPICS}, need as (select ord, greatest(1, ceil(count(*) * 0.6)) as need from w group by 1),
      h as (select w.ord, x.id, x.score, x.published_at, count(*) as hits from (select id, score, published_at, unnest({_TOK}) as lex from (select id, score, published_at, {_TEXT} as text from {I} where {_OK})) x join w using (lex) group by all),
      b as (select * from (select h.*, row_number() over (partition by id order by ord) as f from h join need using (ord) where hits >= need) where f = 1),
      r as (select *, row_number() over (partition by ord order by hits desc, score desc nulls last, published_at desc nulls last, id) as rn from b)
      select ord, id, hits, rn::int as rn from r where rn <= 7 order by ord, rn limit 20""",
    "feed_item_page": f"""select i.id, i.title, coalesce(left(p.t, 6000), left(d.markdown, 6000)) as page from (select * from {I} order by id limit 1 offset 2) i
      left join (select raw_doc_id, array_to_string(list(text order by n), chr(10) || chr(10)) as t from doc_chunks group by 1) p using (raw_doc_id) left join raw_docs d on d.id = i.raw_doc_id""",
    "list_positions": f"select run_id, pos::int as pos, id from (select run_id, id, row_number() over (partition by run_id order by id) as pos from {I} where run_id is not null) where pos in (2, 4, 5)",
    "joined_passages": "select raw_doc_id, left(array_to_string(list(text order by n), chr(10) || chr(10)), 1500) as text, count(*)::int as passages from doc_chunks group by 1",
    "reranked": f"""with r as (select id, row_number() over (order by score desc nulls last, id) as place from {I} order by place limit 12), s as (select id, place, (id % 7)::double as sc from r where place % 2 = 0),
      a as (select id, row_number() over (order by sc desc, place) as k from s), b as (select place, row_number() over (order by place) as k from s)
      select a.id, b.place::int as place from a join b using (k) union all select id, place::int from r where place % 2 = 1""",
    "passing_mentions": f"""select id, coalesce(angle is not null and not title like '%market%' and coalesce(sim, 0) < 0.45 and case when id % 2 = 0 and sim is not null then sim / 2 < 0.2 else coalesce(psim, 0) < 0.40 end, false) as passing
      from (select *, (score % 5) / 8.0 as sim, (relevance % 3) / 4.0 as psim from (select * replace (coalesce(title, '') as title) from {I}))""",
    "source_numbers": "select run_id, id, (row_number() over (partition by run_id order by published_at desc nulls last, id))::int as number from raw_docs where run_id is not null",
    "stable_sample": "select scraper, id, k::int as k from (select scraper, id, row_number() over (partition by scraper order by md5(id::varchar), id) as k from raw_docs) where k <= 3",
    "pass_cut": "select id, length(left(markdown, case when scraper like 'media:%' then 60000 when scraper = 'exa' then 6000 when scraper like 'upload:%' then 8000 else 2500 end))::int as read from raw_docs",
    "passage_text": r"""select raw_doc_id, n, md5(case when coalesce(title, '') <> '' then left(trim(title), 200) || chr(10) else '' end || case when fo > length(text) * 0.3 then left(text, 1500) else text end) as digest, fo as foreign
      from (select c.raw_doc_id, c.n, c.text, d.title, length(regexp_replace(c.text, '[\x00-\x7F]', '', 'g'))::int as fo from doc_chunks c join raw_docs d on d.id = c.raw_doc_id)""",
    "item_texts": f"select id, left(concat_ws(chr(10), title, summary, angle, case when len(tags) > 0 then 'Tags: ' || array_to_string(tags, ', ') end), 6000) as text from {I}",
    "replaced_items": f"select 'read again' as summary, count(*) as items from {I} where summary = 'TRIAGE_FAILED'",
    "cascade": f"select i.id, case when i.dup_of in (select dup_of from {I} where dup_of is not null) then null else i.dup_of end as dup_of from {I} i where i.id not in (select dup_of from {I} where dup_of is not null)",
    "reactivated_sources": "select url, label, true as active from sources union all select 'https://new.example/feed', 'New', true",
    "switched_off": "select id, case when contains(url, 'atom') then false else active end as active from sources",
    "failures_bumped": f"select id, t::bigint as triage_failures from (select d.id, coalesce(d.triage_failures, 0) + (d.id in (select raw_doc_id from {I} where summary = 'TRIAGE_FAILED'))::int as t from raw_docs d) where t > 0",
    "vocabulary_added": _vocab(),
    "evaluation_grid": f"""select cutoff, weight, count(*) filter (where hit and wanted) as "right", count(*) filter (where hit and not wanted) as wrong from (select cutoff, weight, relevance >= 4 as wanted, score / 10.0::double + weight * 0.01::double * relevance >= cutoff as hit
      from {I}, (select a / 10.0::double as cutoff, b as weight from (values (2), (4), (6)) x(a), (values (1), (2)) y(b)) where relevance is not null) group by 1, 2""",
}
