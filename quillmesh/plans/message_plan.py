"""Queries that route chat messages, one row a message, and their SQL (RT-1 to RT-14).

A chat's reply before a message is what its offers are looked for in; the last shown list is stood for by the exchange before.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import messages as M
from quillmesh.session import table


def _messages(s, d):
    w = Window.partitionBy("chat_id").orderBy("created_at", "id")
    c = table(s, d, "chat_memory").dropDuplicates(["id"])
    return c.select("id", "question", "answer", F.lag("question").over(w).alias("asked"), F.lag("answer").over(w).alias("replied"), (F.row_number().over(w) - 1).alias("before"))


def _with(s, d, c):
    return _messages(s, d).select("id", c.alias("c")).select("id", "c.*")


def message_deep(s, d):
    return _with(s, d, M.deep_ask(F.col("question"), F.col("asked")))


def message_sweep(s, d):
    return _with(s, d, M.sweep_decision(F.col("question"), F.col("replied")))


def message_save(s, d):
    ask = M.save_ask(F.col("question"))
    return _messages(s, d).select("id", ask["go"].alias("go"), F.array_join(ask["numbers"], ",").alias("numbers"), F.array_join(M.save_positions(ask, F.col("before"))["bad"], ",").alias("bad"))


def message_more(s, d):
    return _messages(s, d).select("id", M.more_route(F.col("question"), F.lit("brief"), F.lit(None), F.col("before")).alias("route"))


def message_brief(s, d):
    return _with(s, d, M.brief_ask(F.col("question"), F.lit("")))


def message_referent(s, d):
    one = F.when(F.col("before") > 0, F.array(F.lit("https://a.example/page")))
    return _messages(s, d).select("id", M.referent_kind(F.col("question")).alias("kind"), M.referent_route(F.col("question"), one, F.lit(5.0))["route"].alias("route"))


def message_search(s, d):
    return _with(s, d, M.search_gate(F.col("question"), F.col("replied")))


def message_big_picture(s, d):
    return _with(s, d, M.big_picture(F.col("question")))


def message_sources(s, d):
    return _with(s, d, M.source_quality(F.col("question")))


def message_fresh(s, d):
    return _messages(s, d).select("id", M.fresh_lookup(F.col("question"), F.col("answer"), F.lit(None).cast("array<string>")).alias("reason"))


def message_prefetch(s, d):
    return _with(s, d, M.prefetch(F.col("question")))


def message_web(s, d):
    need = M.needs_web(F.col("question"), F.col("answer"), F.lit(False), F.lit(0))
    return _messages(s, d).select("id", need["web"].alias("web"), need["reason"].alias("reason"), M.judge_needed(F.col("answer")).alias("judge"))


def message_bare(s, d):
    return _messages(s, d).select("id", M.bare_reply(F.col("question")).alias("bare"))


def message_media(s, d):
    """Links of the url records as messages: what they lead to."""
    u = table(s, d, "url_batches").dropDuplicates(["rec_id"])
    r = M.media_request(F.concat_ws(" ", F.lit("transcribe"), "url", F.lit("and list the prices")))
    return u.select("rec_id", M.media_link(F.col("url")).alias("media"), F.size(r["urls"]).alias("links"), r["transcribe"].alias("transcribe"), r["slides"].alias("slides"))


def message_history(s, d):
    return _messages(s, d).select("id", M.asks_history(F.col("question")).alias("asks"), M.uses_recall(F.col("answer"), F.col("before")).alias("uses"))


def message_relation(s, d):
    return _messages(s, d).select("id", M.relation_question(F.col("question")).alias("relation"))


def message_routes(s, d):
    """The path of every message: the routers in their order."""
    q, r = F.col("question"), F.col("replied")
    sweep = M.sweep_decision(q, r)["sweep"]
    route = (
        F.when(M.deep_ask(q, F.col("asked"))["go"], "deep").when(sweep != "", F.concat(F.lit("sweep "), sweep)).when(M.save_ask(q)["go"], "save").when(M.more_route(q, F.lit("brief"), F.lit(None), F.col("before")) != "", "more")
        .when(M.brief_ask(q, F.lit(""))["go"], "brief").when((M.referent_kind(q) == "bare") & (F.col("before") > 0), "referent").when(M.search_gate(q, r)["allowed"], "search").when(M.big_picture(q)["big"], "big picture").otherwise("agent")
    )
    return _messages(s, d).select("id", route.alias("route"))


QUERIES = {f.__name__: f for f in (
    message_deep, message_sweep, message_save, message_more, message_brief, message_referent, message_search, message_big_picture, message_sources, message_fresh, message_prefetch, message_web, message_bare, message_media, message_history, message_relation, message_routes,
)}

# The SQL says the same in other words: prefixes, word lists and single expressions written for it.
_C = "(select *, lag(question) over w as asked, lag(answer) over w as replied, row_number() over w - 1 as before from (select distinct on (id) * from chat_memory order by id) window w as (partition by chat_id order by created_at, id))"
_Q = f"(select *, coalesce(question, '') as q, trim(coalesce(question, '')) as tq, coalesce(answer, '') as r, coalesce(replied, '') as lr from {_C})"


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}', 'i')"


_SEARCHED = r"\b(searching|search|find me|look (it |that |this )?up|go (and )?get|dig (into|up)|run (a |another )?(new )?(web )?discovery|do (a |another )?(web )?search|track(ing)?)"
_VERB = f"{_m('q', _SEARCHED + r'\b')} and not {_m('q', r'(do not|don.?t|no need to|never|without|not|the|your|my|last|that|this|previous|earlier|did you|has it|have you) ' + _SEARCHED[2:] + r'\b')}"
_COMPARE = r"^(?:please )?(?:compare|comparing|contrast)\s+(.+?)\s+(?:and|with|vs\.?|versus|to|against)\s+(.+?)(?:\s+(?:on|in|for|over|regarding|when it comes to)\s+(.+))?$"
_BIG = [
    r"\bwhat('?s| is| are)\s+(happening|going on|changing|new)\s+(with|in|on|around|for|across)\b", r"\bwhat('?s| is) the (state|status|latest|story|picture|situation) (of|on|with|in)\b", r"\b(overview|summary|summari[sz]e|big picture|landscape|trends?|themes?|takeaways?|gist|state of play|compare|comparison|versus|vs)\b",
    r"\bhow (are|is|do|does|have|has)\b[^?]{0,60}\b(handling|dealing|approaching|responding|reacting|adapting|coping|managing|tackling|using|adopting|regulating|treating|thinking about)\b", r"\bwhat (do|does) (my|the) (feed|items|articles|sources) say about\b",
    r"\bwhat are the (main|key|latest|big|major) (developments|debates|arguments|issues|questions|risks|players|moves)\b", r"\b(explain|walk me through) (what|how|why)\b",
]
_PLAIN = [r"https?://|#\s?[0-9]+\b", r"\b(first|second|third|fourth|fifth|last) (one|item|article|story|link)\b", r"\b(item|number|no\.?)\s?[0-9]+\b", r"^(anything|any (news|updates?|items?))\b", r"\b(show me|list|give me the list|search|sweep|runs?|discover|find new|look up|scrape|add|remove|follow|unfollow|subscribe|schedule|transcribe|status|broke|broken|failed)\b"]
_IS_BIG = "len(regexp_split_to_array(tq, '\\s+')) >= 3 and (" + " or ".join(_m("tq", p) for p in _BIG) + ") and not (" + " or ".join(_m("tq", p) for p in _PLAIN) + " or " + _m("regexp_replace(tq, '(my|the|your) (sources?|feeds?) say', '', 'gi')", r"\b(my|the|your) (sources?|feeds?)\b") + ")"
_SOURCES, _RUNS = r"\b(sources?|feeds?|follow(ing)?|subscri\w*|blogs?|rss|watching)\b", r"\b(runs?|status|break|broke|broken|fail(ed|ing)?|working|stuck|queue)\b"
_TALK = r"\b(how are you|thanks?|thank you|hello|good (morning|night|evening)|who are you|what can you do|what do you do|help me use|how do (i|you) use)\b|^\s*(hi|hey|ok(ay)?|cool|nice|great)\b"
_FEEDQ = r"\b(anything (on|about|new|good|from)|what about|what('s| is) (new|happening)|tell me (more|about)|more (on|about)|show me|catch me up|what did (you|we) (find|get)|any (news|updates?|items?)|(first|second|third|fourth|fifth|last) one)\b|#\s?[0-9]+\b|\b(number|item|no\.?)\s?[0-9]+\b|^\s*[0-9]+[.)]\s"
_FACT = r"\?\s*$|^\s*(who|what|which|when|where|why|how|is|are|was|were|does|do|did|can|could|has|have|should|tell me)\b"
_FIGURE = r"[$€£৳]\s?[0-9]|[0-9][0-9,.]*\s?(%|percent|million|billion|bn|m\b|k\b)|\b(19|20)[0-9][0-9]\b"
_FINDS = r"\b(found|items?|articles?|stor(y|ies)|findings?|coverage|headlines?|i checked|in the feed|the feed (has|shows)|nothing (on|about|new)|no (recent |new |fresh )?(items|news|coverage|results|stories))\b"
_TAG = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tq, '^(hey|hi|so|ok(ay)?|and|also)[,!\\s]+', '', 'i'), '^\\s*(is there |do we have |have you got |got )?(anything|any (news|updates?|items?)|what(''s| is)? (new|happening)|what about|tell me (more )?about|more (on|about)|show me|catch me up)\\s*(on|about|with|for|regarding)?\\s*', '', 'i'), '[?!.]+\\s*$', ''), '^the\\s+', '', 'i'))"
_NONE = r"\b(feed|feed.s articles)\b[^.?!]{0,80}\b(doesn.t|does not|don.t|has no|have no|isn.t|is not|lacks?)\b|\bnothing (in|on|about)\b|\bno (recent |specific )?(articles?|items?|stories|news|coverage|results)\b[^.?!]{0,40}\b(on|about|in the feed|for)\b"
_BOT = r"\b(sources?|feeds? (are|you)|runs?|status|watching|subscri\w*|schedul\w*|scrape|transcribe|remember|forget)\b"
_MEM = r"\b(general knowledge|common knowledge|from (my )?(own )?(training|memory|knowledge)|isn.t in (your|the|my) feed|outside (of )?(your|the|my) feed)\b"
_LACK = r"\b(feed|items?|articles?|sources?|documents?)\b[^.?!]{0,160}\b(doesn.t|does not|don.t|do not|didn.t|isn.t|is not|aren.t|nothing|no specific|only (one|two|1|2))\b|\b(doesn.t|does not|don.t|do not|isn.t|no|nothing)\b[^.?!]{0,60}\b(specific|direct|details?|information|data|advice|mention|cover|answer|say)\b"
_OFFER = r"\b(would you like|do you want|want me to|shall i|should i|i can|i could|happy to)\b[^.?!]{0,80}\b(search|look (it |this )?up|run|find|check|dig|fetch|pull)\b"
_HIST = r"\b(we (discussed|talked|spoke)|did (we|i) (discuss|talk|ask)|did you (tell|say|mention|show|give)|you (told|said|mentioned|showed|gave) me|i asked( you)?|remind me what|last time (we|you|i))\b"
_USES = r"\b(earlier|previously|before|last time|you asked|i (told|found|said|gave)|we (talked|discussed|spoke))\b|\bon [0-9]{1,2} (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\b"
_REL = r"\b(products?|apps?|applications?|projects?|tools?|companies|company|startups?|firms?|banks?|brands?|teams?|people|developers?|businesses|services|organi[sz]ations?|governments?|clones?|alternatives?|things)\b[^?.!]{0,50}\b(built|building|build|made|created|developed|powered|based|using|use|used|uses|adopt(s|ed|ing)?|deploy(s|ed|ing)?)\b"

_DEEP = "deep[ -]*(search|research|dive)"
_BRIEF = "regexp_matches(tq, '^(brief me|catch me up|fill me in|what did i miss)( (please|on|about|for|with|from|since|today|yesterday|this|last)\\b|[,:;!.? ]*$)', 'i')"
_THING = "(the|that|this|your|ur) ((last|latest|previous|same) )?(video|clip|talk|podcast|episode|article|story|item|link|page|piece|post|paper|report|thread|interview|one|result|transcript)"
# without a lookahead: what may not follow is put in other words first
_FOLLOWED = f"regexp_replace(tq, '\\b{_THING}(s|-s|''s|’s)\\b', 'x', 'gi')"
_KIND = f"case when tq = '' or regexp_matches(tq, 'https?://', 'i') then '' when regexp_matches({_FOLLOWED}, '\\b{_THING}\\s+(about|on|from|by|with|where|that|which|called|titled|named)\\b', 'i') then 'described' when regexp_matches({_FOLLOWED}, '\\b{_THING}\\b', 'i') or regexp_matches(tq, '\\b(more|tell me|anything else) (more )?(about|on) (it|this|that)\\b|\\b(summari[sz]e|recap|explain|shorten|translate|break down|go over|unpack) (it|this|that)\\b', 'i') then 'bare' else '' end"
_SRC = r"\b(sources?|feeds?|rss|exa|brave|tavily|search engines?|providers?)\b"
_GOOD = r"\b(doing|worth|useful|useless|perform\w*|quality|good|best|worst|better|compare[ds]?|comparison|scorecard|score|pay(ing)?|keep(ing)?|drop|cut|value|deliver\w*|produc\w*)\b"

SQL = {
    "message_search": f"select id, {_VERB} as verb, length(tq) < 60 and {_m('tq', '^(yes|yep|sure|ok)')} and {_m('lr', 'search[^?]*[?]')} as agreed, ({_VERB}) or (length(tq) < 60 and {_m('tq', '^(yes|yep|sure|ok)')} and {_m('lr', 'search[^?]*[?]')}) as allowed from {_Q}",
    "message_fresh": f"""select id, case when trim(r) = '' then 'empty reply' when {_m('r', r'\b(running|started|starting|kicked off|launching|searching|scraping)\b[^.?!]*\b(search|sweep|discovery|scrape|run)\b')} then 'claims an action'
      when {_m('q', _FEEDQ)} and not {_m('q', _SOURCES)} then 'feed question' when {_m('q', _FACT)} and not {_m('q', _TALK)} and not {_m('q', _SOURCES)} and not {_m('q', _RUNS)} then 'question'
      when len(regexp_extract_all(r, '(?i){_FIGURE}')) >= 2 and not {_m('q', _TALK)} and not {_m('q', _SOURCES)} and not {_m('q', _RUNS)} then 'figures' when {_m('r', _FINDS)} and not {_m('q', _SOURCES)} then 'feed claims' else '' end as reason from {_Q}""",
    "message_prefetch": f"""select id, item, case when item is not null then '' when len(regexp_split_to_array({_TAG}, '\\s+')) <= 20 then {_TAG} else '' end as tag from (select *, nullif(list_position(['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth'], lower(regexp_extract(tq, '(?i)\\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth) (one|item|article|story|link)\\b', 1))), 0)::int as item from {_Q})""",
    "message_web": f"""select id, reason in ('from general knowledge', 'no answer') as web, reason, {_m('r', _OFFER)} or {_m('r', _LACK)} as judge from (select *, case when {_m('r', _MEM)} and not {_m('tq', 'https?://')} and not {_m('tq', '^(hi|hey|hello|thank)')} and not {_m('tq', _BOT)} then 'from general knowledge'
      when tq = '' or {_m('tq', r'^(hi|hey|hello|thanks?|ok(ay)?|cool|nice|great|bye|good (morning|night|evening))\b')} then 'small talk' when {_m('tq', _BOT)} then 'about the bot' when {_m('tq', 'https?://')} then 'a link' when not {_m('r', _NONE)} then 'answered' else 'no answer' end as reason from {_Q})""",
    "message_history": f"select id, {_m('q', _HIST)} as asks, before > 0 and {_m('r', _USES)} as uses from {_Q}",
    "message_relation": f"select id, {_m('q', _REL)} as relation from {_Q}",
    "message_bare": f"select id, regexp_replace(lower(tq), '[\\s!.?,]+$', '') in ('yes', 'y', 'yeah', 'yep', 'sure', 'ok', 'okay', 'k', 'no', 'n', 'nope', 'maybe', 'please', 'thanks', 'thank you', 'cool', 'great', 'nice', 'right', 'fine') as bare from {_Q}",
    "message_media": """select rec_id, regexp_matches(coalesce(url, ''), '^\\s*https?://([a-z0-9-]+\\.)*(youtube\\.com|youtu\\.be|vimeo\\.com|soundcloud\\.com|podcasts\\.apple\\.com|twitch\\.tv|rumble\\.com)([/?#]|\\s*$)', 'i') or (regexp_matches(trim(coalesce(url, '')), '^https?://', 'i') and regexp_matches(split_part(trim(coalesce(url, '')), '?', 1), '\\.(mp3|m4a|aac|wav|ogg|opus|flac|mp4|webm)(#|$)', 'i')) as media,
      len(list_distinct(list_transform(regexp_extract_all(coalesce(url, ''), '(?i)https?://[^\\s<>"'')\\]]+'), lambda x: regexp_replace(x, '[.,;:!?]+$', ''))))::int as links, true as transcribe, regexp_matches(regexp_replace(coalesce(url, ''), 'https?://[^\\s<>"'')\\]]+', ' ', 'gi'), '\\b(slides?|decks?|presentations?|watch(ing)?|look(ing)?)\\b', 'i') as slides
      from (select distinct on (rec_id) * from url_batches order by rec_id)""",
    "message_big_picture": f"""select id, {_IS_BIG} as big, case when regexp_matches(bq, '{_COMPARE}', 'i') then case when c <> '' then a || ' ' || c || ' | ' || b || ' ' || c else a || ' | ' || b end else
      trim(regexp_replace(regexp_replace(regexp_replace(tq, '^(hey|hi|so|ok(ay)?|and|also)[,!\\s]+', '', 'i'), '^what(''?s| is| are)\\s+(happening|going on|changing|new)\\s+(with|in|on|around|for|across)\\s+', '', 'i'), '[?!.]+\\s*$', '')) end as topic
      from (select *, regexp_extract(bq, '(?i){_COMPARE}', 1) as a, regexp_extract(bq, '(?i){_COMPARE}', 2) as b, regexp_extract(bq, '(?i){_COMPARE}', 3) as c from (select *, regexp_replace(tq, '[?!.]+\\s*$', '') as bq from {_Q}))""",
    "message_deep": f"select id, {_m('tq', _DEEP)} as go, case when {_m('tq', _DEEP)} then left(trim(regexp_replace(tq, '{_DEEP}', '', 'i')), 500) else '' end as question from {_Q}",
    "message_sweep": f"select id, '' as sweep, '' as topic from {_Q} where not contains(lr, 'Run a full sweep on')",
    "message_save": f"""select id, n <> 0 as go, case when n <> 0 then n::varchar else '' end as numbers, case when n > before then n::varchar else '' end as bad
      from (select *, coalesce(list_position(['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth'], lower(regexp_extract(tq, '(?i)^(?:please )?(?:save|keep|clip|bookmark) (?:the )?([a-z]+)(?: (?:one|item|article|story|video))?[.!]*$', 1))), 0) as n from {_Q})""",
    "message_more": f"select id, case when regexp_replace(lower(tq), '[.!? ]+$', '') in ('more', 'next', 'show more', 'show me more', 'next page', 'next five', 'next 5', 'keep going', 'any more', 'more please') then 'brief' else '' end as route from {_Q}",
    "message_brief": f"select id, {_BRIEF} as go, false as more, case when {_BRIEF} then trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(tq, 9), '^\\s*on\\b', ' ', 'i'), '\\b(since|from|over|during|in|for|the|please|thanks?|me|everything|all)\\b', ' ', 'gi'), '[?!.,:;]+', ' ', 'g'), '\\s+', ' ', 'g')) else '' end as topic, null::int as days from {_Q}",
    "message_referent": f"select id, {_KIND} as kind, case when {_KIND} = '' or before = 0 then '' when {_KIND} = 'bare' then 'item' else 'agent' end as route from {_Q}",
    "message_sources": f"select id, {_m('rq', _SRC)} and {_m('rq', _GOOD)} as asked, null::int as days from (select *, regexp_replace(q, 'open[- ]source', '', 'gi') as rq from {_Q})",
    "message_routes": f"""select id, case when {_m('tq', _DEEP)} then 'deep' when regexp_matches(tq, '^(?:please )?(?:save|keep|clip|bookmark) the (first|second|third|fourth|fifth)( one| item| story)?[.!]*$', 'i') then 'save' when regexp_matches(tq, '^(more|next|show (me )?more|keep going|any more|more please)[.!? ]*$', 'i') then 'more'
      when {_BRIEF} then 'brief' when {_KIND} = 'bare' and before > 0 then 'referent' when {_VERB} then 'search' when {_IS_BIG} then 'big picture' else 'agent' end as route from {_Q}""",
}
