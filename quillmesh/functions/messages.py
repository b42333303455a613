"""What a chat message asks for, one function a router (RT-1 to RT-14); each gives a struct with the arguments it found.

Fixed values: the patterns below are those by which messages are routed; all are read without regard to letter case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns ---
DEEP = r"(?:(?:please|pls|can you|could you)\s+)?(?:(?:do|run|start)\s+(?:a|another|the)\s+)?deep[\s-]*(?:search|research|dive)"
DEEP_START = rf"^\s*{DEEP}(?:\s+(?:on|into|for|about|of))?\s*[:,\-–—]?\s*"
DEEP_END = rf"[\s,.;:\-–—]*\b{DEEP}(?:\s+(?:please|pls|on (?:that|this|it)|it))?[\s.!?]*$"
DEEP_VAGUE = r"^(?:(?:on|into|for|about)\s+)?(?:that|this|it|this one|that one|the last one|my (?:last )?question|the (?:same )?question)?\s*(?:please|pls|again)?[\s.!?]*$"
YES = r"^(yes|y|yeah|yep|yup|sure|ok|okay|go ahead|go for it|do it|run it|confirm(ed)?|please( do)?)\b"
NO = r"^(no|n|nope|nah|don'?t|do not|cancel|skip( it)?|not now|never ?mind|stop)\b"
SWEEP_OFFER = r"Run a full sweep on (.+?)\? It hits exa"
SAVE = r"^(?:please |pls |can you |could you )?(?:save|keep|clip|bookmark)\s+(.+?)(?:\s+(?:to|in|into|for)\s+(?:obsidian|my (?:vault|notes)|the vault|notes|later))?$"
SAVE_IT = r"^(?:it|this|that|this one|that one)$"
SAVE_ORDINAL = r"^(?:the\s+)?(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|last)(?:\s+(?:one|item|article|story|video))?$"
SAVE_NUMBERS = r"^#?\s?\d{1,3}(?:\s*(?:,|and|&|-|to)\s*#?\s?\d{1,3})*$"
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]
MORE = r"^\s*(?:more|next|next (?:5|five|page)|show (?:me )?more|the next (?:5|five)|keep going|any more\??|more please)\s*[.!?]*\s*$"
BRIEF = r"^\s*(?:hey |ok |so |please )?(?:(?:can you |could you )?(?:give me |send me )?(?:a |my |the )?(?:brief(?:ing)?|recap|catch[- ]?up)(?: me)?|brief me|catch me up|what did i miss|fill me in|bring me up to (?:date|speed))\b"
BRIEF_MORE = r"^\s*(?:more|next|next (?:5|five|page)|show (?:me )?more|the next (?:5|five)|keep going)\s*[.!?]*\s*$"
BRIEF_TAIL = r"^\s*(?:[,:;!.?]+\s*)?(?:$|(?:please\b|on|about|for|regarding|re|with|from|since|today|yesterday|this|last|past|everything|all)\b)"
BRIEF_WINDOW = r"\b(today|yesterday|this week|last week|past week|this month|last (\d{1,2}) days?|past (\d{1,2}) days?)\b"
NOUN = r"(?:video|clip|talk|podcast|episode|article|story|item|link|page|piece|post|paper|report|thread|interview|one|result|transcript)"
REFERENT = rf"\b(?:the|that|this|your|ur)\s+(?:last\s+|latest\s+|previous\s+|same\s+)?{NOUN}\b(?![-'’]?s\b)"
DESCRIBED = rf"{REFERENT}\s+(?:about|on|from|by|with|where|that|which|called|titled|named)\b"
PRONOUN = "|".join([
    r"\b(?:summari[sz]e|recap|explain|shorten|simplify|rewrite|redo|reformat|translate|tl;?dr|break down|go over|unpack)\s+(?:it|this|that)\b",
    r"\bwhat (?:does|did|is) (?:it|this|that) (?:say|said|cover|mean|about|argue|claim|conclude)",
    r"\b(?:more|tell me|anything else) (?:more )?(?:about|on) (?:it|this|that)\b",
    r"^(?:so |and |but )?(?:is|was) (?:it|this|that) (?:worth (?:it|watching|reading|a look)|any good|legit|accurate)\s*[?.!]*$",
])
TRANSFORM = r"^(?:can you |could you |please |pls |now |ok(?:ay)?,? )*(summari[sz]e|recap|shorten|simplify|rewrite|redo|reformat|tl;?dr|summary|shorter|simpler|briefer|again)\b"
FORMAT = r"\b(?:without|with|no|minus|skip|drop|remove|the|a|an|any|all|in|into|as|to|of|for|me|just|only|please|pls|it|this|that|again|version|summary|plain|simple|simpler|short|shorter|brief|briefly|quick|quickly|english|text|prose|paragraphs?|bullets?|bullet points?|points?|lines?|sentences?|words?|timestamps?|time ?stamps?|times|links?|emojis?|numbers?|formatting|one|two|three|four|five|\d+)\b"
MEDIA_NOUN = r"\b(?:video|clip|talk|podcast|episode|interview|transcript)\b"
MEDIA_PAGE = r"youtube\.com/watch|youtu\.be/|vimeo\.com|soundcloud\.com|podcasts\.apple\.com|twitch\.tv|ted\.com/talks|rumble\.com"
SEARCH = r"\b(search(ing)?( for| up)?|find me|look (it |that |this )?up|look up|go (and )?get|dig (into|up)|run (a |another )?(new )?(web )?(search|discovery)|do (a |another )?(web )?search|track(ing)?)\b"
SEARCH_NEGATED = r"\b(don'?t|do not|no need to|never|without|not)\s+(\w+\s+){0,2}$"
SEARCH_MENTIONED = r"\b(the|your|my|last|that|this|previous|earlier)\s+$|\b(did|have|has|had)\s+(you|it|we)\s+$"
SEARCH_OFFER = r"\b(search|look (it |that )?up|dig into|run (a )?(search|discovery))\b[^?]*\?"
BIG_PICTURE = "|".join([
    r"\bwhat('?s| is| are)\s+(happening|going on|changing|new)\s+(with|in|on|around|for|across)\b",
    r"\bwhat('?s| is) the (state|status|latest|story|picture|situation) (of|on|with|in)\b",
    r"\bhow (are|is|do|does|have|has)\b[^?]{0,60}\b(handling|dealing|approaching|responding|reacting|adapting|coping|managing|tackling|using|adopting|regulating|treating|thinking about)\b",
    r"\b(overview|summary|summari[sz]e|big picture|landscape|trends?|themes?|takeaways?|gist|state of play)\b",
    r"\b(compare|comparison|versus|vs\.?)\b",
    r"\bwhat (do|does) (my|the) (feed|items|articles|sources) say about\b",
    r"\bwhat are the (main|key|latest|big|major) (developments|debates|arguments|issues|questions|risks|players|moves)\b",
    r"\b(explain|walk me through) (what|how|why)\b",
])
NOT_BIG = "|".join([
    r"https?://", r"#\s?\d+\b", r"\b(first|second|third|fourth|fifth|last) (one|item|article|story|link)\b", r"\b(item|number|no\.?)\s?\d+\b",
    r"^\s*(anything|any (news|updates?|items?))\b", r"\b(show me|list|give me (a list|the list))\b",
    r"\b(search|sweep|run|discover|find new|look up|scrape|add|remove|follow|unfollow|subscribe|schedule|transcribe)\b",
    r"\b(run|runs|status|broke|broken|failed)\b", r"\b(my|the|your) (sources?|feeds?)\b(?! say)",
])
COMPARED = [
    r"^(?:please\s+)?(?:compare|comparing|contrast)\s+(.+?)\s+(?:and|with|vs\.?|versus|to|against)\s+(.+?)(?:\s+(?:on|in|for|over|regarding|when it comes to)\s+(.+))?$",
    r"^(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\s+(?:on|in|for|over)\s+(.+))?$",
]
TOPIC_LEADS = [
    r"^\s*(hey|hi|so|ok(ay)?|and|also)[,!\s]+",
    r"^(can you |could you |please )?(give me |tell me )?(an? )?(quick |short |brief )?(overview|summary|rundown|gist|big picture)( of| on| about)?\s*",
    r"^what('?s| is| are)\s+(happening|going on|changing|new)\s+(with|in|on|around|for|across)\s+",
    r"^what('?s| is) the (state|status|latest|story|picture|situation) (of|on|with|in)\s+",
    r"^summari[sz]e\s+(what (my|the) feed (says|has) (on|about)\s+)?",
    r"^what (do|does) (my|the) (feed|items|articles|sources) (say|have) (about|on)\s+",
    r"^what are the (main|key|latest|big|major) (developments|debates|arguments|issues|questions|risks|players|moves) (in|on|around|about|with)\s+",
    r"[?!.]+\s*$",
]
SOURCES_ASKED = r"\bhow (are|is|did|have|has) (my |the |our |all )?(rss |search )?(sources?|feeds?)\b"
SOURCE_WORDS = r"\b(sources?|feeds?|rss|exa|brave|tavily|search engines?|providers?)\b"
QUALITY_WORDS = r"\b(doing|worth|useful|useless|perform\w*|quality|good|best|worst|better|compare[ds]?|comparison|scorecard|score|pay(ing)?|keep(ing)?|drop|cut|value|deliver\w*|produc\w*)\b"
ORIGIN_ASKED = r"\bwhere do (my |the )?(best|good|top|useful)\b[^?]*\bcome from\b"
SOURCES_LISTED = r"\bwhat (feeds|sources)\b[^?]*\b(watching|following|follow|have)\b"
SOURCES_JUDGED = r"\b(good|worth|doing|best)\b"
CLAIMS_ACTION = r"\b(running|started|starting|kicked off|launching|searching|scraping)\b[^.?!]*\b(search|sweep|discovery|scrape|run)\b"
ABOUT_SOURCES = r"\b(sources?|feeds?|follow(ing)?|subscri\w*|blogs?|rss|watching)\b"
ABOUT_RUNS = r"\b(runs?|status|break|broke|broken|fail(ed|ing)?|working|stuck|queue)\b"
FEED_QUESTION = r"\b(anything (on|about|new|good|from)|what about|what('s| is) (new|happening)|tell me (more|about)|more (on|about)|show me|catch me up|what did (you|we) (find|get)|any (news|updates?|items?)|(first|second|third|fourth|fifth|last) one)\b|#\s?\d+\b|\b(number|item|no\.?)\s?\d+\b|^\s*\d+[.)]\s"
SMALL_TALK = r"\b(how are you|thanks?|thank you|hello|good (morning|night|evening)|who are you|what can you do|what do you do|help me use|how do (i|you) use)\b|^\s*(hi|hey|ok(ay)?|cool|nice|great)\b"
FACT_QUESTION = r"\?\s*$|^\s*(who|what|which|when|where|why|how|is|are|was|were|does|do|did|can|could|has|have|should|tell me)\b"
FIGURE = r"[$€£৳]\s?\d|\d[\d,.]*\s?(%|percent|million|billion|bn|m\b|k\b)|\b(19|20)\d\d\b"
CLAIMS_FINDINGS = r"\b(found|items?|articles?|stor(y|ies)|findings?|coverage|headlines?|i checked|in the feed|the feed (has|shows)|nothing (on|about|new)|no (recent |new |fresh )?(items|news|coverage|results|stories))\b"
PREFETCH_ORDINAL = r"\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth) (one|item|article|story|link)\b"
PREFETCH_NUMBER = r"#\s?(\d{1,3})\b|\b(?:number|item|no\.?)\s?(\d{1,3})\b|^\s*(\d{1,3})[.)]\s"
PREFETCH_LEADS = [
    r"^\s*(hey|hi|so|ok(ay)?|and|also)[,!\s]+",
    r"^\s*(is there |do we have |have you got |got )?(anything|any (news|updates?|items?)|what('s| is)? (new|happening)|what about|tell me (more )?about|more (on|about)|show me|catch me up)\s*(on|about|with|for|regarding)?\s*",
    r"[?!.]+\s*$",
    r"^the\s+",
]
NO_ANSWER = r"\b(the feed|your feed|feed's articles)\b[^.?!]{0,80}\b(doesn.t|does not|don.t|has no|have no|isn.t|is not|lacks?|no (recent |specific |direct )?(articles?|items?|stories|news|coverage|mention|details?|information|data))\b|\bnothing (in|on|about)\b[^.?!]{0,60}|\bno (recent |specific )?(articles?|items?|stories|news|coverage|results)\b[^.?!]{0,40}\b(on|about|in the feed|for)\b|couldn.t confirm an answer|not covered (by|in) (the|your) feed|feed doesn.t (say|specify|mention|cover|include|have)|\bfeed\b[\s\S]{0,220}?\b(doesn.t|does not|didn.t|did not|don.t|do not) (specify|say|mention|include|give|state|list|cover|contain|have|answer)\b"
HELLO = r"^\s*(hi|hey|hello|thanks?|thank you|ok(ay)?|cool|nice|great|bye|good (morning|night|evening))\b"
ABOUT_BOT = r"\b(sources?|feeds? (are|you)|runs?|status|watching|subscri\w*|schedul\w*|scrape|transcribe|remember|forget)\b"
FROM_MEMORY = r"\b(general knowledge|common knowledge|from (my )?(own )?(training|memory|knowledge)|not (found )?in (your|the|my) (current )?(rss )?feed|isn.t in (your|the|my) feed|outside (of )?(your|the|my) feed)\b"
OFFERS_SEARCH = r"\b(would you like|do you want|want me to|shall i|should i|i can|i could|happy to|let me know if you('d| would) like)\b[^.?!]{0,80}\b(search|look (it |this )?up|run|find|check|dig|fetch|pull)\b"
SAYS_LACK = r"\b(feed|items?|articles?|sources?|documents?)\b[^.?!]{0,160}\b(doesn.t|does not|don.t|do not|didn.t|isn.t|is not|aren.t|nothing|no specific|only (one|two|1|2))\b|\b(doesn.t|does not|don.t|do not|isn.t|no|nothing)\b[^.?!]{0,60}\b(specific|direct|details?|information|data|advice|mention|cover|answer|say)\b"
BARE = r"^(yes|y|yeah|yep|yup|yea|sure|ok|okay|k|no|n|nope|nah|maybe|go ahead|do it|please|thanks|thank you|thx|cool|great|nice|right|fine|alright|got it)$"
MEDIA_LINK = r"^https?://(?:[a-z0-9-]+\.)*(?:youtube\.com|youtu\.be|vimeo\.com|soundcloud\.com|podcasts\.apple\.com|twitch\.tv|ted\.com/talks|rumble\.com)(?:[/?#]|$)"
AUDIO_FILE = r"\.(mp3|m4a|aac|wav|ogg|opus|flac|mp4|webm)(\?|#|$)"
NO_VIDEO = r"youtube\.com/(?:@|c/|channel/|user/|playlist|results|feed)"
SLIDES = r"\b(slides?|decks?|presentations?|watch(ing)?|look(ing)?)\b"
TRANSCRIBE = r"\b(transcribe|transcription|listen(ing)?|hear(ing)?)\b"
MEDIA_FILLER = r"\b(?:check|this|that|it|out|here|look|at|please|pls|summari[sz]e|summary|sum up|tl;?dr|of|the|a|an|video|clip|vid|link|podcast|episode|fyi|interesting|thoughts?|can you|could you|for me|me|and|see|new|one|cool|wow|lol|haha|nice|great|just|watch|via)\b"
LINK = r"https?://[^\s<>\"')\]]+"
ASKS_HISTORY = r"\b(we (discussed|talked|spoke)|did (we|i) (discuss|talk|ask)|did you (tell|say|mention|show|give)|you (told|said|mentioned|showed|gave) me|i asked( you)?|remind me what|last time (we|you|i))\b"
USES_RECALL = r"\b(earlier|previously|before|last time|you asked|i (told|found|said|gave)|we (talked|discussed|spoke))\b|\bon \d{1,2} (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\b"
RELATION = r"\b(products?|apps?|applications?|projects?|tools?|companies|company|startups?|firms?|banks?|brands?|teams?|people|developers?|businesses|services|organi[sz]ations?|governments?|clones?|alternatives?|things)\b[^?.!]{0,50}?\b(built|building|build|made|created|developed|powered|based|using|use|used|uses|adopt(s|ed|ing)?|deploy(s|ed|ing)?)\b"
SAVE_MOST, REF_MINUTES = 10, 120
# --- end of the fixed values ---


def _s(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _is(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}" if "|" not in pattern else f"(?i)(?:{pattern})")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, f"(?i)(?:{pattern})", group)


def _cut(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, f"(?i)(?:{pattern})", by)


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def deep_ask(message: Column, last_message: Column) -> Column:
    """RT-1 (go, question): asks for deep research at its start or end; a vague one means the message before."""
    t = _s(message)
    start = _is(t, DEEP_START)
    left = F.when(start, F.regexp_replace(t, f"(?i){DEEP_START}", " ")).otherwise(_cut(t, DEEP_END, " "))
    left = F.regexp_replace(_tidy(left), r"^[,.;:\-–—\s]+|[,;:\-–—\s]+$", "")
    asked = F.when((F.length(left) < 8) | _is(left, DEEP_VAGUE), F.trim(_s(last_message))).otherwise(left)
    go = start | _is(t, DEEP_END)
    return _struct(go=go, question=F.when(go, F.left(asked, F.lit(500))).otherwise(""))


def sweep_decision(message: Column, last_reply: Column) -> Column:
    """RT-2 (sweep, topic): the answer to an offer to search everything; go, no or blank."""
    offer = _part(_s(last_reply), SWEEP_OFFER, 1)
    m = F.trim(_s(message))
    sweep = F.when(~_is(_s(last_reply), SWEEP_OFFER), "").when((F.length(m) < 60) & _is(m, YES), "go").when((F.length(m) < 40) & _is(m, NO), "no").otherwise("")
    topic = F.when(_is(F.trim(offer), "^the default beat$"), "").otherwise(F.trim(offer))
    return _struct(sweep=sweep, topic=F.when(sweep == "", "").otherwise(topic))


def save_ask(message: Column) -> Column:
    """RT-3 (go, it, numbers): which items of the last list are to be kept: one number, a list or a range of at most ten; -1 is the last."""
    t = F.regexp_replace(F.trim(_s(message)), "[.!]+$", "")
    what = F.trim(_part(t, SAVE, 1))
    it = _is(what, SAVE_IT)
    word = F.lower(_part(what, SAVE_ORDINAL, 1))
    place = F.when(word == "last", -1).otherwise(F.array_position(F.array(*map(F.lit, ORDINALS)), word).cast("int"))
    body = _cut(what, r"^(?:items?|numbers?|nos?\.?|#)\s*")
    ends = r"^#?\s?(\d{1,3})\s*(?:-|to)\s*#?\s?(\d{1,3})$"
    low, high = _part(body, ends, 1).try_cast("int"), _part(body, ends, 2).try_cast("int")
    span = F.when(low <= high, F.sequence(low, F.least(high, low + SAVE_MOST - 1)))
    listed = F.slice(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"(\d{1,3})")), lambda x: x.cast("int"))), 1, SAVE_MOST)
    none = F.array().cast("array<int>")
    numbers = F.when(it | (what == ""), none).when(word != "", F.array(place)).when(~_is(body, SAVE_NUMBERS), none).when(_is(body, ends), F.coalesce(span, none)).otherwise(listed)
    return _struct(go=it | (F.size(numbers) > 0), it=it, numbers=numbers)


def save_positions(ask: Column, listed: Column) -> Column:
    """(numbers, bad): the positions that a save asks for in a list of so many items, and those that the list doesn't have."""
    numbers = F.when(ask["it"], F.when(listed == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).otherwise(F.transform(ask["numbers"], lambda n: F.when(n == -1, listed.cast("int")).otherwise(n)))
    return _struct(numbers=F.filter(numbers, lambda n: (n >= 1) & (n <= listed)), bad=F.filter(numbers, lambda n: (n < 1) | (n > listed)))


def more_route(message: Column, list_kind: Column, list_query: Column, listed: Column) -> Column:
    """RT-4: what the next page is of: ``brief``, ``feed``, ``none``, or blank for other messages."""
    stored = F.get_json_object(_s(list_query), "$").startswith("{")
    return F.when(~_is(_s(message), MORE), "").when(_s(list_kind).isin("brief", "brief-topic"), "brief").when(F.coalesce(stored, F.lit(False)) & (F.coalesce(listed, F.lit(0)) > 0), "feed").otherwise("none")


def brief_ask(message: Column, list_kind: Column) -> Column:
    """RT-5 (go, more, topic, days): asks for what is new, on a topic or over a window."""
    t, kind = F.trim(_s(message)), _s(list_kind)
    more = _is(t, BRIEF_MORE) & kind.isin("brief", "brief-topic")
    rest = F.when(_is(t, BRIEF), F.regexp_replace(t, f"(?i){BRIEF}", ""))
    go = more | F.coalesce(_is(rest, BRIEF_TAIL), F.lit(False))
    window = F.lower(_part(_s(rest), BRIEF_WINDOW, 1))
    given = F.coalesce(F.nullif(_part(_s(rest), BRIEF_WINDOW, 2), F.lit("")), F.nullif(_part(_s(rest), BRIEF_WINDOW, 3), F.lit(""))).cast("int")
    days = F.when(window == "today", 1).when(window == "yesterday", 2).when(window.contains("week"), 7).when(window.contains("month"), 30).otherwise(given)
    # only the first window goes
    at = F.instr(F.lower(_s(rest)), window)
    left = F.when(window == "", _s(rest)).otherwise(F.concat(F.substring(rest, F.lit(1), at - 1), F.lit(" "), F.substring(rest, at + F.length(window), F.length(rest))))
    topic = _cut(left, r"^[\s,:]*(?:on|about|with|for|regarding|re)\b", " ")
    topic = _cut(topic, r"\b(?:since|from|over|during|in|for|the|please|thanks?|me|everything|all)\b", " ")
    topic = _tidy(F.regexp_replace(topic, "[?!.,:;]+", " "))
    plain = go & ~more
    return _struct(go=go, more=more, topic=F.when(plain, topic).otherwise(""), days=F.when(plain, days))


def referent_kind(message: Column) -> Column:
    """RT-6: whether a message is about one thing shown before: ``described``, ``bare`` or blank."""
    t = F.trim(_s(message))
    form = _is(t, TRANSFORM) & (F.regexp_replace(_cut(F.regexp_replace(t, f"(?i){TRANSFORM}", ""), FORMAT, " "), "(?i)[^a-z]+", "") == "")
    return F.when((t == "") | _is(t, "https?://"), "").when(_is(t, DESCRIBED), "described").when(_is(t, REFERENT) | _is(t, PRONOUN) | form, "bare").otherwise("")


def referent_route(message: Column, urls: Column, age_minutes: Column) -> Column:
    """RT-6 (route, n): the item of the last list (its ``urls`` in order) that a message can only mean, or ``agent`` to find out."""
    kind, n = referent_kind(message), F.size(F.coalesce(urls, F.array().cast("array<string>")))
    media = F.filter(F.transform(urls, lambda u, i: F.when(_is(_s(u), MEDIA_PAGE), i + 1)), lambda i: i.isNotNull())
    one = F.when((kind == "bare") & (n == 1), 1).when((kind == "bare") & _is(_s(message), MEDIA_NOUN) & (F.size(media) == 1), media[0])
    live = (kind != "") & (n > 0) & age_minutes.between(0, REF_MINUTES)
    return _struct(route=F.when(~F.coalesce(live, F.lit(False)), "").when(one.isNotNull(), "item").otherwise("agent"), n=F.when(live, one))


def search_gate(message: Column, last_reply: Column) -> Column:
    """RT-7 (verb, agreed, allowed): asks to search, by a verb that is neither negated nor only mentioned, or by a yes to an offer."""
    t = _s(message)
    # each verb with all that is before it
    befores = F.regexp_extract_all(t, F.lit(f"(?i){SEARCH}"), F.lit(0))
    marked = F.split(F.regexp_replace(t, f"(?i){SEARCH}", "\u0001"), "\u0001")
    heads = F.transform(F.sequence(F.lit(1), F.size(befores)), lambda k: F.array_join(F.zip_with(F.slice(marked, 1, k), F.slice(F.concat(F.array(F.lit("")), befores), 1, k), lambda a, b: F.concat(b, a)), ""))
    fair = F.exists(heads, lambda h: ~h.rlike(f"(?i){SEARCH_NEGATED}") & ~h.rlike(f"(?i)(?:{SEARCH_MENTIONED})"))
    verb = F.when(F.size(befores) > 0, fair).otherwise(F.lit(False))
    m = F.trim(t)
    agreed = (F.length(m) < 60) & _is(m, YES) & _is(_s(last_reply), SEARCH_OFFER)
    return _struct(verb=verb, agreed=agreed, allowed=verb | agreed)


def big_picture(message: Column) -> Column:
    """RT-8 (big, topic): asks for an overview; the topic, or both sides of a comparison with what they are compared on."""
    q = F.trim(_s(message))
    big = (F.size(F.split(q, r"\s+")) >= 3) & ~_is(q, NOT_BIG) & _is(q, BIG_PICTURE)
    bare = F.regexp_replace(q, r"[?!.]+\s*$", "")
    topic = q
    for lead in TOPIC_LEADS:
        topic = F.regexp_replace(topic, f"(?i){lead}", "")
    topic = F.trim(topic)
    for pattern in reversed(COMPARED):
        a, b, on = (_part(bare, pattern, k) for k in (1, 2, 3))
        both = F.when(on != "", F.concat(a, F.lit(" "), on, F.lit(" | "), b, F.lit(" "), on)).otherwise(F.concat(a, F.lit(" | "), b))
        topic = F.when(_is(bare, pattern), both).otherwise(topic)
    return _struct(big=big, topic=topic)


def source_quality(message: Column) -> Column:
    """RT-9 (asked, days): asks how good the sources are, over so many days."""
    q = _s(message)
    plain = _cut(q, r"\bopen[- ]source\b")
    listed = _is(plain, SOURCES_LISTED) & ~_is(plain, SOURCES_JUDGED)
    asked = _is(plain, SOURCES_ASKED) | (~listed & ((_is(plain, SOURCE_WORDS) & _is(plain, QUALITY_WORDS)) | _is(plain, ORIGIN_ASKED)))
    days = F.nullif(_part(q, r"\b(?:last|past)\s+(\d{1,3})\s+days?\b", 1), F.lit("")).cast("int")
    days = F.coalesce(days, F.when(_is(q, r"\b(this|last|past) week\b"), 7).when(_is(q, r"\b(this|last|past) month\b"), 30))
    return _struct(asked=asked, days=days)


def fresh_lookup(message: Column, reply: Column, tools: Column) -> Column:
    """RT-9: why a reply has to be made again with a lookup; blank where it hasn't. ``tools`` are the names of those used."""
    q, r = _s(message), _s(reply)
    tools = F.coalesce(tools, F.array().cast("array<string>"))
    talk, sources, runs = _is(q, SMALL_TALK), _is(q, ABOUT_SOURCES), _is(q, ABOUT_RUNS)
    figures = F.size(F.regexp_extract_all(r, F.lit(f"(?i)(?:{FIGURE})"), F.lit(0)))
    told = _is(q, r"\b(runs?|break|broke|broken|fail(ed|ing)?|work(ed|ing)?|status)\b") & _is(r, r"\brun\s*#?\d+")
    return (
        F.when(source_quality(message)["asked"] & ~F.array_contains(tools, "manage_sources"), "source quality")
        .when(F.size(tools) > 0, "")
        .when(F.trim(r) == "", "empty reply")
        .when(_is(r, CLAIMS_ACTION), "claims an action")
        .when(_is(q, FEED_QUESTION) & ~sources, "feed question")
        .when(_is(q, FACT_QUESTION) & ~talk & ~sources & ~runs, "question")
        .when((figures >= 2) & ~talk & ~sources & ~runs, "figures")
        .when(_is(r, CLAIMS_FINDINGS) & ~sources & ~told, "feed claims")
        .otherwise("")
    )


def prefetch(message: Column) -> Column:
    """RT-9 (item, tag): what to look up before answering: an item's number, or a topic of at most twenty words."""
    q = F.trim(_s(message))
    word = F.lower(_part(q, PREFETCH_ORDINAL, 1))
    number = F.coalesce(*[F.nullif(_part(q, PREFETCH_NUMBER, k), F.lit("")) for k in (1, 2, 3)]).cast("int")
    item = F.when(word != "", F.array_position(F.array(*map(F.lit, ORDINALS)), word).cast("int")).otherwise(number)
    tag = q
    for lead in PREFETCH_LEADS:
        tag = F.regexp_replace(tag, f"(?i){lead}", "")
    tag = F.trim(tag)
    return _struct(item=item, tag=F.when(item.isNotNull() | (F.size(F.split(tag, r"\s+")) > 20), "").otherwise(tag))


def needs_web(message: Column, reply: Column, already: Column, feed_items: Column) -> Column:
    """RT-10 (web, reason): whether the web has to be searched since the reply doesn't answer."""
    q, r = F.trim(_s(message)), _s(reply)
    link, talk, bot = _is(q, "https?://"), _is(q, HELLO), _is(q, ABOUT_BOT)
    reason = (
        F.when(already, "already from the web").when(feed_items > 0, "answered from items").when(_is(r, FROM_MEMORY) & ~link & ~talk & ~bot, "from general knowledge")
        .when((q == "") | talk, "small talk").when(bot, "about the bot").when(link, "a link").when(~_is(r, NO_ANSWER), "answered").otherwise("no answer")
    )
    return _struct(web=reason.isin("from general knowledge", "no answer"), reason=reason)


def judge_needed(reply: Column) -> Column:
    """RT-10: whether a judge has to tell if the reply answers: it offers a search or says that something is missing."""
    return _is(_s(reply), OFFERS_SEARCH) | _is(_s(reply), SAYS_LACK)


def bare_reply(message: Column) -> Column:
    """RT-11: a yes, no or thanks by itself."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_s(message))), r"[\s!.?,👍🙏]+$", ""), r"^[\s!.?,]+", "")
    return (F.length(t) <= 20) & _is(t, BARE)


def media_link(url: Column) -> Column:
    """RT-12: whether a link leads to a recording."""
    u = F.trim(_s(url))
    bare = F.concat(F.substring_index(u, "?", 1), F.when(u.contains("?"), "?").otherwise(""))
    return _is(u, "^https?://") & ~_is(u, NO_VIDEO) & (_is(u, MEDIA_LINK) | _is(bare, AUDIO_FILE))


def media_request(message: Column) -> Column:
    """RT-12 (urls, slides, transcribe, instruction): the links of a message and what is to be done with them."""
    t = _s(message)
    urls = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(f"(?i){LINK}"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")))
    words = _cut(t, LINK, " ")
    tidy = _tidy(words)
    # one word of either kind goes, fillers all
    rest = _cut(_first_out(_first_out(tidy, SLIDES), TRANSCRIBE), MEDIA_FILLER, " ")
    rest = F.trim(F.regexp_replace(rest, r"[^\p{L}\p{N}]+", " "))
    return _struct(urls=urls, slides=_is(words, SLIDES), transcribe=_is(words, TRANSCRIBE), instruction=F.when(F.length(rest) >= 2, F.left(tidy, F.lit(500))).otherwise(""))


def _first_out(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"(?i)^(.*?)(?:{pattern})", "$1 ")


def asks_history(message: Column) -> Column:
    """RT-13: asks what was said before."""
    return _is(_s(message), ASKS_HISTORY)


def uses_recall(reply: Column, recalled: Column) -> Column:
    """RT-13: a reply that refers to an earlier chat, where there are any."""
    return (F.coalesce(recalled, F.lit(0)) > 0) & _is(_s(reply), USES_RECALL)


def relation_question(message: Column) -> Column:
    """RT-14: asks for things that stand in a relation to a subject."""
    return _is(_s(message), RELATION)
