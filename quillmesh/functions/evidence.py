"""What a written answer is held against, as column expressions: names, small amounts, quotes, periods, regions, hedges (T-19 to T-21, T-27 to T-32, EV-2 to EV-8, W-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import text as T

# --- fixed values: words and patterns ---
NAME_STOP = (
    "i the this that these those it its if in on at for from to of and or but so as by with without yes no not "
    "ai would do does did is are was were be can could should will also here there what which who when where why how "
    "based according under over after before since during while both each every some any all most many more less other "
    "feed item items article articles source sources summary evidence passage note older latest recent new score "
    "telegram exa tavily brave rss want shall let sure ok okay please thanks "
    "january february march april may june july august september october november december "
    "jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday saturday sunday"
).split()
NAME = r"(?<=[a-z0-9,;:()\"'’] )([A-Z][A-Za-z0-9&-]*[A-Za-z0-9](?: [A-Z][A-Za-z0-9&-]*[A-Za-z0-9])*)"
MONEY = r"(?:[$€£৳]|\b(?:usd|bdt|tk|inr|eur)\s?)(\d{1,2})(?![\d.,])(?!\s*(?:million|billion|thousand|mn|bn|[mbk]\b))"
RATE = r"(?<![\d.,])\b(\d{1,2})(?![\d.,])\s*(?:/\s*(?:hr|hour|h|month|mo|year|yr|gpu|card)\b|per (?:hour|month|year|gpu|card)\b)"
SAYS_NOTHING = r"\b(do(es)? not|don.t|doesn.t|no item|none of the items|not (say|cover|mention|address)|(has|have) nothing (on|about)|no (items?|coverage|information|reporting) (on|about))\b"
NOT_IN_FEED = r"^\W*not in feed\W*$"
MISSES = r"\b(do(es)? not (cover|answer|address|discuss|mention|include)|cannot answer|can.t answer|nothing (on|about|to say)|no (information|data|details|reporting|items?|coverage) (on|about|regarding|for))\b"
HOW_MADE = r"\b(built|made|written|developed|coded|created) (in|with|using|by|on)\b|\busing\b|\bwith (claude|gpt|codex|cursor|ida|ghidra|rust|python)\b"
STRONG = r"\b(confirm(ed|s)?|verified|proven|definitely|clearly (shows|run|use))\b"
SOFT = r"\b(vendor|self[- ]reported|own (claim|announcement|blog|page|marketing)|marketing|press release|announcement|partner(ship)?|pilot|not independently)\b"
HEDGED = r"\b(thin|unclear|unknown|not (disclosed|confirmed|verified|found|public)|no (firm|clear|public|verified|confirmed|single|measured)|estimate[sd]?|partly|mixed|limited evidence|can.?t (say|confirm))\b"
CLAIM_LEAD = r"^\s*(confirmed|verified)\s*(count|deployments?|users?|products?|list)?\s*[:\-–—]\s*"
NUMBER_ASKED = r"\b(how (many|much)|what %|(a|one|real|actual) (single )?(number|figure|rate|percentage)|(actual|real) [\w ]{0,30}?(rate|number|share|percentage|count))\b"
ENTITY_WORDS = r"\b(reconstruction|reconstructions|project|repository|repo|case study|showcase|study|app|clone|the)\b"
SUBJECT_FILLERS = r"\b(github|repo|repository|the|mcp|tool|toolkit|project|page|readme|official|website|site|docs|agents|agent|cli|package|npm|help|framework|server|plugin|skill|v?\d+(\.\d+)*)\b"
OTHER_COUNTRIES = ["usa", "united states", "canada", "australia", "new zealand"]
PEOPLES = {"bangladeshi": "bangladesh", "indian": "india", "pakistani": "pakistan", "sri lankan": "sri lanka", "nepali": "nepal", "nepalese": "nepal"}
PAGE_CHROME = r"^(Skip to content|You signed in with another tab|You signed out|You switched accounts|Dismiss alert|Reload|Uh oh!|There was an error while loading|You must be logged in|Sign up for free|Copy link|More actions|Navigation Menu|Toggle navigation)"
NO_TITLE = r"^(untitled|microsoft word|document\d*|slide \d+)"
NO_TITLE_LINE = r"(copyright|©|permission|licen[cs]e|arxiv|https?:|doi|preprint|draft|confidential|page \d|\d{4}-\d{2}-\d{2}|@)"
# --- end of the fixed values ---

COUNTRIES = list(dict.fromkeys([c for cs in T.REGIONS.values() for c in cs] + OTHER_COUNTRIES))


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i)(?:{pattern})")


def _cut(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, f"(?i)(?:{pattern})", by)


def _none() -> Column:
    return F.array().cast("array<string>")


# T-20, T-21


def names(text: Column, question: Column) -> Column:
    """Capitalised names inside sentences, without words that name nothing and those that the question has."""
    q = T.unified(question)
    found = F.regexp_extract_all(F.regexp_replace(_s(text), r"\*\*|__|`", ""), F.lit(NAME), F.lit(1))
    words = lambda n: F.filter(F.split(n, " "), lambda w: ~F.lower(w).isin(NAME_STOP) & (F.length(w) > 1))
    bare = F.filter(F.transform(found, lambda n: F.array_join(words(n), " ")), lambda n: n != "")
    return F.array_distinct(F.filter(bare, lambda n: ~q.contains(F.lower(n))))


def unsupported(reply: Column, evidence: Column, question: Column, with_names: bool = False) -> Column:
    """Figures of a reply, and names if asked for, that neither its evidence nor the question has."""
    missing = F.array_except(F.array_except(T.figures(reply), T.figures(evidence)), T.figures(question))
    if not with_names:
        return missing
    ev = T.unified(evidence)
    strange = F.filter(names(reply, question), lambda n: ~F.exists(F.split(F.lower(n), " "), lambda w: ev.contains(w)))
    return F.concat(missing, strange)


def small_money(sentence: Column, evidence: Column, question: Column) -> Column:
    """Amounts and rates up to 20 that the evidence doesn't have in the same form, as money or as a rate."""
    plain = lambda c: F.regexp_replace(_s(c), r"(\d),(?=\d{3}\b)", "$1")
    ev, q, s = plain(evidence), _s(question), _s(sentence)
    num = lambda n: F.concat(F.lit(r"(?<![\d.,])"), n, F.lit(r"(?![\d]|[.,]\d)"))
    asked = lambda n: F.rlike(q, num(n))
    money = lambda n: F.rlike(ev, F.concat(F.lit(r"(?i)(?:[$€£৳]|\b(?:usd|bdt|tk|inr|eur)\s?)\s?"), num(n), F.lit("|"), num(n), F.lit(r"\s?(?:dollars|usd|taka)\b")))
    rate = lambda n: F.rlike(ev, F.concat(F.lit("(?i)"), num(n), F.lit(r"\s*(?:/|per\b)")))
    each = lambda p: F.filter(F.regexp_extract_all(s, F.lit(f"(?i){p}"), F.lit(1)), lambda n: n.cast("int") <= 20)
    return F.concat(F.filter(each(MONEY), lambda n: ~asked(n) & ~money(n)), F.filter(each(RATE), lambda n: ~asked(n) & ~rate(n)))


# T-19


def spell_words(topic: Column, least: int = 4, most: int = 4) -> Column:
    """The words of a topic that are worth checking."""
    w = F.filter(F.split(F.lower(_s(topic)), "[^a-z0-9-]+"), lambda x: (F.length(x) >= least) & x.rlike("^[a-z][a-z-]*$"))
    return F.slice(F.array_distinct(w), 1, most)


def respelled(topic: Column, fixes: Column) -> Column:
    """The topic with whole words replaced by what was meant; ``fixes`` are structs (typed, meant), a null meant changes nothing."""
    one = lambda t, f: F.regexp_replace(t, F.concat(F.lit(r"(?i)(^|[^a-z0-9-])\Q"), f["typed"], F.lit(r"\E(?=$|[^a-z0-9-])")), F.concat(F.lit("$1"), f["meant"]))
    return F.aggregate(fixes, _s(topic), lambda t, f: F.when(_s(f["meant"]) == "", t).otherwise(one(t, f)))


# T-27, T-28


def quote_form(c: Column) -> Column:
    """Text for comparing quotes: no marks and link targets, one kind of quote, dash and blank, lower case."""
    s = F.regexp_replace(F.regexp_replace(_s(c), r"\]\([^)]*\)", "]"), r"[*_`#>\[\]|]", " ")
    s = F.translate(s, "‘’“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def quote_stands(quote: Column, page: Column) -> Column:
    """Whether every part of a quote between ellipses stands on the page; quotes under eight characters prove nothing."""
    q = F.regexp_replace(quote_form(quote), r"^\.+|\.+$", "")
    parts = F.filter(F.transform(F.split(q, r"\.\.\.|…"), F.trim), lambda p: F.length(p) >= 6)
    return (F.length(q) >= 8) & F.forall(parts, lambda p: quote_form(page).contains(p))


def window_at(page: Column, quote: Column, span: int = 3500) -> Column:
    """The page around a quote, found as it is or else in its plain form; the page's beginning if it isn't there."""
    q = F.left(_s(quote), F.lit(60))
    at = F.when(q == "", 0).otherwise(F.position(q, page))
    plain, bare = quote_form(page), F.left(quote_form(q), F.lit(40))
    rough = F.floor((F.position(bare, plain) - 1) * F.length(page) / F.greatest(F.length(plain), F.lit(1))).cast("int")
    start = F.when(at > 0, at - 1).when((bare != "") & plain.contains(bare), rough).otherwise(0)
    low = F.greatest(F.lit(0), start - span)
    return F.substr(page, low + 1, start + span - low)


def compact(c: Column) -> Column:
    return F.regexp_replace(quote_form(c), "[^a-z0-9]", "")


def entity_key(c: Column) -> Column:
    """One key for spellings of an entity: the last part of a path, without brackets and words that say what it is."""
    bare = _cut(F.regexp_replace(F.element_at(F.split(_s(c), "/"), -1), r"\(.*?\)", ""), ENTITY_WORDS)
    return F.coalesce(F.nullif(compact(bare), F.lit("")), compact(c))


def subject_only(entity: Column, subjects: Column) -> Column:
    """Whether an entity says no more than the subject's names and words like page or tool."""
    form = lambda c: F.trim(F.regexp_replace(F.regexp_replace(quote_form(c), "[^a-z0-9/ ]+", " "), r"\s+", " "))
    n = form(entity)
    names_ = F.filter(F.transform(subjects, form), lambda k: k != "")
    rest = F.aggregate(names_, F.concat(F.lit(" "), n, F.lit(" ")), lambda r, k: F.replace(r, F.concat(F.lit(" "), k, F.lit(" ")), F.lit(" ")))
    return (F.length(n) < 3) | (F.length(F.regexp_replace(_cut(rest, SUBJECT_FILLERS, " "), r"[\s/]+", "")) < 3)


# T-29, T-30


def cutoff(question: Column, since: Column, today: str) -> Column:
    """The day before which nothing counts, as the question or a given date says; blank without any."""
    q = F.lower(_s(question))
    s = F.concat(_s(since), F.lit(" "), q)
    iso, month = r"\b(20\d\d)-(\d\d)(?:-(\d\d))?\b", r"\b(" + "|".join(T.MONTHS) + r")[a-z]*\.?\s+(20\d\d)\b"
    number = F.lpad(F.array_position(F.array(*map(F.lit, T.MONTHS)), F.regexp_extract(s, month, 1)).cast("string"), 2, "0")
    day = F.coalesce(F.nullif(F.regexp_extract(s, iso, 3), F.lit("")), F.lit("01"))
    year = F.regexp_extract(q, r"\bsince\s+(20\d\d)\b", 1)
    return (
        F.when(q.rlike(r"\bthis year\b"), f"{today[:4]}-01-01").when(q.rlike(r"\b(last|past) (12 months|year)\b"), f"{int(today[:4]) - 1}{today[4:10]}").when(q.rlike(r"\bthis month\b"), f"{today[:7]}-01")
        .when(s.rlike(iso), F.concat_ws("-", F.regexp_extract(s, iso, 1), F.regexp_extract(s, iso, 2), day))
        .when(s.rlike(month), F.concat_ws("-", F.regexp_extract(s, month, 2), number, F.lit("01"))).when(year != "", F.concat(year, F.lit("-01-01"))).otherwise("")
    )


def before_period(date: Column, cut: Column) -> Column:
    """Whether a readable date lies before the period asked for."""
    d = T.iso_date(date)
    return (_s(cut) != "") & (d != "") & (d < cut)


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(F.nullif(T.iso_date(b), F.lit("")).try_cast("date"), F.nullif(T.iso_date(a), F.lit("")).try_cast("date"))


def stale_note(dates: Column, today: str) -> Column:
    """What is said of sources without dates, or the newest of which is over half a year old; blank otherwise."""
    newest = F.array_max(F.filter(F.transform(dates, T.iso_date), lambda d: d != ""))
    old = F.datediff(F.lit(today).cast("date"), newest.try_cast("date")) > 183
    return F.when(newest.isNull(), "undated").when(F.coalesce(old, F.lit(False)), F.concat(F.lit("newest "), newest)).otherwise("")


def _word(c: str) -> str:
    return rf"\b{c}\b"


def asked_countries(question: Column, region: Column) -> Column:
    """The countries of the region, people or country that a question names first; null for none."""
    s = F.lower(F.concat(_s(region), F.lit(" "), _s(question)))
    out = None
    lit = lambda cs: F.array(*map(F.lit, cs))
    for r, cs in T.REGIONS.items():
        out = F.when(s.contains(r), lit(cs)) if out is None else out.when(s.contains(r), lit(cs))
    for a, c in PEOPLES.items():
        out = out.when(s.rlike(_word(a)), lit([c]))
    for c in COUNTRIES:
        out = out.when(s.rlike(_word(c)), lit([c]))
    return out


def countries_in(text: Column) -> Column:
    """The known countries that a text names."""
    t = F.lower(_s(text))
    return F.filter(F.array(*[F.when(t.rlike(_word(c)), F.lit(c)) for c in COUNTRIES]), lambda c: c.isNotNull())


def out_of_region(text: Column, asked: Column) -> Column:
    """Whether a text names countries, but none of those asked for; never without any asked for."""
    there = countries_in(text)
    return F.coalesce((F.size(there) > 0) & ~F.arrays_overlap(there, asked), F.lit(False))


# T-31, T-32


def shown_page(markdown: Column) -> Column:
    """A page without pictures, link targets and lines that its site puts on every page."""
    t = F.regexp_replace(F.regexp_replace(_s(markdown), r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\((?:[^()]|\([^)]*\))*\)", "$1")
    kept = F.filter(F.split(t, "\n"), lambda x: ~_has(F.trim(x), PAGE_CHROME))
    whole = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(whole, r"^\s+|\s+$", "")


def upload_title(file_name: Column, title: Column, text: Column) -> Column:
    """The document's own title if it says something, else the file's name, else the first line that looks like a title."""
    t = F.trim(_s(title))
    own = (F.length(t) >= 6) & ~_has(t, NO_TITLE) & ~_has(t, r"\.(docx?|pptx?|indd)$")
    name = F.trim(F.regexp_replace(_cut(_s(file_name), r"\.pdf$"), "_+", " "))
    words = lambda x: F.size(F.split(x, r"\s+"))
    lines = F.transform(F.split(F.left(_s(text), F.lit(1500)), r"\n+"), F.trim)
    fits = F.filter(lines, lambda x: words(x).between(3, 16) & (F.length(x) <= 140) & ~x.rlike("[.;,]$") & x.rlike("^[A-Z0-9]") & ~_has(x, NO_TITLE_LINE))
    return F.when(own, F.left(t, F.lit(200))).when((words(name) <= 2) & (F.size(fits) > 0), F.get(fits, F.lit(0))).otherwise(name)


def without_marks(text: Column) -> Column:
    """Text without bold, italic and heading marks."""
    t = F.regexp_replace(_s(text), r"\*\*(.+?)\*\*", "$1")
    for m in (r"\*", "_"):
        t = F.regexp_replace(t, rf"(^|\s){m}(?!\s)(.+?)(?<!\s){m}(?=\s|$)", "$1$2")
    return F.regexp_replace(t, r"(?m)^\s{0,3}#{1,6}\s+", "")


def from_html(html: Column) -> Column:
    """HTML as plain text: line breaks, no tags, entities unescaped."""
    t = F.regexp_replace(_cut(_s(html), r"<br\s*/?>", "\n"), "<[^>]+>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(t)


# EV-2 to EV-8


def replaced_sentence(answer: Column, old: Column, new: Column) -> Column:
    """An answer with the first sentence equal to ``old`` replaced, or taken out where ``new`` is blank."""
    ss = T.sentences(answer)
    k = F.array_position(ss, old).cast("int")
    head, tail = F.slice(ss, F.lit(1), F.greatest(k - 1, F.lit(0))), F.slice(ss, k + 1, F.size(ss))
    return F.when(k == 0, answer).otherwise(F.array_join(F.concat(head, F.when(_s(new) == "", _none()).otherwise(F.array(new)), tail), " "))


def fixed_answer(answer: Column, fixes: Column) -> Column:
    """(answer, fixed, quoted, dropped): each unsupported sentence replaced by its checked rewrite, else by a quote, else dropped with a note.

    ``fixes`` are structs (s, fix, fix_ok, quote).
    """
    take = lambda f: F.when(F.coalesce(f["fix_ok"], F.lit(False)) & (_s(f["fix"]) != ""), f["fix"]).otherwise(_s(f["quote"]))
    done = F.aggregate(fixes, _s(answer), lambda a, f: replaced_sentence(a, f["s"], take(f)))
    good = lambda f: F.coalesce(f["fix_ok"], F.lit(False)) & (_s(f["fix"]) != "")
    fixed, quoted = F.size(F.filter(fixes, good)), F.size(F.filter(fixes, lambda f: ~good(f) & (_s(f["quote"]) != "")))
    dropped = F.size(fixes) - fixed - quoted
    note = F.concat(F.lit(" ("), dropped, F.when(dropped == 1, " sentence").otherwise(" sentences"), F.lit(" removed: I could not confirm "), F.when(dropped == 1, "it").otherwise("them"), F.lit(" against the sources.)"))
    return F.struct(F.concat(done, F.when(dropped > 0, note).otherwise("")).alias("answer"), fixed.alias("fixed"), quoted.alias("quoted"), dropped.alias("dropped"))


def salvaged(answer: Column, uncited: Column, other_problems: Column) -> Column:
    """What is left without the uncited sentences if that is all that was wrong and two sentences stay; else blank."""
    kept = F.filter(T.sentences(answer), lambda s: ~F.array_contains(uncited, s))
    return F.when(other_problems | (F.size(kept) < 2), "").otherwise(F.array_join(kept, " "))


def answers_nothing(answer: Column) -> Column:
    """Whether an answer says that the items don't answer, with one cited sentence at most that does."""
    a = F.trim(_s(answer))
    ss = T.sentences(a)
    real = F.filter(ss, lambda s: (F.size(T.citations(s)) > 0) & ~_has(s, MISSES) & ~_has(s, SAYS_NOTHING))
    return _has(a, NOT_IN_FEED) | (F.exists(ss, lambda s: _has(s, MISSES)) & (F.size(real) <= 1))


def thin_note(items: Column) -> Column:
    return F.when(items <= 2, F.concat(F.lit("Your feed has only "), items, F.when(items == 1, " item").otherwise(" items"), F.lit(" on this:\n"))).otherwise("")


def overclaims(headline: Column, verdict: Column, points: Column) -> Column:
    """Whether a headline claims proof though every one of two points or more is soft: a vendor's word, a partner's, a pilot's."""
    head = F.concat(_s(headline), F.lit(" "), _s(verdict))
    return (F.size(points) >= 2) & _has(head, STRONG) & F.forall(points, lambda p: _has(_s(p), SOFT))


def softened(text: Column) -> Column:
    """Claims of proof turned into reports, letter case kept."""
    t = _s(text)
    for old, new in ((r"\bConfirm(s|ed)?\b", "Report$1"), (r"\bconfirm(s|ed)?\b", "report$1"), (r"\bVerified\b", "Reported"), (r"\bverified\b", "reported"), (r"(?i)\bproven\b", "reported")):
        t = F.regexp_replace(t, old, new)
    return t


def hedged(headline: Column, thin: Column) -> Column:
    """A headline that doesn't open with a claim of proof, and says so when the evidence is thin."""
    h = F.regexp_replace(_cut(_s(headline), CLAIM_LEAD), r"(?i)^\s*(confirmed|verified)\s+", "Reported ")
    soft = softened(h)
    said = F.concat(F.lit("Evidence is thin: "), F.lower(F.left(soft, F.lit(1))), F.substr(soft, F.lit(2)))
    return F.when(~F.coalesce(thin, F.lit(False)), h).when(_has(soft, HEDGED), soft).otherwise(said)


def spread_headline(headline: Column, question: Column, points: Column) -> Column:
    """A headline that says there is no single number where one was asked for and the points' percentages lie 8 % or more apart."""
    figs = F.array_distinct(F.flatten(F.transform(points, lambda p: F.transform(F.regexp_extract_all(_s(p), F.lit(r"(\d+(?:\.\d+)?)\s?%"), F.lit(1)), lambda x: x.cast("double")))))
    wide = (F.size(figs) >= 2) & (F.array_max(figs) >= 1.08 * F.array_min(figs))
    h = _s(headline)
    low = F.when(h.rlike("^[A-Z][a-z]"), F.concat(F.lower(F.left(h, F.lit(1))), F.substr(h, F.lit(2)))).otherwise(h)
    return F.when(_has(_s(question), NUMBER_ASKED) & F.coalesce(wide, F.lit(False)) & ~_has(h, HEDGED), F.concat(F.lit("No single measured number: "), low)).otherwise(h)


def claim_figures(claim: Column) -> Column:
    """The figures of a claim: no years, no whole numbers up to ten."""
    found = F.regexp_extract_all(F.regexp_replace(_s(claim), r"(\d),(\d{3})", "$1$2"), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda n: ~n.rlike(r"^(19|20)\d\d$") & ~(~n.contains(".") & (n.cast("double") <= 10))))


def ruled_out(why: Column, claims: Column, mentions: Column) -> Column:
    """The rank of a ruled-out entity worth a line: it was claimed or mentioned twice, and it is said how it was made; else null."""
    return F.when(((claims > 0) | (mentions >= 2)) & _has(_s(why), HOW_MADE), claims * 3 + mentions)


def quotable(quote: Column) -> Column:
    """Whether a quote can be checked by a reader: 20 to 260 characters, six words, no link and no heading."""
    q = _s(quote)
    return F.length(q).between(20, 260) & ~q.rlike(r"https?://|^\W*#") & (F.size(F.split(q, r"\s+")) >= 6)


# R-10


def initials(c: Column) -> Column:
    """The first letters of a name's words."""
    return F.array_join(F.transform(F.filter(F.split(quote_form(c), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.left(w, F.lit(1))), "")


def mentions(text: Column, subject: Column) -> Column:
    """Whether a text names the subject: as it is, run together, or by its initials as a word (three at least)."""
    t, s, short = quote_form(text), quote_form(subject), initials(subject)
    there = t.contains(s) | compact(text).contains(compact(subject))
    return (s != "") & (there | ((F.length(short) >= 3) & F.rlike(t, F.concat(F.lit(r"\b"), short, F.lit(r"\b")))))


def named_fit(name: Column, quote: Column, text: Column, subject: Column) -> Column:
    """Why a named find is refused: its quote is not in the text, it names the subject itself, or the text doesn't; null for one that fits."""
    return (
        F.when(~quote_stands(quote, text), "no such quote").when((_s(name) == "") | (entity_key(name) == entity_key(subject)) | subject_only(name, F.array(subject)), "the subject itself")
        .when(~compact(quote).contains(entity_key(name)) & ~compact(text).contains(entity_key(name)), "not named").when(~mentions(text, subject), "subject missing")
    )
