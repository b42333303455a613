"""Text scalars as column expressions: figures, citations, dates, times, regions, snippets, names of files (T-10 to T-34, M-7, M-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
UNITS = {"billion": "b", "bn": "b", "million": "m", "mn": "m", "thousand": "k", "percent": "%", "per cent": "%"}
SCALE = {"k": 1e3, "m": 1e6, "b": 1e9}
# Regions a question may name, and their countries.
REGIONS = {
    "south asia": ["india", "pakistan", "bangladesh", "sri lanka", "nepal", "bhutan", "maldives", "afghanistan"],
    "southeast asia": ["indonesia", "malaysia", "singapore", "thailand", "vietnam", "philippines", "myanmar", "cambodia", "laos", "brunei", "timor-leste"],
    "east asia": ["china", "japan", "south korea", "korea", "taiwan", "mongolia", "hong kong"],
    "middle east": ["uae", "united arab emirates", "saudi arabia", "qatar", "kuwait", "bahrain", "oman", "israel", "jordan", "lebanon", "iraq", "iran", "turkey", "egypt"],
    "africa": ["nigeria", "kenya", "south africa", "egypt", "ghana", "ethiopia", "rwanda", "morocco", "tanzania", "uganda", "senegal"],
    "europe": ["uk", "united kingdom", "france", "germany", "italy", "spain", "netherlands", "sweden", "poland", "ireland", "denmark", "finland", "norway", "switzerland", "belgium", "austria", "portugal", "estonia"],
    "latin america": ["brazil", "mexico", "argentina", "chile", "colombia", "peru"],
}


def unified(text: Column) -> Column:
    """Lower case, one kind of dash and blank, no thousands separators and currency signs, units as letters."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    s = F.regexp_replace(s, "[‐‑‒–—―−]", "-")
    s = F.regexp_replace(s, r"([0-9]),([0-9]{3})\b", "$1$2")
    s = F.regexp_replace(s, r"([0-9]),([0-9]{3})\b", "$1$2")
    s = F.regexp_replace(s, r"\$ ?", "")
    for word, unit in UNITS.items():
        s = F.regexp_replace(s, rf"([0-9]) ?{word}\b", f"$1{unit}")
    return s


def figures(text: Column) -> Column:
    """Distinct figures with their unit, amounts in k, m and b written out; bare counts up to 20 and years are no figures."""
    words = F.split(unified(text), r"[^a-z0-9.%]+")
    clean = F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    kept = F.filter(clean, lambda w: w.rlike(r"^[0-9]+(\.[0-9]+)?[%bmkx]?$"))

    def whole(w: Column) -> Column:
        n, u = F.regexp_extract(w, r"^([0-9.]+)", 1).cast("double"), F.regexp_extract(w, r"([bmk])$", 1)
        factor = F.when(u == "b", 1e9).when(u == "m", 1e6).when(u == "k", 1e3)
        return F.when(u != "", F.round(n * factor).cast("decimal(38,0)").cast("string")).otherwise(w)

    def counts(w: Column) -> Column:
        bare = w.rlike("^[0-9]+$")
        n = w.try_cast("double")
        return ~(bare & ((n <= 20) | ((n >= 1990) & (n <= 2035))))

    return F.array_distinct(F.transform(F.filter(kept, counts), whole))


def citations(text: Column) -> Column:
    """Item numbers cited as [1], [1, 4] or [2-5]; a range gives at most 20."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,2}(?:\s*[,–-]\s*[0-9]{1,2})*)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))

    def numbers(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^([0-9]+)", 1).cast("int"), F.regexp_extract(p, r"([0-9]+)$", 1).cast("int")
        return F.when(b < a, F.array().cast("array<int>")).otherwise(F.sequence(a, F.least(b, a + 19)))

    return F.flatten(F.transform(parts, numbers))


def seconds(stamp: Column) -> Column:
    """[h:]m:ss or plain seconds as a number; null for anything else."""
    p = F.regexp_extract(F.trim(stamp), r"^\[?(?:(\d+):)?(\d{1,2}):(\d{2})\]?$", 1)
    m = F.regexp_extract(F.trim(stamp), r"^\[?(?:\d+:)?(\d{1,2}):\d{2}\]?$", 1)
    s = F.regexp_extract(F.trim(stamp), r"^\[?(?:\d+:)?\d{1,2}:(\d{2})\]?$", 1)
    bare = F.regexp_extract(F.trim(stamp), r"^\[?(\d+)\]?$", 1)
    n = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(0))
    return F.when(m != "", n(p) * 3600 + n(m) * 60 + n(s)).when(bare != "", n(bare))


def clock(secs: Column) -> Column:
    """Seconds as m:ss, or h:mm:ss from an hour on."""
    s = F.greatest(F.lit(0), F.floor(F.coalesce(secs, F.lit(0))).cast("int"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def iso_date(text: Column) -> Column:
    """A sortable date from 2025-11-03, 3 Nov 2025, Nov 2025 or 2025 (counted as its middle); '' if unreadable."""
    s = F.lower(F.coalesce(text, F.lit("")))
    names = "(" + "|".join(MONTHS) + ")"
    month = lambda m: F.lpad(F.array_position(F.array(*[F.lit(x) for x in MONTHS]), m).cast("string"), 2, "0")
    got = lambda p, k: F.regexp_extract(s, p, k)
    iso = r"\b(20[0-9]{2})-([0-9]{2})(?:-([0-9]{2}))?"
    dmy = rf"\b([0-9]{{1,2}})\s+{names}[a-z]*\.?,?\s+(20[0-9]{{2}})\b"
    my = rf"\b{names}[a-z]*\.?\s+(?:[0-9]{{1,2}},?\s+)?(20[0-9]{{2}})\b"
    year = r"\b(20[0-9]{2})\b"
    return (
        F.when(got(iso, 1) != "", F.concat_ws("-", got(iso, 1), got(iso, 2), F.coalesce(F.nullif(got(iso, 3), F.lit("")), F.lit("01"))))
        .when(got(dmy, 1) != "", F.concat_ws("-", got(dmy, 3), month(got(dmy, 2)), F.lpad(got(dmy, 1), 2, "0")))
        .when(got(my, 1) != "", F.concat_ws("-", got(my, 2), month(got(my, 1)), F.lit("01")))
        .when(got(year, 1) != "", F.concat(got(year, 1), F.lit("-06-30")))
        .otherwise("")
    )


def recency(date: Column, today: str) -> Column:
    """2 for the last half year, 1 for the last year, 0 for older, undated and future dates."""
    d = F.datediff(F.to_date(F.lit(today)), F.to_date(date))
    return F.when(d.isNull() | (d < -2), 0).when(d <= 183, 2).when(d <= 366, 1).otherwise(0)


def topics(text: Column, most: int = 3) -> Column:
    """Topics between | and ;, blanks collapsed, the first of equal ones, at most three."""
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), "[|;]"), lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, ",", " "), r"\s+", " ")))
    kept = F.filter(raw, lambda t: t != "")
    lower = F.transform(kept, F.lower)
    return F.slice(F.filter(kept, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1), 1, most)


def item_number(text: Column) -> Column:
    """The list position that '3', '#3', 'no. 3', 'item 3' or 'number 3' names, else null."""
    n = F.regexp_extract(F.lower(text), r"^\s*(?:#|no\.?\s*|item\s*|number\s*)?([0-9]{1,3})\s*$", 1)
    return F.when((n != "") & (n.try_cast("int") >= 1), n.try_cast("int"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def clean_tags(tags: Column) -> Column:
    """At most five tags, lower case, without braces, quotes, commas and backslashes."""
    one = lambda t: F.trim(F.translate(F.lower(t), '{}",\\', ""))
    return F.filter(F.transform(F.slice(tags, 1, 5), one), lambda t: t != "")


def file_name(title: Column, item: Column, most: int = 90) -> Column:
    """A file name from a title: characters that paths can't hold become blanks; an empty one takes the item's number."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|#^\[\]]+', " "), r"\s+", " "))
    return F.concat(F.coalesce(F.nullif(F.trim(F.left(t, F.lit(most))), F.lit("")), F.concat(F.lit("item "), item.cast("string"))), F.lit(".md"))


def snippet(text: Column, words: list[str], most: int) -> Column:
    """``most`` characters around the earliest of the words, a third of them before it; the text's beginning without one."""
    low = F.lower(text)
    at = F.array_min(F.filter(F.array(*[F.locate(w.lower(), low) for w in words]), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - F.lit(most // 3))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(start > 1, "…").otherwise(""), F.substr(text, start, F.lit(most)), F.when(start + most <= F.length(text), "…").otherwise("")))


def content_words(text: Column, stop: list[str]) -> Column:
    w = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) >= 4) & ~x.isin(stop)))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? and their citations, before a capital, quote or bracket."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    marked = F.regexp_replace(flat, r"([.!?](?:\s*\[[0-9, –-]+\])*)\s+(?=[A-Z\"“'(])", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def cron_sets(expr: str) -> dict | None:
    """The minutes, hours, days, months and weekdays of a five-field schedule; None if it is malformed."""
    limits = [("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7)]
    fields = expr.split()
    if len(fields) != 5:
        return None
    out: dict = {}
    for field, (name, low, high) in zip(fields, limits):
        values: set[int] = set()
        for part in field.split(","):
            span, slash, step = part.partition("/")
            first, dash, last = span.partition("-")
            if (slash and not (step.isdigit() and int(step))) or (span != "*" and not first.isdigit()) or (dash and not last.isdigit()):
                return None
            a, b = (low, high) if span == "*" else (int(first), int(last) if dash else high if slash else int(first))
            if not low <= a <= b <= high:
                return None
            values.update(range(a, b + 1, int(step or 1)))
        out[name] = {v % 7 for v in values} if name == "weekday" else values
    return out | {"any_day": fields[2] == "*", "any_weekday": fields[4] == "*"}


def cron_matches(expr: str, at: Column, zone: str = "+06:00") -> Column:
    """Whether a schedule fires in the minute of ``at``; with day and weekday both restricted, either is enough."""
    c = cron_sets(expr)
    if c is None:
        return F.lit(False)
    t = F.from_utc_timestamp(at, zone)
    day, weekday = F.dayofmonth(t).isin(list(c["day"])), (F.dayofweek(t) - 1).isin(list(c["weekday"]))
    days = (day & weekday) if c["any_day"] or c["any_weekday"] else (day | weekday)
    return F.minute(t).isin(list(c["minute"])) & F.hour(t).isin(list(c["hour"])) & F.month(t).isin(list(c["month"])) & days


def cron_fired(expr: str, after: Column, until: Column, zone: str = "+06:00", most_minutes: int = 7 * 1440) -> Column:
    """Whether a schedule fires in a whole minute after ``after`` and up to ``until``, which lie at most ``most_minutes`` apart."""
    first = F.date_trunc("minute", after) + F.expr("interval 1 minute")
    last = F.least(F.date_trunc("minute", until), first + F.make_interval(mins=F.lit(most_minutes)))
    minutes = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 minute")))
    return F.coalesce(F.exists(minutes, lambda t: cron_matches(expr, t, zone)), F.lit(False))
