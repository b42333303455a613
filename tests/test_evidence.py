from pyspark.sql import functions as F

from quillmesh.functions import evidence as E
from quillmesh.functions import text as T
from quillmesh.operators import research as R

C = F.col


def run(spark, column, cases, schema):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + schema).select("i", column.alias("c")).orderBy("i").collect()
    return [r.c.asDict() if hasattr(r.c, "asDict") else r.c for r in rows]


def test_names_and_figures(spark):
    assert run(spark, E.names(C("t"), C("q")), [("He met Alfa Grid, and The Beta Wind on Monday.", "who is beta wind"), (None, None)], "t string, q string") == [["Alfa Grid"], []]
    cases = [("Alfa Grid paid $40M for 30% of it", "It was 40,000,000.", "")]
    assert run(spark, E.unsupported(C("t"), C("e"), C("q")), cases, "t string, e string, q string") == [["30%"]]
    assert run(spark, E.unsupported(C("t"), C("e"), C("q"), True), [("so Alfa Grid paid Gamma 5% of it", "gamma had 5 percent", "")], "t string, e string, q string") == [["Alfa Grid"]]
    money = [("It costs $5 per seat", "the price is 5 dollars", ""), ("It costs $5", "5 people", ""), ("It costs $5", "x", "is it 5?"), ("it is 3 per hour", "3/hr", ""), ("it is 3 per hour", "3 people", ""), ("$5 million", "", "")]
    assert run(spark, E.small_money(C("t"), C("e"), C("q")), money, "t string, e string, q string") == [[], ["5"], [], [], ["3"], []]


def test_spelling(spark):
    assert run(spark, E.spell_words(C("t")), [("Chip tarifs, AI and anthropic-x plus moree things",)], "t string") == [["chip", "tarifs", "anthropic-x", "plus"]]
    fixes = F.array(F.struct(F.lit("tarifs").alias("typed"), F.lit("tariffs").alias("meant")), F.struct(F.lit("chip").alias("typed"), F.lit(None).cast("string").alias("meant")))
    assert run(spark, E.respelled(C("t"), fixes), [("chip Tarifs on tarifsx",)], "t string") == ["chip tariffs on tarifsx"]


def test_quotes_and_windows(spark):
    page = "Some words **before**. The [port](https://x) was “closed” … and nobody – so far – was hurt. After."
    cases = [("The port was \"closed\"", page), ("nobody - so far...After.", page), ("never said here", page), ("port", page), (None, page)]
    assert run(spark, E.quote_stands(C("q"), C("p")), cases, "q string, p string") == [True, True, False, False, False]
    long = "a" * 5000 + " the needle stands here " + "b" * 5000
    got = run(spark, E.window_at(C("p"), C("q"), 100), [(long, "needle stands"), (long, "absent words"), (long, None)], "p string, q string")
    assert "needle stands" in got[0] and len(got[0]) == 200 and got[1] == long[:100] and got[2] == long[:100]


def test_entities(spark):
    keys = run(spark, E.entity_key(C("e")), [("owner/Alfa-Grid (beta)",), ("The Alfa Grid project",), ("the project",), (None,)], "e string")
    assert keys == ["alfagrid", "alfagrid", "theproject", ""]
    only = run(spark, E.subject_only(C("e"), F.array(F.lit("Alfa Grid"))), [("Alfa Grid GitHub repo",), ("Alfa Grid for Beta",), ("x",), (None,)], "e string")
    assert only == [True, False, True, True]


def test_periods(spark):
    q = ["what changed this year", "in the past 12 months", "this month", "since 2024-03", "after March 2023?", "since 2022 please", "whenever", None]
    assert run(spark, E.cutoff(C("q"), F.lit(None), "2026-04-25"), [(x,) for x in q], "q string") == ["2026-01-01", "2025-04-25", "2026-04-01", "2024-03-01", "2023-03-01", "2022-01-01", "", ""]
    assert run(spark, E.before_period(C("d"), C("c")), [("3 May 2023", "2024-01-01"), ("2025", "2024-01-01"), ("?", "2024-01-01"), ("2020", "")], "d string, c string") == [True, False, False, False]
    assert run(spark, E.days_between(C("a"), C("b")), [("2026-01-01", "3 Jan 2026"), ("x", "2026")], "a string, b string") == [2, None]
    assert run(spark, E.stale_note(C("d"), "2026-04-25"), [(["2025-01-03", "x"],), (["2026-04-01"],), (["?"],), ([],)], "d array<string>") == ["newest 2025-01-03", "", "undated", "undated"]
    fired = run(spark, T.cron_fired("30 8 * * *", C("a").cast("timestamp"), C("b").cast("timestamp")), [("2026-01-01 02:29:59", "2026-01-01 02:30:00"), ("2026-01-01 02:30:00", "2026-01-01 02:45:00"), ("2026-01-01 02:40:00", "2026-01-01 02:20:00")], "a string, b string")
    assert fired == [True, False, False]


def test_regions(spark):
    asked = run(spark, E.asked_countries(C("q"), F.lit("")), [("banks in Latin America",), ("indian startups",), ("what does Kenya do",), ("what is new",)], "q string")
    assert asked == [["brazil", "mexico", "argentina", "chile", "colombia", "peru"], ["india"], ["kenya"], None]
    got = run(spark, E.out_of_region(C("t"), C("c")), [("A bank in Kenya", ["india"]), ("Kenya and India", ["india"]), ("No land", ["india"]), ("Kenya", None)], "t string, c array<string>")
    assert got == [True, False, False, False]


def test_pages_and_marks(spark):
    assert run(spark, E.shown_page(C("t")), [("![x](y)\nSkip to content\nThe [a](b(c)) port\n\n\n\nend",)], "t string") == ["The a port\n\nend"]
    cases = [("a_b.pdf", "A real title", ""), ("report.pdf", "Untitled", "x\nThe State of Grid Storage\nmore"), ("the_long_file_name.pdf", "doc.docx", ""), ("x.pdf", None, "copyright 2020 by us all")]
    assert run(spark, E.upload_title(C("f"), C("t"), C("x")), cases, "f string, t string, x string") == ["A real title", "The State of Grid Storage", "the long file name", "x"]
    assert run(spark, E.without_marks(C("t")), [("## Head\n**bold** and *it* and _em_ but 2 * 3 * 4",)], "t string") == ["Head\nbold and it and em but 2 * 3 * 4"]
    assert run(spark, E.from_html(C("t")), [("<b>a</b> &lt;x&gt; &amp;lt;<br/>c",)], "t string") == ["a <x> &lt;\nc"]


def test_answers(spark):
    a = "One thing is so [1]. Another was seen. A third [2]."
    assert run(spark, E.replaced_sentence(C("a"), C("o"), C("n")), [(a, "Another was seen.", "It was [2]."), (a, "Another was seen.", None), (a, "absent", "x")], "a string, o string, n string") == ["One thing is so [1]. It was [2]. A third [2].", "One thing is so [1]. A third [2].", a]
    fixes = [("Another was seen.", None, False, None), ("A third [2].", "A third, checked [2].", True, None)]
    got = run(spark, E.fixed_answer(C("a"), C("f")), [(a, fixes)], "a string, f array<struct<s:string,fix:string,fix_ok:boolean,quote:string>>")[0]
    assert (got["fixed"], got["quoted"], got["dropped"]) == (1, 0, 1) and got["answer"] == "One thing is so [1]. A third, checked [2]. (1 sentence removed: I could not confirm it against the sources.)"
    assert run(spark, E.salvaged(C("a"), C("u"), C("p")), [(a, ["Another was seen."], False), (a, ["Another was seen."], True), ("One. Two.", ["One."], False)], "a string, u array<string>, p boolean") == ["One thing is so [1]. A third [2].", "", ""]
    nothing = [("Not in feed.",), ("The items do not cover it. They tell of ports [1].",), ("Ports grew [1]. Ships too [2]. Nothing on trains.",), (None,)]
    assert run(spark, E.answers_nothing(C("a")), nothing, "a string") == [True, True, False, False]
    assert run(spark, E.thin_note(C("n")), [(1,), (2,), (3,)], "n int") == ["Your feed has only 1 item on this:\n", "Your feed has only 2 items on this:\n", ""]
    assert run(spark, E.overclaims(C("h"), F.lit(""), C("p")), [("Confirmed use", ["a pilot", "vendor word"]), ("Confirmed use", ["a pilot", "seen"]), ("Use", ["a pilot", "a pilot"]), ("Confirmed", ["a pilot"])], "h string, p array<string>") == [True, False, False, False]
    assert run(spark, E.softened(C("h")), [("Confirms it, confirmed and Verified, proven",)], "h string") == ["Reports it, reported and Reported, reported"]
    assert run(spark, E.hedged(C("h"), C("t")), [("Confirmed users: Ten", True), ("Confirmed ten", False), ("It is unclear", True), (None, None)], "h string, t boolean") == ["Evidence is thin: ten", "Reported ten", "It is unclear", ""]
    assert run(spark, E.spread_headline(C("h"), C("q"), C("p")), [("Half use it", "how many use it", ["40%", "60 %"]), ("Half use it", "who uses it", ["40%", "60%"]), ("Half", "how many", ["40%", "41%"])], "h string, q string, p array<string>") == ["No single measured number: half use it", "Half use it", "Half"]


def test_origins_and_quotes(spark):
    claims = spark.createDataFrame([("t", 1, "It cut 1,200 jobs in 2024, some 7 of them abroad"), ("t", 2, "no figure"), ("u", 3, "1200")], "topic string, claim int, text string")
    pages = spark.createDataFrame([(1, "2025-03-01", "then 1,200 jobs"), (2, "2024-05-01", "of 1200 people"), (3, None, "1200"), (4, "2023", "11200 or 1200.5"), (5, "2025-01-01", "x 1200 y")], "page int, date string, text string").withColumn("topic", F.lit("t"))
    assert sorted((r.claim, r.page, r.excerpt) for r in R.origin_pages(claims, pages).collect()) == [(1, 2, "of 1200 people"), (1, 5, "x 1200 y")]
    ents = spark.createDataFrame([("t", "A", "built with Rust", 1, 0), ("t", "B", "written in Go", 0, 2), ("t", "C", "using X", 2, 2), ("t", "D", "unknown", 9, 9), ("t", "E", "using it", 0, 1)], "topic string, name string, why string, claims int, mentions int")
    assert [r.name for r in R.ruled_out_lines(ents).orderBy("name").collect()] == ["A", "C"]
    good = "Alfa said that the port was closed for days"
    other = "Nobody could say when the port would be opened"
    items = spark.createDataFrame([(1, 1, "Alfa", [1, 2]), (1, 2, "Beta", [1, 2]), (1, 3, "Gamma", [1]), (1, 4, "Delta", [1])], "answer int, pos int, name string, sources array<int>")
    facts = spark.createDataFrame([(1, 1, "Alfa", good, True), (1, 2, "Nobody", other, True), (1, 1, "Alfa", "short", True)], "answer int, n int, entity string, quote string, fits boolean")
    assert sorted((r.name, r.n) for r in R.quotes_to_check(items, facts).collect()) == [("Alfa", 1), ("Beta", 2)]
    f = spark.createDataFrame([(1, "the port was closed"), (1, "the port was open")], "page int, quote string")
    assert [r.quote for r in R.found_on_page(f, spark.createDataFrame([(1, "So **the port** was closed.")], "page int, text string")).collect()] == ["the port was closed"]


def test_replies_and_fields(spark):
    cases = [('{"summary": "s", "round": "A", "n": 3}',), ('{"summary": "s"}',), ("broken",), (None,)]
    assert run(spark, R.extra_fields(C("j")), cases, "j string") == ['{"round":"A","n":"3"}', None, None, None]
    assert R.widened({"round": "string", "summary": "int"}).endswith("`tags` array<string>, `round` string")
    df = spark.createDataFrame([(1, 1, "bad"), (1, 2, "fine"), (2, 1, "bad"), (3, 1, "bad"), (3, 2, "bad")], "id int, attempt int, summary string")
    assert sorted(tuple(r) for r in R.judged_replies(df, C("summary") == "fine").collect()) == [(1, "valid", "fine"), (2, "retry", None), (3, "failed", "TRIAGE_FAILED")]
    runs = spark.createDataFrame([(1, " Seed Rounds "), (2, None)], "id int, query_text string")
    skills = spark.createDataFrame([("seed rounds", "b", "x"), ("Seed rounds", "a", "y")], "query_text string, name string, fields string")
    assert sorted((r.id, r.skill) for r in R.resolved_skills(runs, skills).collect()) == [(1, "a"), (2, None)]


def test_history_and_replacements(spark):
    h = spark.createDataFrame([(1, "s", '{"type":"human","content":"hi\\n[live data, fetched just now: x]"}'), (2, "s", '{"type":"tool","content":"r"}'), (3, "s", '{"type":"ai","content":"a","tool_calls":[{"x":1}]}'), (4, "s", '{"type":"ai","content":"old","tool_calls":[]}')], "id int, session_id string, message string")
    kept = {r.id: r.message for r in R.tidied(h).collect()}
    assert set(kept) == {1, 4} and '"content":"hi"' in kept[1]
    fixed = {r.id: r.message for r in R.corrected(h, spark.createDataFrame([("s", "new")], "session_id string, output string")).collect()}
    assert '"content":"new"' in fixed[4] and fixed[2] == '{"type":"tool","content":"r"}'
    docs = spark.createDataFrame([(1, "u"), (2, "v"), (3, "u")], "id int, canonical_url string")
    items = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id int, raw_doc_id int")
    d, i = R.replaced_pages(docs, items, spark.createDataFrame([("u", "replace"), ("v", "")], "canonical_url string, flag string"))
    assert [r.id for r in d.collect()] == [2] and [r.id for r in i.collect()] == [11]
    assert [r.feed_item_id for r in R.released(spark.createDataFrame([(1,), (2,)], "feed_item_id int"), spark.createDataFrame([(2,)], "feed_item_id int")).collect()] == [1]
    assert [tuple(r) for r in R.twin_of(spark.createDataFrame([(9, 4, 0.9), (9, 3, 0.9), (9, 1, 0.8)], "id int, twin int, sim double")).collect()] == [(9, 3, 0.9)]
    fresh = spark.createDataFrame([("a", 1)], "canonical string, rec_id int")
    batch = spark.createDataFrame([("a", 1, True, None), ("b", 2, True, False), ("b", 3, None, True), ("c", 4, False, None)], "canonical string, rec_id int, slides boolean, transcribe boolean")
    assert sorted(tuple(r) for r in R.wanted_again(fresh, batch).collect()) == [("a", 1, ""), ("b", 2, "replace")]


def test_named_finds(spark):
    page = "Alfa Port was built with the Grid Storage Kit, they said. GSK is free."
    cases = [("Alfa Port", "Alfa Port was built with the Grid Storage Kit", page, "Grid Storage Kit"), ("Alfa Port", "never said at all", page, "Grid Storage Kit"), ("the Grid Storage Kit", "GSK is free.", page, "Grid Storage Kit"), ("Beta", "GSK is free.", page, "Grid Storage Kit"), ("Alfa Port", "GSK is free.", page, "Other Tool"), ("Alfa Port", "Alfa Port uses GSK", "So Alfa Port uses GSK.", "Grid Storage Kit"), (None, "GSK is free.", page, "x y z")]
    got = run(spark, E.named_fit(C("n"), C("q"), C("t"), C("s")), cases, "n string, q string, t string, s string")
    assert got == [None, "no such quote", "the subject itself", "not named", "subject missing", None, "the subject itself"]
