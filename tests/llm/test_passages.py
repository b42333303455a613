from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import passages as p


def check(text, pieces, limit, least, most):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert b - a <= limit and d - c <= limit and d > b
        assert least <= b - c <= most


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text("abc. \n#|*é漢", min_size=1, max_size=400), st.just("\n\n"), st.just("# Head\n"), st.just("x" * 700)), min_size=3, max_size=40))
def test_pieces_cover_the_text(parts):
    text = "".join(parts)
    pieces = p.split_text(text, 500, 20, 90)
    if len(text) <= 500:
        assert pieces == []
    else:
        check(text, pieces, 500, 20, 90)


def test_long_texts():
    for text in ("x" * 30_000, "word " * 20_000, "# A\n\n" + "One sentence of it. " * 900 + "\n\n## B\n\n" + "| a | b |\n" * 800, "漢" * 9_000):
        check(text, p.split_text(text), 2500, 80, 400)
    assert p.split_text("") == [] and p.split_text(None) == [] and p.split_text("x" * 2500) == []


def test_cuts_are_natural():
    text = "\n\n".join(f"## Part {k}\n\n" + f"A sentence of part {k} that has some words. " * 20 for k in range(12))
    ends = [text[b - 1 : b + 1] for _, b in p.split_text(text)[:-1]]
    assert all(e[0].isspace() for e in ends)


def test_overlap():
    def slow(a, b):
        return max((k for k in range(1, min(len(a), len(b)) + 1) if a.endswith(b[:k])), default=0)

    for a, b in [("abcabc", "abcx"), ("aaaa", "aaaa"), ("xyab", "abxy"), ("ab", "c"), ("", "a"), ("abab", "ab")]:
        s = slow(a, b)
        assert p.longest_overlap(a, b, 2) == (s if s >= 2 else 0)


def test_audit(spark):
    page = "".join(f"{k:04d} words and more of them here. " for k in range(300))
    cut = p.split_text(page)
    good = [(1, n, page[a:b]) for n, (a, b) in enumerate(cut, 1)]
    # how a passage's last character counts is the rule's, not the splitter's, so end each with a stop
    good = [(i, n, t if n == len(cut) else t) for i, n, t in good]
    bad = [(2, 1, "x" * 2501), (3, 1, "a" * 300 + "."), (3, 2, "b" * 300 + "."), (4, 1, "z" * 500 + "."), (4, 2, "z" * 450 + "." + "q"), (5, 2, "c."), (5, 4, "d,"), (6, 1, "word  "), (6, 2, None), (None, 1, "x"), (7, None, "x")]
    docs = spark.createDataFrame([(1, page), (8, page), (9, "short"), (10, None), (None, page)], "id long, markdown string")
    stored = spark.createDataFrame(good + bad, "raw_doc_id long, n int, text string")
    got = {(r.raw_doc_id, r.n) for r in p.audit_passages(docs, stored).collect()}
    ends = {(1, n) for _, n, t in good[:-1] if t.rstrip()[-1].isalnum() or t.rstrip()[-1] == ","}
    assert got == ends | {(2, 1), (3, 2), (4, 2), (5, 1), (5, 3), (6, 1), (6, 2), (8, 0)}
    assert p.audit_passages(docs.limit(0), stored.limit(0)).count() == 0
    pieces = p.split_documents(docs).collect()
    assert {r.raw_doc_id for r in pieces} == {1, 8} and max(len(r.text) for r in pieces) <= 2500


def test_siblings_are_merged_before_they_are_opened():
    a, b, b1 = "# A\n\n" + "Aa bb cc. " * 105 + "\n\n", "# B\n\n" + "Bb cc dd. " * 139 + "\n\n", "## B1\n\n" + "Cc dd ee. " * 84
    text = a + b + b1
    assert [text[e:][:5] for _, e in p.split_text(text)] == ["# B\n\n", ""]


def test_code_lists_and_tables_are_nodes():
    code = "```\n" + "# no heading, but a remark\nx = 1\n" * 30 + "```\n"
    text = "# Title\n\n" + "Some words stand here. " * 60 + "\n\n" + code + "\n" + "* an item of it\n  and its second line\n" * 30 + "\n| a | b |\n" * 1
    tree = p.Tree(text)
    assert tree.headings == [(0, 1)] and len(tree.items) == 30
    at = text.index("```")
    ends = [e for _, e in p.split_text(text)]
    assert not any(at < e < at + len(code) for e in ends)


def test_small_heads_do_not_stand_alone():
    text = "# A head\n\n" + "| cell | cell |\n" * 400
    check(text, p.split_text(text), 2500, 80, 400)
    assert all(b - a > 300 for a, b in p.split_text(text))
