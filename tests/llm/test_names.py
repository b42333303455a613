import json

from quillmesh.llm import names as n

KINDS = n.Kinds({"energy", "networks", "partners", "growth", "fund", "data", "protection", "office", "commission", "solutions"}, {("data", "protection"), ("growth", "fund")})


def test_distance_is_a_metric():
    words = ["bravo", "rbavo", "brav", "ravob", "tavor", "bravos", "", "b"]
    d = {(a, b): n.damerau(a, b, 99) for a in words for b in words}
    assert d["bravo", "rbavo"] == 1 and d["bravo", "brav"] == 1
    assert all(d[a, c] <= d[a, b] + d[b, c] and d[a, b] == d[b, a] for a in words for b in words for c in words)
    assert n.distance("alpha beta", "beta alpah", 2) == 1


def test_forms():
    same = ["Norvak Tiluse Energy", "NORVAK TILUSE ENERGY, Inc.", "Energy Norvak Tiluse ", "NorvakTiluse Engy", "The Norvak-Tiluse Energy GmbH", "Tiluse & Norvak Energy B.V."]
    assert len({n.form(x, KINDS) for x in same}) == 1
    assert n.form("Data Protection Office of Norvak Tiluse", KINDS) == n.form("DP Off. Norvak Tiluse", KINDS)
    assert n.form("Brolik, Elizabeth", KINDS) == n.form("Dr. Beth Brolik", KINDS)
    assert n.form("E. A. Brolik", KINDS)[0] == "p"


def test_linking(spark):
    groups = [
        ["Norvak Tiluse Energy", "Novrak Tiluse Energy", "Norvak T. Energy", "Tiluse Energy", "Norvak Tiluse", "Norvák Tiluse Energy Ltd"],
        ["Norvak Tiluse Networks"],
        ["Sobrina Keldo Partners", "SOBRINA KELDO PARTNERS", "Keldo & Sobrina Partners LLC"],
        ["Margaret Dovalinu", "Dovalinu, Margaret", "Peggy Dovalinu", "M. Dovalinu", "Margaret Dovalniu"],
        ["Robert Dovalinu"],
        ["Undovalo Trebik Growth Fund", "Growth Fund Undovalo Trebik", "Undovalo Growth Fund"],
    ]
    import random

    rnd = random.Random(2)
    made = lambda: "".join(rnd.choice("bdgkmpvz") + rnd.choice("aeiou") for _ in range(3)).title()
    filler = [f"{made()} {made()} {k}" for _ in range(40) for k in ("Energy", "Networks", "Partners", "Growth Fund", "Solutions")]
    rows = [json.dumps({"company": x, "investors": ["", "n/a", x]}) for g in groups for x in g] + [json.dumps({"body": x}) for x in filler] + [None, "", "{broken", json.dumps({"company": "undisclosed", "investors": None})]
    items = spark.createDataFrame([(r,) for r in rows + rows[:3]], "structured string")
    found = {}
    for r in n.same_pairs(n.link_names(n.names_in(items))).collect():
        assert r.name_a < r.name_b
        found.setdefault(r.name_a, set()).add(r.name_b)
        found.setdefault(r.name_b, set()).add(r.name_a)
    bare = "Norvak Tiluse"  # may be either of two organisations, so it is linked to neither
    for g in groups:
        whole = set(g) - {bare}
        for x in whole:
            assert found.get(x, set()) == whole - {x}, x
    assert bare not in found
    assert n.same_pairs(n.link_names(n.names_in(items.limit(0)))).count() == 0


def test_radius_join_is_exact(spark):
    import itertools
    import random

    rnd = random.Random(4)
    cores = list({"".join(rnd.choice("abno") for _ in range(6)) + " " + "".join(rnd.choice("kelu") for _ in range(5)) for _ in range(150)})
    df = spark.createDataFrame([(i, "s", c) for i, c in enumerate(cores)], "form long, space string, core string")
    got = {(r.a, r.b) for r in n.radius_join(df, 2, cell=30).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(cores)), 2) if n.distance(cores[i], cores[j], 2) <= 2}


def test_people_meet_under_every_given_name(spark):
    groups = [["Rick Dovalinu", "Richard Dovalinu", "Richard Dovalniu"], ["Katie Sobrinak", "Katherine Sobrinak", "Kate Sobrinka"], ["Teddy Vumokir", "Theodore Vumokir", "Ted Vumokir", "T. Vumokir"], ["Peggy Vumokir"]]
    groups += [["Frederick Lomatik"], ["Richard Lomatik"], ["Rick Lomatik"]]  # may be either, so it is linked to neither
    names = spark.createDataFrame([(x,) for g in groups for x in g], "name string")
    got = {(r.name_a, r.name_b) for r in n.same_pairs(n.link_names(names)).collect()}
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_pairings_of_any_number_of_words():
    import itertools
    import random

    rnd = random.Random(9)
    for _ in range(60):
        m = [[rnd.randrange(9) for _ in range(5)] for _ in range(5)]
        assert n.assignment(m) == min(sum(m[i][p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
    assert n.distance("beta alfa gamma delta", "alfa beta gamma delta", 2) == 0
    assert n.distance("alder brook cedar dorne energy", "brook cedar dorne energy zlder", 2) == 1
    assert n.distance("aa bb cc", "xx yy zz", 2) == 3 and n.distance("aa bb", "aa bb cc", 2) == 3


def test_large_cells_are_compared_block_by_block(spark):
    import itertools

    cores = [f"{a}{b}{c}lu" for a in "bdgk" for b in "aeio" for c in "mnpr"]
    df = spark.createDataFrame([(i, "s", c, i % 3 == 0) for i, c in enumerate(cores)], "form long, space string, core string, asked boolean")
    got = {(r.a, r.b) for r in n.radius_join(df, 1, cell=1000, block=10).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(cores)), 2) if (i % 3 == 0 or j % 3 == 0) and n.damerau(cores[i], cores[j], 1) <= 1}


def test_names_without_a_known_kind(spark):
    groups = [["Norvak Tilusema", "Novrak Tilusema", "NORVAK TILUSEMA"], ["Sobrina Keldovat", "Keldovat Sobrina"], ["Ubrika Vortemi"]]
    names = spark.createDataFrame([(x,) for g in groups for x in g], "name string")
    got = {(r.name_a, r.name_b) for r in n.same_pairs(n.link_names(names)).collect()}
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_short_kind_words_are_read_with_what_stands_beside_them():
    kinds = n.Kinds({"growth", "group", "fund", "solutions"}, {("growth", "fund")})
    assert kinds.read("gr", ("fund",)) == ("growth",) and kinds.read("gr") == ("group",)
