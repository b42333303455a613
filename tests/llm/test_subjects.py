from quillmesh.llm import subjects as s

WORDS = {"sport": ["penalty kick", "goalkeeper", "medal table"], "law": ["burden of proof", "plaintiff", "witness statement"], "energy": ["wind lease", "heat pump", "peak load"]}


def corpus(n=400):
    docs, labels, truth = [], [], {}
    for i in range(n):
        a, b = list(WORDS)[i % 3], list(WORDS)[(i + 1) % 3]
        two = i % 5 == 0
        lines = []
        for k in range(10):
            subject = b if (two and k < 4) or (not two and k == 0 and i % 2) else a
            lines.append(f"The {WORDS[subject][(i + k) % 3]} was discussed by Person{i} for a while in the year.")
        lines += ["Nobody at the office would comment on it."] * 2
        docs.append((i, (" " if i % 7 else "\n").join(lines) if i % 11 else " ".join(lines).upper()))
        truth[i] = {a, b} if two else {a}
        if i % 4 == 0:
            labels += [(i, x if i % 3 else f" {x.title()} ") for x in truth[i]]
    labels += [(1, "unknown"), (2, None), (None, "sport"), (8, "law")]
    return docs, labels, truth


def test_subjects(spark):
    docs, labels, truth = corpus()
    extra = [(1000, None), (1001, ""), (1002, "qwx zzt plm"), (1003, "Nobody would comment."), docs[0], (None, "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string")
    areas = spark.createDataFrame([(x,) for x in WORDS], "subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    found = s.label_documents(d, areas, lab)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i) == t for i, t in truth.items())
    assert right >= 0.97 * len(truth) and not set(got) - set(truth)
    c = {r.subject: r.documents for r in s.composition(found, d).collect()}
    assert c[""] == 4 + sum(i not in got for i in truth)
    assert s.label_documents(d.limit(0), areas, lab).count() == 0
    assert s.label_documents(d, areas, lab.limit(0)).count() == 0


def test_terms_spread_over_partitions_count(spark):
    docs, labels, _ = corpus(120)
    # three documents in different partitions share a term with sport; no labelled document has it
    rare = [(2000 + i, "The penalty kick and the zorbing were discussed for a while in the year.") for i in range(3)]
    asked = (3000, "The zorbing was discussed for a while in the year.")
    rows = docs + rare + [asked]
    areas = spark.createDataFrame([(x,) for x in WORDS], "subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    schema = "doc_id long, text string"
    results = []
    for df in (spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame(rows, schema).repartitionByRange(len(rows), "doc_id")):
        results.append(sorted(tuple(r) for r in s.label_documents(df, areas, lab).collect()))
    assert results[0] == results[1] and (3000, "sport") in results[0]
    flushed = s.label_documents(spark.createDataFrame(rows, schema).coalesce(1), areas, lab, flush=5)
    assert sorted(tuple(r) for r in flushed.collect()) == results[0]


def test_any_number_of_partitions_gives_the_same(spark):
    docs, labels, _ = corpus(300)
    areas = spark.createDataFrame([(x,) for x in WORDS], "subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    results = [sorted(tuple(r) for r in s.label_documents(d.repartition(n), areas, lab).collect()) for n in (1, 16, 64)]
    assert results[0] == results[1] == results[2]


def test_plain():
    assert s.plain("cafÃ© &amp; b­ar") == "café & bar"


def rows(*texts):
    return s.matrix(list(texts), s.Tokens())


def test_matrix():
    en, loud, none, empty = rows("The spot market of Tamar is open. The spot market closed again, they said there.", "THE SPOT MARKET IS OPEN TODAY AND LOUD", "123 456", "")
    assert en[0] == loud[0] == s.CODES.index("en") and none[0] == empty[0] == -1
    # both have spot, market, the pair of them, and open
    assert len(set(en[1]) & set(loud[1])) == 4
    assert len(en[3]) == 2 and en[4] == 2 and len(en[2]) == en[3].sum() and len(set(en[1])) == len(en[1])
    assert len(none[1]) == len(empty[1]) == 0


def test_nouns_of_languages_that_write_them_with_a_capital():
    de, low, en = rows("Die Wärmepumpe ist auf dem Dach und nicht im Keller.", "die wärmepumpe ist auf dem dach und nicht im keller.", "The Heat of the day was not for us.")
    assert set(de[1]) <= set(low[1]) and len(de[1]) >= 3
    assert len(set(en[1]) & set(rows("The heat of the day was not for us.")[0][1])) == len(en[1])


def test_sentences_are_counted_once():
    import numpy as np
    import pandas as pd

    found = rows("The spot market and the market of the day. It was in the court of law, the court again! Supermarkets of the world are open to all of us.")
    pdf = pd.DataFrame({"code": [r[0] for r in found], "terms": [r[1].view(np.int64).tobytes() for r in found], "places": [r[2].astype(np.int32).tobytes() for r in found], "sizes": [r[3].astype(np.int32).tobytes() for r in found], "sentences": [r[4] for r in found]})
    market, court = (int(rows(f"the {w} is")[0][1].view(np.int64)[0]) for w in ("market", "court"))
    keys, h = s._sorted(np.array([market, court]), np.array([[1.0, 0, 0], [0, 1.0, 0]]))
    block = s.Block(pdf)
    assert block.about(*block.loads(keys, h)).tolist() == [[1, 1]]
    assert [(int(d), int(j)) for d, j in zip(*s.subjects_of(block, keys, h))] == [(0, 0), (0, 1)]


def test_long_stretches_are_read_in_pieces():
    one = rows("the market was open in the day and then it was shut for a while " * 40)[0]
    assert len(one[3]) > 20 and one[4] > 20
