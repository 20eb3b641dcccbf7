import random

import duckdb
import pytest

from ratingscope.llm import decontaminate as dc

ITEMS = [
    (1, "The farmer near Lake Geneva sold 35 apples for 12 kg of rice, then Anna Smith took 35 more apples home."),
    (2, "Water boils when its vapour pressure equals the pressure of the surrounding air at that height."),
    (3, "two plus two"),
    (4, None),
    (5, ""),
]
FILL = "some words that stand before and after and belong to nothing at all in particular"
DOCS = [
    (1, f"{FILL}. {ITEMS[0][1]} {FILL}"),
    (2, f"{FILL}. The farmer near Paris sold 7 apples for 99 kg of rice, then Bob took 7 more apples home. {FILL}"),  # re-parameterised
    (3, f"{FILL}. The farmer near Paris sold 7 apples for 99 kg of rice, then Bob took 8 more apples home. {FILL}"),  # 35 is 7, then 8
    (4, f"water BOILS when its vapour pressure equals the pressure of the surrounding air at that height {FILL}"),
    (5, f"{FILL} when its vapour pressure equals {FILL}"),
    (6, "so two plus two"),
    (7, FILL),
    (8, None),
    (9, ""),
    (10, "EDTH!! 12 12 12 12 12 12 12 12 12 12 12"),
]
WANT = {(1, 1), (2, 1), (4, 2), (6, 3)}


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in DOCS + DOCS[:1]], "doc_id long, text string, matched int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_leaks(tables):
    docs, items = tables
    got = dc.find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(WANT)
    assert dc.find_leaks(docs.limit(0), items).count() == 0 and dc.find_leaks(docs, items.limit(0)).count() == 0


def test_same_by_shuffle_join(tables, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(*tables).collect()} == WANT


def test_decontaminate_keeps_the_rest(tables):
    docs, items = tables
    left = dc.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 7, 8, 9, 10]


def test_against_sql_with_edits(spark):
    r = random.Random(4)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ba", "do", "fi", "gu")] + ["of", "the"]
    word = lambda: r.choice(vocab) if r.random() < 0.85 else r.choice(["12", "3.5 kg", "Anna", "Bob Ray", "7%", "100"])
    items = [(k, " ".join(word() for _ in range(r.randint(6, 25))) + ".") for k in range(30)]
    docs = []
    for k in range(300):
        words = [word() for _ in range(r.randint(0, 60))]
        if r.random() < 0.6:
            own = r.choice(items)[1].split()
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = word()
            words[len(words) // 2 : len(words) // 2] = own
        docs.append((k, " ".join(words)))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    con.register("benchmark", i.toPandas())
    want = sorted(con.sql(dc.leaks_sql()).fetchall())
    got = sorted(tuple(x) for x in dc.find_leaks(d, i).drop("_key").collect())
    assert len(want) > 50 and got == want


def test_edits_quotes_and_slot_heavy_items(spark):
    text = "The farmer near Lake Geneva sold 35 apples for 12 kg of rice and then Anna Smith took 40 more of those apples home to her old mother"
    words = text.split()
    heavy = "What is 12 + 7 - 5 * 3 when 4 and 9?"
    items = spark.createDataFrame([(1, text), (2, heavy)], "item_id long, text string")
    docs = [
        (1, f"{FILL}. " + " ".join(words[:12] + ["indeed"] + words[12:])),  # a word more near the middle
        (2, f"{FILL}. " + " ".join(words[:12] + words[13:])),  # one less
        (3, f"{FILL}. " + " ".join(words[:17]) + " nothing 7 times and no 8 of 9 or 35 is 4 here"),  # two thirds, then another text
        (4, f"{FILL}. {text.replace('35', '7').replace('40', '7').replace('12', '9')} {FILL}. {text}"),  # an imitation before it
        (5, f"{FILL} {heavy}"),
        (6, f"{FILL} {heavy.replace('12', '13').replace('4', '6')}"),
        (7, FILL),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(d, items).collect()}
    assert got >= {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)} and not got & {(7, 1), (7, 2)}


def test_very_long_runs_of_slots(spark):
    """java.util.regex must not recurse on them."""
    long = [(1, "a " + "Anna " * 200_000), (2, "1." * 200_000 + "1"), (3, "x" * 200_000), (4, f"a {'B' * 200_000} {ITEMS[1][1]}"), (None, ITEMS[1][1])]
    got = dc.find_leaks(spark.createDataFrame(long, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 2), (None, 2)}
