from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seismark.llm.bktree import BKTree, damerau, levenshtein
from seismark.llm.canonical import PLACE_ABBREVIATIONS, holds_name, map_values
from seismark.llm.placenames import map_label_places

WORDS = st.text("abcé ", max_size=9)


def slow_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, WORDS)
def test_distances(a, b, c):
    assert levenshtein(a, b) == slow_levenshtein(a, b) == levenshtein(b, a)
    assert damerau(a, b) <= levenshtein(a, b) <= 2 * damerau(a, b)
    assert damerau(a, c) <= damerau(a, b) + damerau(b, c)


@settings(max_examples=100, deadline=None)
@given(st.lists(WORDS, max_size=40), WORDS, st.integers(0, 4))
def test_tree_returns_every_entry_within_the_limit(entries, value, limit):
    tree = BKTree(entries)
    assert sorted(tree.within(value, limit)) == sorted((slow_levenshtein(value, e), e) for e in set(entries) if slow_levenshtein(value, e) <= limit)
    assert sorted(tree.nearest(value, limit)) == sorted((damerau(value, e), e) for e in set(entries) if damerau(value, e) <= limit)


def reference(spark):
    return spark.createDataFrame([(1, "Port Eskiné", "Oldport"), (2, "Lake Zelanpolsjö", None), (3, "Calinholt", None), (4, "Calinholt", None), (5, None, " ")], "id bigint, name string, other string")


TYPED = ["Pt. Eskine", "ESKINÉ, PORT", "Port Eskiné (North)", "city of Calinholt", "Caliholt", "Claniholt", "Clanihlot", "Nowhere Town", "n/a", "?", "", None, "Port Eskiné / Land", "x" * 50_000, "oldport", "CALINHOLT."]


def test_same_answers_broadcast_and_sharded(spark):
    df = spark.createDataFrame([(i, v, "kept") for i, v in enumerate([*TYPED, TYPED[0]])], "k bigint, typed string, typed_matches string")
    answers = []
    for bound in (1000, 2):
        out = map_values(df, ["typed"], reference(spark), "id", ["name", "other"], abbreviations=PLACE_ABBREVIATIONS, broadcast_entries=bound)
        assert out.columns == ["k", "typed", "typed_matches"]
        answers.append({r["k"]: r["typed_matches"] and [m["ref_id"] for m in r["typed_matches"]] for r in out.collect()})
    assert answers[0] == answers[1]
    want = [[1], [1], [1], [3, 4], [3, 4], [3, 4], [], [], None, None, None, None, [1], [], [1], [3, 4], [1]]
    assert [answers[0][i] if answers[0][i] is None else list(answers[0][i]) for i in range(len(want))] == want


def test_long_values_do_not_depend_on_shards(spark):
    listed = spark.createDataFrame([(1, "Paris"), (2, "A city with a name so long that nobody has ever written it on an envelope"), (3, "Port North Saint Lake"), (4, "Oslo")], "id bigint, name string")
    typed = ["Paris (" + "x" * 140 + ")", "Paris " * 400, "Pt. Nth. St. Lk.", "n s p l m w e s n", "Oslo / " + "y" * 5000]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(typed)], "k bigint, typed string")
    answers = []
    for bound in (1000, 1):
        out = map_values(df, ["typed"], listed, "id", ["name"], abbreviations=PLACE_ABBREVIATIONS, broadcast_entries=bound)
        answers.append({r["k"]: [m["ref_id"] for m in r["typed_matches"]] for r in out.collect()})
    assert answers[0] == answers[1] == {0: [1], 1: [], 2: [3], 3: [], 4: [4]}


def test_late_pieces_of_long_descriptions(spark):
    countries = spark.createDataFrame([(1, "Aland", None, None)], "country_id bigint, country string, official_name string, code3 string")
    places = spark.createDataFrame([(10, "Wenistvik", None, 1, 5)], "place_id bigint, city string, alt_name string, country_id bigint, population bigint")
    loc = ", ".join(["hills beyond the river"] * 100 + ["Wenistvik", "Aland"])
    labels = spark.createDataFrame([(1, None, None, loc), (1, None, None, loc), (2, "tbd", None, "Aland")], "label_id bigint, city string, country string, loc string")
    got = [(r["label_id"], r["city_ref"]) for r in map_label_places(labels, places, countries).collect()]
    assert got.count((1, 10)) == 2 and got.count((2, None)) == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([("Calinholt",)], "typed string")
    assert map_values(df, ["typed"], reference(spark).limit(0), "id", ["name"]).first()["typed_matches"] == []
    assert map_values(df.limit(0), ["typed"], reference(spark), "id", ["name"]).count() == 0


def test_words_for_not_known(spark):
    df = spark.createDataFrame([(x,) for x in ("TBD", " - ", "N/A", "Various", "not specified", "Oslo", "?", None)], "v string")
    assert [r[0] for r in df.select(holds_name(F.col("v"))).collect()] == [False] * 5 + [True, False, False]


def test_country_decides_between_namesakes(spark):
    countries = spark.createDataFrame([(1, "Aland", "Republic of Aland", "ALA"), (2, "Berland", "Kingdom of Berland", "BER")], "country_id bigint, country string, official_name string, code3 string")
    places = spark.createDataFrame([(10, "Wenistvik", None, "Eastshire", 1, 5), (11, "Wenistvik", None, "Westshire", 2, 50), (12, "Selbo", None, "Eastshire", 1, 7)], "place_id bigint, city string, alt_name string, state string, country_id bigint, population bigint")
    rows = [("Wenistvik", "Kgd. of Berland", None), ("wenistvik", "Aland (ALA)", None), ("Wenistvik", None, "near Wenistvik, Aland"), ("Wenistvik", "unknown", None), ("Selbo", "Berland", None), (None, "ber", "Selbo - Aland"), ("-", None, "off the coast of Aland"), ("Elsewhere", "Nowhereland", None), (None, None, None), ("TBD", "the aland.", "Aland: SELBO")]
    labels = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "label_id bigint, city string, country string, loc string")
    got = {r["label_id"]: (r["country_ref"], r["city_ref"]) for r in map_label_places(labels, places, countries).collect()}
    assert [got[i] for i in range(len(rows))] == [(2, 11), (1, 10), (None, 10), (None, 11), (2, 12), (2, 12), (None, None), (0, 0), (None, None), (1, 12)]
