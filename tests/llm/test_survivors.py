import random

from pyspark.sql import functions as F

from seismark.llm.survivors import Field, surviving_records, survivors

SCHEMA = "g bigint, id bigint, trust int, at timestamp, city string, impact int, field string"


def fields():
    return [Field("city", F.col("city").isNotNull(), F.lower("city")), Field("impact", F.col("impact").between(0, 5), F.col("impact"))]


def table(spark, rows):
    return spark.createDataFrame(rows, "g bigint, id bigint, trust int, at string, city string, impact int, field string").withColumn("at", F.to_timestamp("at"))


ROWS = [
    (1, 1, 9, "2020-01-01", None, 7, "x"), (1, 2, 5, "2020-01-02", "Oslo", 2, "x"), (1, 3, 5, "2020-01-03", "oslo", 3, "x"), (1, 4, 5, "2020-01-03", "Bergen", 4, "x"),
    (2, 5, None, None, "Rome", 1, "x"), (2, 6, 1, "2019-01-01", "Pisa", None, "x"), (None, 7, 1, "2019-01-01", "Pisa", 1, "x"), (3, 8, 1, "2019-01-01", None, None, "x"),
]


def test_strict_precedence_with_ties_nulls_and_repeats(spark):
    out = survivors(table(spark, ROWS * 2), "g", "id", "trust", "at", fields(), strict=True)
    assert {(r["g"], r["field"]): r["id"] for r in out.collect()} == {(1, "city"): 4, (1, "impact"): 4, (2, "city"): 6, (2, "impact"): 5}


def test_summed_votes_and_pivot(spark):
    out = survivors(table(spark, ROWS * 2), "g", "id", "trust", "at", fields())
    got = {(r["g"], r["field"]): (r["id"], r["form"]) for r in out.collect()}
    assert got[(1, "city")] == (3, "oslo")  # two votes of trust five beat one
    record = {r["g"]: r for r in surviving_records(out, "g", "id", ["city", "impact"]).collect()}
    assert (record[1]["city"], record[1]["city_id"]) == ("oslo", 3) and set(record) == {1, 2}


def test_empty_table(spark):
    assert survivors(table(spark, ROWS).limit(0), "g", "id", "trust", "at", fields()).count() == 0


def test_strict_weights_outvote_any_number_of_lesser_votes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(1, i, 3, f"2020-01-{1 + i % 28:02d}", "many", 1, "x") for i in range(500)] + [(1, 900, 3, "2020-02-01", "late", 2, "x"), (1, 901, 4, "2001-01-01", "trusted", None, "x")]
    rows += [(g, 10_000 + 50 * g + k, rng.choice([None, 1, 2, 7]), rng.choice([None, "2020-01-01", "2020-01-02", "2021-06-01"]), rng.choice("abc"), rng.randint(0, 9), "x") for g in range(2, 60) for k in range(rng.randint(1, 12))]
    want = {}
    for g, i, trust, at, city, impact, _ in rows:
        for name, value, usable in (("city", city, True), ("impact", impact, impact is not None and impact <= 5)):
            if usable:
                want[g, name] = max(want.get((g, name), ((-1, "", -1), None)), ((-1 if trust is None else trust, at or "", i), i))

    def got():
        return {(r["g"], r["field"]): r["id"] for r in survivors(table(spark, rows), "g", "id", "trust", "at", fields(), strict=True).collect()}

    assert got() == {k: v[1] for k, v in want.items()}
    # The sums decide: votes that all weigh the same elect others.
    monkeypatch.setattr("seismark.llm.survivors._strict_votes", lambda levels: levels.groupBy("group", "field", "form").agg(F.max("top").alias("top"), F.lit(1.0).alias("support")))
    assert got() != {k: v[1] for k, v in want.items()}
