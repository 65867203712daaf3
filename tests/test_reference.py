import math
import random
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seismark.functions import phrases
from seismark.functions import text as tx
from seismark.operators import events as ev
from seismark.operators import ingest, models, stocks
from seismark.operators.components import connected_components
from seismark.operators.dataset import ArticleSet
from seismark.operators.gazetteer import gazetteer, places_in
from seismark.sources import files
from seismark.plans import general, reference
from seismark.streaming.sessions import drain, file_stream, first_of_key

WITH_SQL = sorted({**reference.ORACLES, **general.ORACLES})


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(0, i) for i in range(400, 460)] + [(7, 7), (3, None)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    want = roots([(a, b) for a, b in edges if b is not None and a != b])
    assert got == want
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("seismark.operators.components.EDGES_OF_ONE_TASK", 0)
    test_components_equal_union_find(spark)


def test_spatial_clusters_equal_brute_force(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(250)] + [(rng.uniform(87, 90), rng.uniform(-180, 180)) for _ in range(40)] + [(rng.uniform(-2, 2), s * rng.uniform(178.5, 180)) for _ in range(30) for s in (-1, 1)]
    points += [(95.0, 0.0), (None, 1.0), points[0]]
    got = {(r["lat"], r["lon"]): r["loc_cluster"] for r in ev.spatial_clusters(spark.createDataFrame(points, "x double, y double"), "x", "y", 400.0).collect()}
    valid = sorted({p for p in points if None not in p and abs(p[0]) <= 90})

    def km(p, q):
        a, b, c, d = map(math.radians, (*p, *q))
        return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    want = roots([(i, j) for i in range(len(valid)) for j in range(i, len(valid)) if i == j or km(valid[i], valid[j]) <= 400])
    assert set(got) == set(valid)
    assert all((got[valid[i]] == got[valid[j]]) == (want[i] == want[j]) for i in range(len(valid)) for j in range(len(valid)))


def test_temporal_gap_and_confidence(spark):
    rows = [("flood", d, 3) for d in ("2020-01-01", "2020-01-04", "2020-01-08", "2020-01-08")] + [("fire", "2020-01-01", 1)]
    df = spark.createDataFrame(rows, "event string, d string, impact int").withColumn("day", F.to_date("d"))
    got = sorted((r["event"], str(r["day"]), r["time_cluster"]) for r in ev.temporal_clusters(df, ["event"], "day", 3).collect())
    assert [x[2] for x in got] == [0, 0, 0, 1, 1]
    zero = F.lit(0.0)
    scores = spark.createDataFrame([(1,), (2,), (3,), (10,)], "n int").select(ev.confidence(F.col("n"), zero, zero, zero, zero, F.lit(100.0)).alias("c")).collect()
    assert [r["c"] for r in scores] == [0.64, 0.68, 0.72, 1.0]
    assert spark.range(1).select(ev.confidence(F.lit(3), F.lit(None).cast("double"), zero, zero, zero, F.lit(100.0)).alias("c")).first()["c"] is None


def test_unique_events(spark):
    rows = [(10.0, 20.0, "flood", "2020-01-01", 3, "near X", "X", "S", "C"), (10.01, 20.0, "flood", "2020-01-02", 4, "near X", "X", "S", "C"), (10.0, 20.0, None, "2020-01-01", None, None, None, None, None), (50.0, 20.0, "flood", "2020-01-01", 1, "Y", "Y", "S", "C")]
    df = spark.createDataFrame(rows, "latitude double, longitude double, event string, d string, impact int, loc string, city string, state string, country string").withColumn("day", F.to_date("d"))
    got = {(r["event"], r["n_reports"]): r for r in ev.unique_events(df).collect()}
    assert set(got) == {("flood", 2), (None, 1), ("flood", 1)} and got[("flood", 2)]["city"] == "X" and got[(None, 1)]["event_id"].endswith("_-1")


def test_stocks(spark):
    prices = spark.createDataFrame([(f"2020-01-{d:02d}", "T", float(100 + d)) for d in range(1, 20) if d % 7 > 1] + [("2020-01-03", "T", 103.0), ("2020-01-06", None, 1.0)], "d string, ticker string, close double").select(F.to_date("d").alias("date"), "ticker", "close")
    days = spark.createDataFrame([("2019-12-01",), ("2020-01-07",), ("2020-01-19",), ("2020-02-01",)], "d string").select(F.to_date("d").alias("day"))
    got = {str(r["day"]): str(r["date"]) for r in stocks.forward_asof(days, "day", stocks.price_steps(prices)).collect()}
    assert got == {"2019-12-01": "2020-01-02", "2020-01-07": "2020-01-09", "2020-01-19": "2020-01-19"}
    flat = stocks.event_return_correlation(days.withColumn("event", F.lit("flood")), "event", "day", prices).collect()
    assert [r["corr_1d"] for r in flat] == [None]


def test_dates_and_text(spark):
    row = spark.createDataFrame([("On Thursday it burned, and yesterday too.", None, date(2024, 5, 2)), (None, "Quake on Friday", date(2024, 5, 2)), ("nothing", None, date(2024, 5, 2))], "c string, t string, p date")
    days = [r[0] for r in row.select(phrases.event_day(F.col("c"), F.col("t"), F.col("p"))).collect()]
    assert days == [date(2024, 5, 2), date(2024, 4, 26), None]
    texts = spark.createDataFrame([("It's  Über—we can't stop!", "<html><nav>Menu</nav><article><h1>A &amp; B</h1><p>Text</p></article></html>", "```json\n[{\"event_occured\":1},{\"event_occured\":0}]\n```"), (None, None, "{\"event_occured\":1}")], "a string, html string, response string")
    out = texts.select(tx.clean_text(F.col("a")).alias("a"), tx.main_text(F.col("html")).alias("h")).collect()
    assert (out[0]["a"], out[0]["h"], out[1]["a"], out[1]["h"]) == ("it is überwe can not stop", "A & B Text", None, None)
    parsed = tx.parse_label_response(texts.withColumn("batch", F.monotonically_increasing_id()).withColumn("items", F.lit(2)), "batch", "response", "items")
    assert [r["event_occured"] for r in parsed.orderBy("position").collect()] == [1, 0]
    match = spark.createDataFrame([("plane crash", "crashes + air"), ("flood", None), ("riots", "quake")], "a string, b string").select(tx.shares_partial_word(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in match] == [True, False, False]
    soft = spark.createDataFrame([(None, None), ("", None), ("York", "New York"), ("a", None), ("x", "y")], "a string, b string").select(tx.soft_equal(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in soft] == [1, 0, 1, 0, 0]
    actions = spark.createDataFrame([(200, 0), (404, 0), (429, 2), (429, 5), (None, 1)], "s int, k int").select(tx.fetch_action(F.col("s"), F.col("k"))).collect()
    assert [r[0] for r in actions] == ["store", "drop", "retry_after_4", "drop", "retry_after_2"]


def test_gazetteer(spark):
    places = spark.createDataFrame([("Lake Öst", "Oldtown", "Eastshire", "Aland", 5)], "city string, alt_name string, state string, country string, population bigint")
    countries = spark.createDataFrame([("Aland", "Republic of Aland")], "country string, official_name string")
    texts = spark.createDataFrame([(1, "FIRE IN LAKE ÖST, ALAND'S PRIDE"), (2, "quiet"), (3, None), (4, "")], "k bigint, t string")
    got = sorted((r["k"], r["kind"], r["name"]) for r in places_in(texts, "k", "t", gazetteer(places, countries)).collect())
    assert got == [(1, "city", "lake ost"), (1, "country", "aland")]


def test_filters_keep_both_sides(spark):
    articles = spark.createDataFrame([(1, "flood"), (2, "riots")], "index_id bigint, query string")
    labels = spark.createDataFrame([(1, 1, None, "2020-01-01"), (1, 0, "X", "bad"), (3, 1, None, None)], "index_id bigint, event_occured int, city string, dt string")
    kept = ArticleSet(articles, labels).where_labels(event_occured=True, missing=["city"])
    assert [r[0] for r in kept.articles.select("index_id").collect()] == [1]
    assert ArticleSet(articles, labels).where_articles(["flood"]).labels.count() == 2
    assert ArticleSet(articles, labels).where_articles([]).articles.count() == 2
    assert ArticleSet(articles, labels).article(1).count() == 2


def test_ingest(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(1, 10_001)], "pos bigint, n int")
    got = {r["pos"]: r["offset"] for r in ingest.running_offsets(df, "pos", F.col("n"), width=64).collect()}
    total = 0
    for i in range(1, 10_001):
        assert got[i] == total
        total += i % 3
    split = ingest.seeded_split(df.limit(100), ["n"], F.col("pos").cast("string"), 1, 0.3)
    assert split.where("is_test").groupBy("n").count().count() == 3
    left = spark.createDataFrame([("a",), ("b",), (None,)], "url string")
    assert [r[0] for r in ingest.unprocessed(left, "url", left.where("url = 'a'"), left.where("url IS NULL")).collect()] == ["b"]


def test_report_and_models(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None), (None, "a")], "l string, p string")
    got = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in models.classification_report(pairs, "l", "p").collect()}
    assert got == {"a": (1.0, 0.5, 2), "b": (0.5, 1.0, 1), "c": (1.0, 0.0, 1)}


def test_models_run_at_the_size_of_the_reference(spark, monkeypatch):
    import __spark_entry__ as entry

    passed = {}
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **given: passed.setdefault("forest", given) and 1 / 0)
    monkeypatch.setattr(models, "LogisticRegression", lambda **given: passed.setdefault(given.get("family", "binomial"), given) and 1 / 0)
    for name in ("rf_impact", "cv_logistic", "lr_balanced"):
        with pytest.raises(ZeroDivisionError):
            entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert (passed["forest"]["numTrees"], passed["forest"]["maxDepth"]) == (200, 30)
    assert (passed["binomial"]["maxIter"], passed["multinomial"]["maxIter"]) == (1000, 2000)


def test_files_and_stream(spark, tmp_path):
    links = spark.createDataFrame([("t", "u1", "d", "20200101T000000Z", "US", "flood"), ("t", "u2", "d", "20200101T000000Z", "US", "flood")], files.LINK_SCHEMA)
    files.write_links(links, str(tmp_path / "links"))
    assert files.read_links(spark, str(tmp_path / "links")).count() == 2
    files.write_failed(links, "url", str(tmp_path / "failed"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "failed")).collect()) == ["u1", "u2"]
    rows = spark.createDataFrame([("u1", "2020-01-01 00:00:00"), ("u1", "2020-01-01 00:00:01"), ("u2", "2020-01-01 00:00:02")], "url string, at string").select("url", F.to_timestamp("at").alias("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "rows.parquet"))
    stream = first_of_key(file_stream(spark, str(tmp_path / "in"), "rows.parquet", rows.schema), "url", "at", "1 hour")
    drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    drain(first_of_key(file_stream(spark, str(tmp_path / "in"), "rows.parquet", rows.schema), "url", "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u1", "u2"]


@pytest.mark.parametrize("name", WITH_SQL)
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def plain(x):
        """Numbers and days alike, whichever type a column with or without nulls got."""
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return ""
        if isinstance(x, float):
            return f"{x:.6f}" if x != int(x) else str(int(x))
        return str(x).removesuffix(" 00:00:00")

    text = lambda df: sorted(tuple(map(plain, row)) for row in df[sorted(df.columns)].itertuples(index=False))
    assert text(got) == text(want)
