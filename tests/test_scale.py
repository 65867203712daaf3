"""Operators on hot groups and dense places, and models against plain versions of themselves."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seismark.functions import text as tx
from seismark.operators import events as ev
from seismark.operators import ingest, models
from seismark.operators.pairing import pairs_within
from seismark.session import drop_intermediate, shared_folder, written
from seismark.operators.dataset import ArticleSet
from seismark.sources import cache, files


def test_pairs_of_hot_keys_equal_all_pairs(spark):
    rows = [("hot", i) for i in range(70)] + [("warm", i) for i in range(5)] + [("one", 1), (None, 3), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, m bigint").withColumn("extra", F.col("m") * 2)
    got = [(r["k"], r["a"], r["b"]) for r in pairs_within(df, "k", "m", ("extra",), block=16).where("extra_a = 2 * a AND extra_b = 2 * b").collect()]
    want = {("hot", a, b) for a in range(70) for b in range(a + 1, 70)} | {("warm", a, b) for a in range(5) for b in range(a + 1, 5)}
    assert len(got) == len(set(got)) and set(got) == want
    assert pairs_within(df.limit(0), "k", "m").count() == 0


def test_two_dense_cells_take_linear_work(spark):
    # 100,000 points each side of a gap of exactly less and more than the radius.
    dense = spark.range(200_000).select((F.rand(1) * 0.3 + F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.17)).alias("lat"), (F.rand(2) * 0.3).alias("lon"))
    start = time.time()
    near = ev.spatial_clusters(dense, "lat", "lon", 100.0).select("loc_cluster").distinct().count()
    apart = ev.spatial_clusters(dense.withColumn("lat", F.when(F.col("lat") > 1, F.col("lat") + 0.6).otherwise(F.col("lat"))), "lat", "lon", 100.0).select("loc_cluster").distinct().count()
    assert (near, apart) == (1, 2) and time.time() - start < 90


def test_first_by_hash_equals_one_ordered_window(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice(["a", "a", "a", "b", None]), f"u{i}") for i in range(900)] + [("c", "u0"), ("c", None)], "g string, u string")
    order = Window.partitionBy("g").orderBy(F.md5(F.concat("u", F.lit("7"))), "u")
    plain = df.withColumn("is_test", F.row_number().over(order) <= F.ceil(F.count(F.lit(1)).over(Window.partitionBy("g")) * 0.3))
    assert sorted(map(str, ingest.seeded_split(df, ["g"], F.col("u"), 7, 0.3).collect())) == sorted(map(str, plain.collect()))
    sizes = spark.createDataFrame([("a", 11), (None, 3), ("b", 0), ("c", 5)], "g string, sample_size bigint")
    drawn = Counter(r["g"] for r in ingest.stratified_sample(df, ["g"], sizes, F.col("u"), 42).collect())
    assert drawn == {"a": 11, None: 3, "c": 2}
    assert ingest.seeded_split(df.limit(0), ["g"], F.col("u"), 7, 0.3).count() == 0


def test_place_consistency_equals_all_pairs(spark):
    rows = [("e", "Oslo"), ("e", "Oslo"), ("e", "near Oslo"), ("e", "Bergen"), ("e", None), ("f", "x"), ("g", None), ("g", "")]
    got = {r["k"]: r["loc_consistency"] for r in ev.place_consistency(spark.createDataFrame(rows, "k string, p string"), "k", "p").collect()}
    assert got["f"] == 100.0 and got["g"] == 0.0
    bergen = [r[0] for r in spark.createDataFrame([("Bergen", "Oslo"), ("Bergen", "near Oslo")], "a string, b string").select(ev.partial_ratio("a", "b")).collect()]
    assert abs(got["e"] - (100 * 3 + 2 * bergen[0] + bergen[1]) / 10) < 1e-9


def test_bayes_equals_plain_counts(spark):
    rng = random.Random(6)
    words = {d: Counter(rng.choices("abcdefgh" if d % 2 else "defghijk", k=6)) for d in range(40)}
    words[38] = Counter("zzz")
    rows = [(i, d, d % 3) for i, d in enumerate(list(words) * 2) if d < 30]
    test = [(100 + d, d, d % 3) for d in range(30, 40)]
    features = spark.createDataFrame([(d, t, float(n)) for d, c in words.items() for t, n in c.items()], "d bigint, token string, weight double")
    schema = "r bigint, d bigint, y int"
    got = {r["r"]: r["prediction"] for r in models.bayes_predictions(features, "d", spark.createDataFrame(rows, schema), spark.createDataFrame(test, schema), "r", "y").collect()}
    held, sizes, known = defaultdict(Counter), Counter(), set()
    for _, d, y in rows:
        held[y].update(words[d])
        sizes[y] += 1
        known |= set(words[d])
    for r, d, _ in test:
        score = {y: math.log(sizes[y] / len(rows)) + sum(n * math.log((held[y][t] + 1) / (sum(held[y].values()) + len(known))) for t, n in words[d].items() if t in known) for y in sizes}
        assert got[r] == max(sorted(score), key=score.get)
    empty = spark.createDataFrame([], schema)
    assert models.bayes_predictions(features, "d", empty, spark.createDataFrame(test, schema), "r", "y").where("prediction IS NOT NULL").count() == 0


def test_pipeline_weights_equal_the_table(spark):
    rows = spark.createDataFrame([(1, "aa bb bb cc".split(), 4), (2, "aa dd".split(), 2), (3, "aa bb".split(), 0)], "d bigint, tokens array<string>, size int")
    fitted = models.tfidf_pipeline(rows, "tokens", ["size"], 100)
    bag = models.bag_of_words(rows, "d", F.col("tokens"))
    vocabulary, count = models.fitted_vocabulary(bag, "d", rows.select("d"), 100)
    want = {(r["d"], r["token"]): r["weight"] for r in models.transformed(bag, "d", vocabulary).collect()}
    names = fitted.stages[0].vocabulary
    for r in fitted.transform(rows).collect():
        cells = dict(zip(r["features"].indices.tolist() if hasattr(r["features"], "indices") else range(r["features"].size), r["features"].toArray()[r["features"].indices] if hasattr(r["features"], "indices") else r["features"].toArray()))
        assert cells.get(len(names), 0.0) == r["size"]
        assert all(abs(cells.get(names.index(t), 0.0) - w) < 1e-12 for (d, t), w in want.items() if d == r["d"])
    assert count == 3


def test_classifier_is_saved_and_loaded(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choices("flood quake fire storm".split(), k=3) + ["today"] if i % 2 else rng.choices("match goal band film".split(), k=3) + ["today"], float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, tokens array<string>, label double")
    classifier = models.EventClassifier(most_rounds=50).fit(df.where("k < 150"))
    classifier.save(str(tmp_path / "model"))
    loaded = models.EventClassifier.load(str(tmp_path / "model"))
    figures = loaded.figures(df.where("k >= 150")).first()
    assert figures["accuracy"] == 1.0 and figures["log_loss"] < 0.5
    assert loaded.predict(df).count() == 200
    with pytest.raises(FileNotFoundError):
        models.EventClassifier.load(str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        models.EventClassifier().save(str(tmp_path / "unfitted"))
    folds = models.fold_figures(classifier.features(df).transform(df), "k", folds=3, most_rounds=50).collect()
    assert sorted((r["part"], r["fold"]) for r in folds) == [(p, f) for p in ("train", "validation") for f in ("0", "1", "2", "mean")]


def test_report_averages(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "l string, p string")
    got = {r["average"]: r for r in models.report_averages(models.classification_report(pairs, "l", "p")).collect()}
    assert got["accuracy"]["f1"] == 0.5 and got["macro"]["recall"] == 0.5 and got["weighted"]["precision"] == pytest.approx((0.5 * 2 + 0.5 + 1.0) / 4)


def test_topic_words_have_weights(spark):
    docs = spark.createDataFrame([(i, ("flood water rain" if i % 2 else "goal match team").split()) for i in range(60)], "k bigint, tokens array<string>")
    model, vectors, _ = models.fitted_topics(docs, "k", F.col("tokens"), count=2, rounds=10)
    told = models.topic_words(model, vectors, 5).collect()
    assert {r["rank"] for r in told} == {0, 1, 2, 3, 4} and all(r["weight"] > 0 for r in told)


def test_failed_responses(spark):
    good = '[{"event_occured":1,"event":"flood"},{"event_occured":0}]'
    texts = [good, f"```json\n{good}\n```", f"```\n{good}\n```", good[:-1], good[:-2] + "]", "[]", '{"event_occured":1}', None, "  ", "no JSON", "```json\n```"]
    df = spark.createDataFrame(list(enumerate(texts)), "batch bigint, response string").withColumn("items", F.lit(2))
    failed = {r["batch"]: r["failure"] for r in tx.failed_responses(df, "batch", "response", "items").collect()}
    assert failed == {3: "malformed", 4: "malformed", 5: "wrong_length", 6: "malformed", 7: "missing", 8: "missing", 9: "malformed", 10: "missing"}
    assert sorted({r["batch"] for r in tx.parse_label_response(df, "batch", "response", "items").collect()}) == [0, 1, 2]


def test_tables_in_files(spark, tmp_path):
    (tmp_path / "prices.csv").write_text("Date,Ticker,Close\n2020-01-02,T,1.5\nnot a day,T,\n")
    assert [(str(r["date"]), r["ticker"], r["close"]) for r in files.read_prices(spark, str(tmp_path / "prices.csv")).collect()] == [("2020-01-02", "T", 1.5), ("None", "T", None)]
    (tmp_path / "terms.csv").write_text("term\nflood\nflood\n\n")
    assert [r["term"] for r in files.read_terms(spark, str(tmp_path / "terms.csv")).collect()] == ["flood"]
    labels = spark.createDataFrame([(1, 1, "flood", 3, "2020-01-01", "near X"), (2, 0, None, None, None, None)], "index_id bigint, event_occured int, event string, impact int, dt string, loc string")
    files.write_label_json(labels, str(tmp_path / "labels"))
    assert sorted(map(str, spark.read.schema(labels.schema).json(str(tmp_path / "labels")).collect())) == sorted(map(str, labels.collect()))
    (tmp_path / "batch.json").write_text('[{"index_id": 5, "event_occured": 0},\n {"index_id": 6, "event_occured": 1, "impact": 2}]')
    assert {r["index_id"]: r["impact"] for r in files.read_label_json(spark, str(tmp_path / "batch.json")).collect()} == {5: None, 6: 2}


def test_intermediate_tables_are_dropped(spark):
    table = written(spark.range(5).toDF("x"))
    folder = shared_folder(spark)
    assert table.count() == 5
    drop_intermediate(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert written(spark.range(5).toDF("x")).count() == 5


def test_stages_are_kept_by_their_parameters(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    folder = str(tmp_path)
    assert cache.cached(spark, folder, "stage", {"k": 1, "words": ["a"]}, build).count() == 3
    assert cache.cached(spark, folder, "stage", {"words": ["a"], "k": 1}, build).count() == 3 and len(built) == 1
    assert cache.cached(spark, folder, "stage", {"words": ["a"], "k": 2}, build).count() == 3 and len(built) == 2


def test_stored_articles_hold_each_url_once(spark, tmp_path):
    cache.create_tables(spark, "stored", str(tmp_path / "stored"))
    cache.create_tables(spark, "stored")
    rows = spark.createDataFrame([(i, u, "t", None, "US", "flood", 0, 1) for i, u in ((1, "a"), (2, "a"), (3, "b"), (4, None))], cache.TABLES["articles"].replace(" BIGINT", " bigint"))
    assert (cache.append_articles(spark, "stored", rows), cache.append_articles(spark, "stored", rows)) == (2, 0)
    spark.sql("DROP DATABASE stored CASCADE")


def test_strict_sets_are_not_empty(spark):
    articles = spark.createDataFrame([(1, "flood")], "index_id bigint, query string")
    both = ArticleSet(articles, spark.createDataFrame([(1, 1)], "index_id bigint, event_occured int"))
    assert both.where_articles(["flood"]).strict().articles.count() == 1
    with pytest.raises(ValueError):
        both.where_articles(["quake"]).strict()


def test_impact_models_train_on_each_text_and_class_once(spark, tmp_path, monkeypatch):
    from seismark.plans import reference

    articles, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("articles", "labels"))
    for name, df, keys in (("articles", articles, ("index_id",)), ("labels", labels, ("index_id", "label_id"))):
        shifted = df.withColumns({k: F.col(k) + 1_000_000 for k in keys})
        df.unionByName(shifted).write.parquet(str(tmp_path / f"{name}.parquet"))
    seen = []

    class Stub:
        def __init__(self, **given):
            pass

        def fit(self, df):
            seen.append((df.count(), df.agg(F.sum("weight")).first()[0]))
            raise ZeroDivisionError

    monkeypatch.setattr(models, "LogisticRegression", Stub)
    with pytest.raises(ZeroDivisionError):
        reference.lr_balanced_articles(spark, str(tmp_path))
    rows = reference._impact_rows(spark, str(tmp_path)).where("NOT is_test")
    texts = spark.read.parquet(str(tmp_path / "articles.parquet")).where("content IS NOT NULL").select("index_id", "content").distinct()
    trained = rows.join(texts, "index_id")
    assert seen[0][0] == trained.select("content", "impact").distinct().count() < trained.count()
    assert 0.9 < seen[0][1] / trained.count() < 1.1


def test_logistic_on_documents_is_the_one_on_rows(spark):
    from pyspark.ml.linalg import Vectors

    rng = random.Random(4)
    vectors = spark.createDataFrame([(d, Vectors.sparse(3, [0, d % 2 + 1], [d % 7 + 1.0, 2.0])) for d in range(20)], ["document", "features"])
    rows = spark.createDataFrame([(i, i % 20, (i % 20 + rng.randrange(3)) % 3, i % 4 == 0) for i in range(400)], "key int, document long, label int, is_test boolean")
    got = models.balanced_logistic_on_documents(rows, vectors, "key", "document", "label")
    want = models.balanced_logistic_on_features(rows.join(vectors, "document"), "key", "features", "label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_impact_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    from seismark.plans import reference

    plans, write = [], reference.written

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(reference, "written", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, vectors = reference._impact_vectors(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    initial = plans[0].split("== Initial Plan ==")[-1]
    assert sum("Exchange hashpartitioning" in line for line in initial.splitlines()) == 2  # the texts and the list of those asked
    assert vectors.select("text_id").distinct().count() == vectors.count() == rows.select("text_id").distinct().count()
