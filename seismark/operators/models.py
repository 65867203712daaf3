"""Classifiers, topics and term weights over documents, on Spark ML and plain aggregation."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.operators.ingest import fold_of
from seismark.session import broadcast_if_small, cut_lineage

#: Classes a classifier may have: their list is read to the driver, and each is a column of a plan.
MOST_CLASSES = 1_000
#: Rows of a table of tokens, documents' lengths or class sizes that are broadcast at most.
BROADCAST_TOKENS = 1_000_000
#: Rows of one task while a linear model is fitted; small tables are not spread over more tasks than that needs.
ROWS_OF_TASK = 20_000


def bag_of_words(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, token, n."""
    return docs.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def frequent_tokens(bag: DataFrame, key: str, least_docs: int = 5, most_share: float = 0.8) -> DataFrame:
    """token, docs: tokens in at least ``least_docs`` and at most a share of the documents that have any token."""
    total = bag.select(F.count_distinct(key).alias("total"))
    per_token = bag.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
    return per_token.crossJoin(F.broadcast(total)).where((F.col("docs") >= least_docs) & (F.col("docs") <= most_share * F.col("total"))).select("token", "docs")


def tfidf(bag: DataFrame, key: str, documents: int) -> DataFrame:
    """key, token, weight: n (ln((1 + N) / (1 + df)) + 1), each document scaled to length one."""
    bag = cut_lineage(bag)
    per_token = broadcast_if_small(cut_lineage(bag.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))), BROADCAST_TOKENS)
    weighed = bag.join(per_token, "token").select(key, "token", (F.col("n") * (F.log((1 + F.lit(documents)) / (1 + F.col("docs"))) + 1)).alias("raw"))
    norm = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighed.join(norm, key).select(key, "token", (F.col("raw") / F.col("norm")).alias("weight"))


def naive_bayes_terms(bag: DataFrame, key: str, classes: DataFrame, label: str, smoothing: float = 1.0) -> DataFrame:
    """label, token, log_probability of a multinomial model, for the tokens seen in each class."""
    counts = cut_lineage(bag.join(classes, key).groupBy(label, "token").agg(F.sum("n").alias("n")))
    totals = counts.groupBy(label).agg(F.sum("n").alias("total"))
    vocabulary = counts.select(F.count_distinct("token").alias("vocabulary"))
    joined = counts.join(totals, label).crossJoin(F.broadcast(vocabulary))
    return joined.select(label, "token", F.log((F.col("n") + smoothing) / (F.col("total") + smoothing * F.col("vocabulary"))).alias("log_probability"))


def classification_report(pairs: DataFrame, label: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support per class; a ratio without cases is one. Null labels are left out."""
    cells = pairs.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    actual = cells.groupBy(F.col("l").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("right"))
    said = cells.where(F.col("p").isNotNull()).groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("said"))
    joined = actual.join(said, "class", "full").fillna(0, ["support", "right", "said"])
    precision, recall = F.coalesce(F.try_divide("right", "said"), F.lit(1.0)), F.coalesce(F.try_divide("right", "support"), F.lit(1.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return joined.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """average ('accuracy', 'macro', 'weighted'), precision, recall, f1, support of a ``classification_report``.

    Accuracy is the share of right rows in all three figures. Macro averages every class alike, weighted by its support.
    """
    rows = F.sum("support")
    right = F.sum(F.col("recall") * F.col("support"))
    figures = ("precision", "recall", "f1")
    accuracy = F.struct(F.lit("accuracy").alias("average"), *[F.try_divide(right, rows).alias(c) for c in figures], rows.alias("support"))
    macro = F.struct(F.lit("macro").alias("average"), *[F.avg(c).alias(c) for c in figures], rows.alias("support"))
    weighted = F.struct(F.lit("weighted").alias("average"), *[F.try_divide(F.sum(F.col(c) * F.col("support")), rows).alias(c) for c in figures], rows.alias("support"))
    return report.agg(F.array(accuracy, macro, weighted).alias("rows")).select(F.inline("rows"))


def fitted_vocabulary(bag: DataFrame, key: str, rows: DataFrame, most_tokens: int) -> tuple[DataFrame, int]:
    """(token, idf) of the ``most_tokens`` commonest tokens, and the number of rows they are fitted on.

    ``rows`` holds the key of each training row; a document that several rows share counts for each of them. idf is
    ln((1 + rows) / (1 + rows with the token)) + 1; ties of the count go by the token.
    """
    times = rows.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    count = rows.count()
    totals = bag.join(times, key).groupBy("token").agg(F.sum(F.col("n") * F.col("times")).alias("total"), F.sum("times").alias("docs"))
    common = totals.orderBy(F.desc("total"), "token").limit(most_tokens)
    return common.select("token", (F.log((1 + F.lit(count)) / (1 + F.col("docs"))) + 1).alias("idf")), count


def transformed(bag: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """key, token, weight: TF-IDF by a fitted vocabulary, each document scaled to length one; other tokens are left out."""
    raw = bag.join(vocabulary, "token").select(key, "token", (F.col("n") * F.col("idf")).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "token", (F.col("raw") / F.col("norm")).alias("weight"))


def bayes_predictions(features: DataFrame, key: str, train: DataFrame, test: DataFrame, row: str, label: str, smoothing: float = 1.0) -> DataFrame:
    """row, label, prediction of a multinomial naive Bayes model for the rows of ``test``.

    ``features``: key, token, weight per document; ``train`` and ``test``: rows with the key of their document and the
    label. Classes are weighed by their share of the training rows; a feature that a class has not seen counts with the
    smoothing alone, one that training has not seen not at all. Ties go to the lesser class; a document without features
    gets the commonest class. Null labels are not trained on.
    """
    sizes = train.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("times"))
    sums = cut_lineage(features.join(sizes, key).groupBy(label, "token").agg(F.sum(F.col("weight") * F.col("times")).alias("held")))
    classes = {r[0]: r[1] for r in sizes.groupBy(label).agg(F.sum("times")).limit(MOST_CLASSES + 1).collect()}
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if not classes:
        return test.select(row, label, F.lit(None).cast(test.schema[label].dataType).alias("prediction"))
    totals = {r[0]: r[1] for r in sums.groupBy(label).agg(F.sum("held")).collect()}
    known = sorted(classes)
    per_token = cut_lineage(sums.groupBy("token").agg(*[F.coalesce(F.sum(F.when(F.col(label) == c, F.col("held"))), F.lit(0.0)).alias(f"held{i}") for i, c in enumerate(known)]))
    tokens = per_token.count()
    terms = broadcast_if_small(per_token, BROADCAST_TOKENS)
    asked = features.join(test.select(key).distinct(), key, "left_semi").join(terms, "token")
    chance = [F.sum(F.col("weight") * F.log((F.col(f"held{i}") + smoothing) / (totals.get(c, 0.0) + smoothing * tokens))).alias(f"score{i}") for i, c in enumerate(known)]
    scores = test.select(row, key, label).join(asked.groupBy(key).agg(*chance), key, "left")
    rows = sum(classes.values())
    kind = test.schema[label].dataType
    ranked = F.array(*[F.struct((-(F.coalesce(F.col(f"score{i}"), F.lit(0.0)) + math.log(classes[c] / rows))).alias("cost"), F.lit(c).cast(kind).alias("label")) for i, c in enumerate(known)])
    return scores.select(row, label, F.array_min(ranked)["label"].alias("prediction"))


def tfidf_pipeline(train: DataFrame, tokens: str, numbers: list[str], most_tokens: int = 10_000, times: str | None = None) -> PipelineModel:
    """A fitted pipeline from a token array and some numeric columns to one column ``features``: the TF-IDF weights of the
    commonest tokens, scaled to length one, then the numbers as they are.

    ``times`` names the column that tells how many training rows a row stands for; such rows are counted as many times.
    Ties of the count go by the token.
    """
    if times is None:
        counted = Pipeline(stages=[CountVectorizer(inputCol=tokens, outputCol="_counts", vocabSize=most_tokens), IDF(inputCol="_counts", outputCol="_idf")]).fit(train)
        counts, idf = counted.stages[0], [float(x) for x in counted.stages[1].idf]
    else:
        totals = train.select(times, F.explode(tokens).alias("token")).groupBy("token").agg(F.sum(times).alias("total"))
        docs = train.select(times, F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.sum(times).alias("docs"))
        common = totals.join(docs, "token").orderBy(F.desc("total"), "token").limit(most_tokens).select("token", "docs").collect()
        rows = train.agg(F.coalesce(F.sum(times), F.lit(0))).first()[0]
        counts = CountVectorizerModel.from_vocabulary([r["token"] for r in common], inputCol=tokens, outputCol="_counts")
        idf = [math.log((1 + rows) / (1 + r["docs"])) for r in common]
    scale = Vectors.dense([x + 1.0 for x in idf])
    last = [ElementwiseProduct(scalingVec=scale, inputCol="_counts", outputCol="_weighed"), Normalizer(inputCol="_weighed", outputCol="_unit"), VectorAssembler(inputCols=["_unit", *numbers], outputCol="features")]
    return PipelineModel(stages=[counts, *last])


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``df`` plus weight: rows over classes times class size."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    whole = sizes.agg(F.sum("_size").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    return df.join(broadcast_if_small(cut_lineage(sizes), BROADCAST_TOKENS), label).crossJoin(F.broadcast(whole)).withColumn("weight", F.col("_rows") / (F.col("_classes") * F.col("_size"))).drop("_size", "_rows", "_classes")


def _in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_OF_TASK))))


def _scored(model, rows: DataFrame) -> DataFrame:
    """One row: accuracy and log loss of a binary model."""
    chance = F.greatest(F.lit(1e-15), F.get(vector_to_array("probability"), F.col("label").cast("int")))
    return model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.avg(-F.log(chance)).alias("log_loss"))


def cross_validated_logistic(df: DataFrame, key: str, vector: str, label: str, folds: int = 5, seed: int = 103, most_rounds: int = 1000) -> DataFrame:
    """fold, accuracy, log_loss of a binary logistic regression fitted on the other folds; ``label`` is 0 or 1."""
    rows = df.select(F.col(key), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return fold_figures(rows, key, folds, seed, most_rounds).where("part = 'validation' AND fold <> 'mean'").select(F.col("fold").try_cast("int").alias("fold"), "accuracy", "log_loss")


def fold_figures(rows: DataFrame, key: str, folds: int = 5, seed: int = 103, most_rounds: int = 1000) -> DataFrame:
    """part ('train', 'validation'), fold, accuracy, log_loss of each fold, and their means under fold 'mean'.

    ``rows`` holds key, features and a label of 0 or 1; each fold's model is fitted on the other folds.
    """
    rows = cut_lineage(rows.withColumn("fold", fold_of(F.col(key).cast("string"), seed, folds)))
    count = rows.count()
    out = None
    for fold in range(folds):
        train, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        model = LogisticRegression(maxIter=most_rounds, regParam=1.0 / max(1, count), standardization=False).fit(_in_few_tasks(train, count))
        for part, some in (("train", train), ("validation", held)):
            result = _scored(model, some).select(F.lit(part).alias("part"), F.lit(str(fold)).alias("fold"), "accuracy", "log_loss")
            out = result if out is None else out.unionByName(result)
    means = out.groupBy("part").agg(F.avg("accuracy").alias("accuracy"), F.avg("log_loss").alias("log_loss")).select("part", F.lit("mean").alias("fold"), "accuracy", "log_loss")
    return out.unionByName(means)


class EventClassifier:
    """Whether a text reports an event: hashed TF-IDF of its words and a logistic regression, saved and loaded as one."""

    def __init__(self, model: PipelineModel | None = None, terms: int = 1 << 14, most_rounds: int = 1000) -> None:
        self.model, self.terms, self.most_rounds = model, terms, most_rounds

    def features(self, train: DataFrame) -> PipelineModel:
        return Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="_counts", numFeatures=self.terms), IDF(inputCol="_counts", outputCol="_weighed", minDocFreq=2), Normalizer(inputCol="_weighed", outputCol="features")]).fit(train)

    def fit(self, train: DataFrame) -> EventClassifier:
        """``train`` holds tokens (array of strings) and label (0 or 1)."""
        vectors = self.features(train)
        count = train.count()
        logistic = LogisticRegression(maxIter=self.most_rounds, regParam=1.0 / max(1, count), standardization=False)
        self.model = PipelineModel(stages=[*vectors.stages, logistic.fit(_in_few_tasks(vectors.transform(train), count))])
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` plus probability and prediction."""
        if self.model is None:
            raise ValueError("the classifier is not fitted")
        return self.model.transform(rows).drop("_counts", "_weighed", "features", "rawPrediction")

    def figures(self, rows: DataFrame) -> DataFrame:
        """One row: accuracy and log_loss on labelled rows."""
        if self.model is None:
            raise ValueError("the classifier is not fitted")
        return _scored(self.model, rows)

    def save(self, path: str) -> None:
        if self.model is None:
            raise ValueError("the classifier is not fitted")
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> EventClassifier:
        """The classifier saved under a path; FileNotFoundError if there is none."""
        from pyspark.sql import SparkSession

        session = SparkSession.active()
        folder = session._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
        if not folder.getFileSystem(session._jsc.hadoopConfiguration()).exists(folder):
            raise FileNotFoundError(f"no model under {path}")
        return cls(PipelineModel.load(path))


def forest_on_features(df: DataFrame, key: str, features: str, label: str, trees: int = 200, seed: int = 12, depth: int = 30) -> DataFrame:
    """key, label, prediction of a class-balanced random forest fitted on the rows without is_test, for those with it."""
    rows = balanced_weights(df.select(key, F.col(features).alias("features"), F.col(label).cast("double").alias(label), "is_test"), label)
    model = RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=depth, labelCol=label, weightCol="weight", maxMemoryInMB=1024).fit(rows.where("NOT is_test"))
    return model.transform(rows.where("is_test")).select(key, label, "prediction")


def forest_predictions(df: DataFrame, key: str, vector: str, label: str, trees: int = 200, seed: int = 12, depth: int = 30) -> DataFrame:
    """As ``forest_on_features``, for vectors given as arrays."""
    return forest_on_features(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))), key, "features", label, trees, seed, depth)


def balanced_logistic_on_features(df: DataFrame, key: str, features: str, label: str, most_rounds: int = 2000) -> DataFrame:
    """As ``forest_on_features``, with a multinomial logistic regression."""
    rows = balanced_weights(df.select(key, F.col(features).alias("features"), F.col(label).cast("double").alias(label), "is_test"), label)
    train = cut_lineage(rows.where("NOT is_test"))
    model = LogisticRegression(family="multinomial", maxIter=most_rounds, labelCol=label, weightCol="weight").fit(_in_few_tasks(train, train.count()))
    return model.transform(rows.where("is_test")).select(key, label, "prediction")


def balanced_logistic_on_documents(rows: DataFrame, vectors: DataFrame, key: str, document: str, label: str, most_rounds: int = 2000) -> DataFrame:
    """As ``balanced_logistic_on_features``, for rows that share documents.

    ``rows`` holds key, document, label and is_test, ``vectors`` document and features. The training rows of one document
    and class are one row with the sum of their weights, which leaves the likelihood as it is; each document is judged once.
    """
    weighed = balanced_weights(rows.select(key, document, F.col(label).cast("double").alias(label), "is_test"), label)
    sums = cut_lineage(weighed.where("NOT is_test").groupBy(document, label).agg(F.sum("weight").alias("weight")))
    model = LogisticRegression(family="multinomial", maxIter=most_rounds, labelCol=label, weightCol="weight").fit(_in_few_tasks(sums.join(vectors, document), sums.count()))
    asked = weighed.where("is_test").select(key, document, label)
    judged = model.transform(vectors.join(asked.select(document).distinct(), document, "left_semi")).select(document, "prediction")
    return asked.join(judged, document).select(key, label, "prediction")


def balanced_logistic_predictions(df: DataFrame, key: str, vector: str, label: str, most_rounds: int = 2000) -> DataFrame:
    """As ``balanced_logistic_on_features``, for vectors given as arrays."""
    return balanced_logistic_on_features(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))), key, "features", label, most_rounds)


def topic_words(model, vectors, most_words: int) -> DataFrame:
    """topic, rank, word, weight: the likeliest words of each topic. The vocabulary is a table, not a literal."""
    told = model.describeTopics(most_words)
    words = told.sparkSession.createDataFrame(list(enumerate(vectors.vocabulary)), "term int, word string")
    told = told.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "cell"))
    told = told.select("topic", "rank", F.col("cell.termIndices").alias("term"), F.col("cell.termWeights").alias("weight"))
    return words.join(F.broadcast(told), "term").select("topic", "rank", "word", "weight")


def fitted_topics(docs: DataFrame, key: str, tokens: Column, count: int = 8, rounds: int = 20, seed: int = 42, least_docs: int = 5, most_share: float = 0.8):
    """The LDA model, its vocabulary and the counted documents, for ``topics`` and ``topic_words``."""
    rows = docs.select(key, tokens.alias("tokens"))
    vectors = CountVectorizer(inputCol="tokens", outputCol="features", minDF=least_docs, maxDF=most_share, vocabSize=100_000).fit(rows)
    counted = vectors.transform(rows)
    return LDA(k=count, maxIter=rounds, seed=seed, optimizeDocConcentration=True).fit(counted), vectors, counted


def topics(docs: DataFrame, key: str, tokens: Column, count: int = 8, rounds: int = 20, seed: int = 42, least_docs: int = 5, most_share: float = 0.8) -> DataFrame:
    """key, topic (the likeliest, -1 without a known token) and topic_label (its two first words)."""
    model, vectors, counted = fitted_topics(docs, key, tokens, count, rounds, seed, least_docs, most_share)
    labels = topic_words(model, vectors, 2).where("rank < 2").groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " + ").alias("topic_label"))
    spread = vector_to_array("topicDistribution")
    topic = F.when(F.array_max(spread) > 0, F.array_position(spread, F.array_max(spread)).cast("int") - 1).otherwise(-1)
    return model.transform(counted).select(key, topic.alias("topic")).join(F.broadcast(labels), "topic", "left").select(key, "topic", "topic_label")
