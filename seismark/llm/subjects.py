"""Subject areas of documents, from clusters of the corpus and a few labelled texts.

Normalised TF-IDF vectors of all documents are clustered by bisecting k-means. Each leaf is labelled with a mixture of
subjects by its discriminative terms: the labelled texts say which subjects those terms belong to. Every sentence
of a document falls to the leaf whose terms it holds, and the mixtures of its sentences' leaves, averaged, are the
document's: they propose its subjects.

Leaves hold whole documents, and a leaf of documents about two subjects cannot say which of them one sentence is about.
The proposals are therefore checked exactly: the leaves' mixtures give every term its first weights, counting passes
over all sentences sharpen them, and a proposed subject stays if the given share of the sentences is about it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.session import written

#: Hashed terms (the bound on everything that is sent to all tasks), leaves, and rounds of each split.
TERMS, LEAVES, ROUNDS = 1 << 15, 48, 6
#: Labelled texts are a bounded input: at most so many are read.
LABELLED_TEXTS = 20_000
#: Documents whose terms are scored together.
DOCUMENTS_AT_ONCE = 1_000
#: First counting pass, by the leaves' weights: a sentence is about a subject from the first score on, by two terms that
#: weigh STRONG, and about none below the second.
FIRST, STRONG = (4.0, 3.0), 1.0
#: Log-odds from which a term tells its leaves' subjects, and the most that it weighs at first.
TELLING, MOST_WEIGHT = 1.0, 3.0
#: Part of the asked share that a document's leaf mixture must hold of a subject to propose it.
PROPOSED = 0.25
#: Later passes score by the counts before them, as shares of what the sentences of a subject score on average.
LATER = ((0.5, 0.35), (0.45, 0.3))
#: Share of that average by which a sentence must favour a subject over none in the end.
LEAD = 0.2

_TERM = re.compile(r"[^\W\d_][\w'’-]*[^\W_]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”’')\]]*\s+|\n+")


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if _TERM.search(s)]


class _TermIds(dict):
    """Term to hashed id, as a plain polynomial hash so that every worker agrees."""

    def __missing__(self, term: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = 7
        for byte in term.encode():
            code = (code * 131 + byte) % 1_000_000_007
        self[term] = code % TERMS
        return self[term]


def text_terms(text: str, ids: _TermIds) -> tuple[list[int], list[int]]:
    """Hashed terms of a text, sentence by sentence and each once per sentence, and their number in each sentence."""
    flat: list[int] = []
    lengths = []
    for sentence in sentences(text.lower()):
        terms = set(map(ids.__getitem__, _TERM.findall(sentence)))
        flat += terms
        lengths.append(len(terms))
    return flat, lengths


def tokenised(documents: DataFrame, document: str, text: str) -> DataFrame:
    """document, ids, lengths: the terms of every sentence of a document, written down once for all passes."""

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _TermIds()
        for batch in batches:
            both = [text_terms(x, ids) for x in batch["text"]]
            yield pd.DataFrame({"document": batch["document"], "ids": [x[0] for x in both], "lengths": [x[1] for x in both]})

    rows = documents.select(F.col(document).cast("bigint").alias("document"), F.col(text).alias("text")).where("text IS NOT NULL")
    return written(rows.mapInPandas(tokenise, "document bigint, ids array<int>, lengths array<int>").where(F.size("lengths") > 0))


def in_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, few at a time: every term of a part gets a score for each leaf."""
    for batch in batches:
        for start in range(0, len(batch), DOCUMENTS_AT_ONCE):
            yield batch.iloc[start : start + DOCUMENTS_AT_ONCE]


def sentence_scores(batch: pd.DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences of a batch: their terms in one row, the sentence of each term, the scores, the document's place."""
    flat = np.concatenate(batch["ids"].tolist())
    lengths = np.concatenate(batch["lengths"].tolist())
    starts = np.cumsum(lengths) - lengths
    scores = np.add.reduceat(weights[:, flat], starts, axis=1)
    owner = np.repeat(np.arange(len(batch)), [len(x) for x in batch["lengths"]])
    return flat, np.repeat(np.arange(len(lengths)), lengths), scores, owner


def _log_odds(counts: np.ndarray, sizes: np.ndarray, smooth: float) -> np.ndarray:
    """Of each term in each class against all the others, shrunk towards zero for terms that are rare everywhere."""
    rest, rest_sizes = counts.sum(axis=0) - counts, sizes.sum() - sizes
    inside = (counts + smooth) / (sizes[:, None] + 2 * smooth)
    outside = (rest + smooth) / (rest_sizes[:, None] + 2 * smooth)
    return np.log(inside / outside) * (counts.sum(axis=0) / (counts.sum(axis=0) + 2 * smooth))


def _bounded_table(rows: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, term, n) as counts per class and term, and the sizes that stand under term -1: a table of fixed size.

    It comes as Arrow columns, 16 bytes a row, whatever the session's settings; rows as objects would take hundreds of MB.
    """
    table = rows.groupBy("class", "term").agg(F.sum("n").alias("n")).toArrow()
    of, term, n = (table[c].to_numpy() for c in ("class", "term", "n"))
    counts, sizes = np.zeros((classes, TERMS)), np.zeros(classes)
    whole = term < 0
    sizes[of[whole]] = n[whole]
    counts[of[~whole], term[~whole]] = n[~whole]
    return counts, sizes


@dataclass(frozen=True)
class SubjectModel:
    """Weight of each hashed term per leaf and per subject, and the leaves' mixtures of subjects (leaf by subject)."""

    leaf_terms: np.ndarray
    mixtures: np.ndarray
    terms: np.ndarray


def _weighing_terms(terms: DataFrame, documents: int) -> tuple[list[str], list[float]]:
    """The hashed terms of at least two documents, as text, and the logs of their inverse document frequencies.

    Only these have a place in the vectors: every centre that the clustering holds on the driver and sends to all tasks
    is as long as they are many, and a term of one document would weigh nothing there. There is one place at least.
    """
    frequent = terms.select(F.explode(F.array_distinct("ids")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").toArrow()
    term, n = frequent["term"].to_numpy(), frequent["n"].to_numpy()
    order = np.argsort(term)
    return [str(t) for t in term[order]] or ["0"], np.log((documents + 1) / (n[order] + 1)).tolist() or [0.0]


def _leaf_terms(terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents per leaf and hashed term, and per leaf, of a bisecting k-means over all documents."""
    documents = terms.count()
    if not documents:
        return np.zeros((1, TERMS)), np.zeros(1)
    names, inverse = _weighing_terms(terms, documents)
    counted = CountVectorizerModel.from_vocabulary(names, inputCol="words", outputCol="counts").transform(terms.select("ids", F.col("ids").cast("array<string>").alias("words"))).select("ids", "counts")
    weighed = ElementwiseProduct(scalingVec=Vectors.dense(inverse), inputCol="counts", outputCol="weighed").transform(counted)
    vectors = Normalizer(inputCol="weighed", outputCol="features").transform(weighed).select("ids", "features")
    model = BisectingKMeans(k=LEAVES, maxIter=ROUNDS, seed=7, featuresCol="features", predictionCol="class").fit(vectors)
    leaves = model.transform(vectors).select("class", F.explode(F.concat(F.array_distinct("ids"), F.array(F.lit(-1)))).alias("term"), F.lit(1).cast("bigint").alias("n"))
    return _bounded_table(leaves, LEAVES)


def leaf_mixtures(counts: np.ndarray, sizes: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """Subject mixture of each leaf from its discriminative terms; what is left to one belongs to no subject."""
    lift = _log_odds(counts, sizes, 1.0)
    telling = np.where((lift > 0.7) & (counts >= 3), lift, 0.0) * np.sqrt(counts)
    known = np.maximum(labelled, 0.0) * (labelled >= 1.5)
    votes = telling @ known.T
    weight = telling.sum(axis=1, keepdims=True) + 1e-9
    mixture = votes / weight
    return np.where(mixture > 0.25 * mixture.max(initial=1e-9), mixture / np.maximum(1.0, mixture.sum(axis=1, keepdims=True)), 0.0)


def leaf_term_weights(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each term for each leaf: its log-odds, where it is telling and not the chance of a few documents."""
    lift = _log_odds(counts, sizes, 1.0)
    return np.where((lift > 0.7) & (counts >= 3), lift, 0.0)


def fit_subjects(terms: DataFrame, examples: DataFrame, subject: str, example_text: str) -> tuple[list[str], SubjectModel]:
    """Names of the subjects and the model of the leaves and terms that tell them.

    The labelled texts name the leaves; what a term weighs at first is its log-odds between the leaves of a subject and
    all others, or between the labelled texts where the leaves agree, and after each counting pass its log-odds over
    the average score of a subject's sentences.

    ``terms``: the corpus as ``tokenised`` gives it. Examples with a null subject or text are left out.
    """
    told = examples.select(F.col(subject).alias("s"), F.col(example_text).alias("t")).where("s IS NOT NULL AND t IS NOT NULL").limit(LABELLED_TEXTS).collect()
    names = sorted({r["s"] for r in told})
    if not names:
        return [], SubjectModel(np.zeros((0, TERMS)), np.zeros((0, 0)), np.zeros((0, TERMS)))
    ids, seen, seen_sizes = _TermIds(), np.zeros((len(names), TERMS)), np.zeros(len(names))
    for row in told:
        flat, lengths = text_terms(row["t"], ids)
        np.add.at(seen[names.index(row["s"])], flat, 1)
        seen_sizes[names.index(row["s"])] += len(lengths)
    labelled = _log_odds(seen, seen_sizes, 0.5)
    leaf_counts, leaf_sizes = _leaf_terms(terms)
    mixtures = leaf_mixtures(leaf_counts, leaf_sizes, labelled)
    of_subject = np.vstack([mixtures.T @ leaf_counts, (1 - mixtures.sum(axis=1)) @ leaf_counts])
    subject_sizes = np.append(mixtures.T @ leaf_sizes, (1 - mixtures.sum(axis=1)) @ leaf_sizes)
    from_leaves = _log_odds(of_subject, subject_sizes, 2.0)[:-1]
    # What labelled texts say of a term counts as far as the leaves bear it out.
    told_too = (labelled >= 1.5) & (seen >= 2) & (from_leaves > 0)
    weights = np.where(told_too, labelled, np.where(from_leaves > TELLING, np.minimum(from_leaves, MOST_WEIGHT), 0.0))

    strong_from = STRONG
    for sure, unsure in (FIRST, *LATER):
        shared = terms.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

        def count_sentences(batches: Iterator[pd.DataFrame], shared=shared, sure=sure, unsure=unsure, strong_from=strong_from) -> Iterator[pd.DataFrame]:
            weights, total, sizes = shared.value, np.zeros((len(names) + 1, TERMS), dtype=np.int64), np.zeros(len(names) + 1, dtype=np.int64)
            for batch in in_parts(batches):
                flat, sentence, scores, _ = sentence_scores(batch, weights)
                best = scores.argmax(axis=0)
                top = scores.max(axis=0)
                second = np.partition(scores, -2, axis=0)[-2] if len(names) > 1 else np.zeros_like(top)
                strong = np.bincount(sentence, weights=weights[best[sentence], flat] >= strong_from, minlength=len(top))
                label = np.where((strong >= 2) & (top >= sure) & (top - second >= sure / 2), best, -1)
                label = np.where((label < 0) & (top < unsure) & ((strong <= 1) | (sure != FIRST[0])), len(names), label)
                used = label[sentence] >= 0
                np.add.at(total, (label[sentence][used], flat[used]), 1)
                np.add.at(sizes, label[label >= 0], 1)
            at = np.nonzero(total)
            yield pd.DataFrame({"class": [*at[0], *range(len(sizes))], "term": [*at[1], *[-1] * len(sizes)], "n": [*total[at], *sizes]})

        counts, sizes = _bounded_table(terms.select("ids", "lengths").mapInPandas(count_sentences, "class int, term int, n bigint"), len(names) + 1)
        inside = (counts[:-1] + 0.3) / (sizes[:-1, None] + 0.6)
        none = (counts[-1] + 0.3) / (sizes[-1] + 0.6)
        weights = np.where(counts.sum(axis=0) >= 4, np.clip(np.log(inside / none), -3.0, 5.0), 0.0)
        average = max(1e-9, (counts[:-1] * weights).sum() / max(1.0, sizes[:-1].sum()))
        weights, strong_from = weights / average, STRONG / average
    return names, SubjectModel(leaf_term_weights(leaf_counts, leaf_sizes), mixtures, weights)


def leaf_mixture_of_documents(batch: pd.DataFrame, leaf_terms: np.ndarray, mixtures: np.ndarray) -> np.ndarray:
    """Subject mixture of each document of a batch: the mean over its sentences of the mixture of the sentence's leaf.

    A sentence without a telling term of any leaf adds nothing.
    """
    _, _, scores, owner = sentence_scores(batch, leaf_terms)
    told = scores.max(axis=0) > 0
    out = np.zeros((len(batch), mixtures.shape[1]))
    np.add.at(out, owner[told], mixtures[scores.argmax(axis=0)[told]])
    return out / np.bincount(owner, minlength=len(batch))[:, None]


def document_subjects(terms: DataFrame, names: list[str], model: SubjectModel, least_share: float = 1 / 3) -> DataFrame:
    """document, subject, share: every subject that at least ``least_share`` of a document's sentences is about.

    Documents without a sentence, null or empty, have no subject; neither have any if there are no labelled texts.
    Repeated rows of a document come out once. A sentence counts for one subject at most, the one it leads by; ties
    between subjects count for the first by name.
    """
    if not names:
        return terms.sparkSession.createDataFrame([], "document bigint, subject string, share double")
    shared = terms.sparkSession.sparkContext.broadcast((model.leaf_terms.astype(np.float32), model.mixtures.astype(np.float32), model.terms.astype(np.float32)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf_terms, mixtures, weights = shared.value
        for batch in in_parts(batches):
            _, _, scores, owner = sentence_scores(batch, weights)
            proposed = leaf_mixture_of_documents(batch, leaf_terms, mixtures) >= PROPOSED * least_share
            about = np.zeros((len(batch), len(names)))
            lead = scores.max(axis=0) >= LEAD
            np.add.at(about, (owner[lead], scores.argmax(axis=0)[lead]), 1)
            share = about / np.bincount(owner, minlength=len(batch))[:, None]
            row, k = np.nonzero(proposed & (share >= least_share - 1e-9) & (about > 0))
            yield pd.DataFrame({"document": batch["document"].to_numpy()[row], "subject": np.array(names, dtype=object)[k], "share": share[row, k]})

    judged = terms.where("document IS NOT NULL").mapInPandas(judge, "document bigint, subject string, share double")
    return judged.groupBy("document", "subject").agg(F.max("share").alias("share"))
