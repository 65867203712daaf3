import random

import numpy as np

from seismark.llm import subjects
from seismark.llm.subjects import TERMS as TERMS_HASHED
from seismark.llm.subjects import SubjectModel, _leaf_terms, document_subjects, fit_subjects, sentences, tokenised

TERMS = {
    "sport": (["The captain", "A striker", "Two substitutes", "The referee", "Our goalkeeper"], ["won", "lost", "postponed", "dominated"], ["the derby", "a penalty", "the marathon", "the second leg", "the semifinal"]),
    "law": (["The judge", "A prosecutor", "The tribunal", "Defence counsel", "The ombudsman"], ["upheld", "dismissed", "adjourned", "contested"], ["the appeal", "an indictment", "the warrant", "the lawsuit", "the subpoena"]),
}
PLAIN = (["Rescuers", "Local police", "Neighbours", "The army", "Aid workers"], ["searched", "closed", "reached", "opened"], ["the bus depot", "the annex", "two roads", "the village hall", "the ruined shops"])
TAILS = ["while rain kept falling", "by midday", "with little notice", "despite the weather"]


def sentence(rng, parts):
    return f"{rng.choice(parts[0])} {rng.choice(parts[1])} {rng.choice(parts[2])} {rng.choice(TAILS)}."


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(1)
    examples = [(s, " ".join(sentence(rng, p) for _ in range(4))) for s, p in TERMS.items() for _ in range(6)]
    docs, truth = [], {}
    for i in range(400):
        kinds = [["sport"], ["law"], ["sport", "law"], []][i % 4]
        body = [sentence(rng, TERMS[k]) for k in kinds for _ in range(5)] + [sentence(rng, PLAIN) for _ in range(4 if kinds else 8)]
        if not kinds:
            body.append(sentence(rng, TERMS["law"]))  # a passing mention
        rng.shuffle(body)
        docs.append((i, " ".join(body), "other"))
        truth[i] = set(kinds)
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "!!! 123", "x"), docs[0]]
    frame = spark.createDataFrame(docs, "doc bigint, body string, ids string")
    terms = tokenised(frame, "doc", "body")
    names, weights = fit_subjects(terms, spark.createDataFrame([*examples, (None, "x"), ("law", None)], "s string, t string"), "s", "t")
    rows = document_subjects(terms, names, weights).collect()
    got = {}
    for r in rows:
        got.setdefault(r["document"], set()).add(r["subject"])
    assert names == ["law", "sport"] and len(rows) == len({(r["document"], r["subject"]) for r in rows})
    assert sum(got.get(i, set()) == truth[i] for i in truth) >= 0.98 * len(truth)
    assert not {1000, 1001, 1002} & set(got)
    assert fit_subjects(terms, frame.limit(0).selectExpr("body AS s", "body AS t"), "s", "t")[0] == []
    assert document_subjects(terms.limit(0), names, weights).count() == 0


def test_sentences():
    assert sentences('"One ended." Two followed!\nThree') == ['"One ended.', "Two followed!", "Three"]


def test_leaves_decide(spark, monkeypatch):
    rng = random.Random(2)
    examples = [(s, " ".join(sentence(rng, p) for _ in range(4))) for s, p in TERMS.items() for _ in range(6)]
    kinds = [TERMS["sport"], TERMS["law"], PLAIN]
    docs = [(i, " ".join(sentence(rng, kinds[i % 3]) for _ in range(5)) + " " + sentence(rng, PLAIN)) for i in range(300)]
    terms = tokenised(spark.createDataFrame(docs, "doc bigint, body string"), "doc", "body")
    told = spark.createDataFrame(examples, "s string, t string")
    names, model = fit_subjects(terms, told, "s", "t")
    assert document_subjects(terms, names, model).count() == 200
    # Leaves that belong to the other subject propose it, and the sentences do not bear it out.
    turned = SubjectModel(model.leaf_terms, model.mixtures[:, ::-1], model.terms)
    assert document_subjects(terms, names, turned).count() < 40
    monkeypatch.setattr("seismark.llm.subjects._leaf_terms", lambda _: (np.zeros((1, TERMS_HASHED)), np.zeros(1)))
    names, model = fit_subjects(terms, told, "s", "t")
    assert document_subjects(terms, names, model).count() == 0


def test_documents_without_a_subject_alone(spark):
    rng = random.Random(3)
    examples = [(s, " ".join(sentence(rng, p) for _ in range(4))) for s, p in TERMS.items() for _ in range(6)]
    docs = [(i, " ".join(sentence(rng, PLAIN) for _ in range(5))) for i in range(60)]
    terms = tokenised(spark.createDataFrame(docs, "doc bigint, body string"), "doc", "body")
    names, model = fit_subjects(terms, spark.createDataFrame(examples, "s string, t string"), "s", "t")
    assert document_subjects(terms, names, model).count() == 0


def test_tables_reach_the_driver_as_columns_and_centres_have_no_empty_places(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(sentence(rng, [TERMS["sport"], TERMS["law"]][i % 2]) for _ in range(4)) + f" Once{i} stood here.") for i in range(60)]
    terms = tokenised(spark.createDataFrame(docs, "doc bigint, body string"), "doc", "body")
    lengths = []

    def fit(self, vectors, params=None, fit=subjects.BisectingKMeans.fit):
        lengths.append(vectors.first()["features"].size)
        return fit(self, vectors)

    def rows(self):
        raise AssertionError("rows as objects on the driver")

    monkeypatch.setattr(subjects.BisectingKMeans, "fit", fit)
    monkeypatch.setattr(type(terms), "toPandas", rows)
    counts, sizes = _leaf_terms(terms)
    documents = {}
    for _, text in docs:
        for term in set(subjects.text_terms(text, subjects._TermIds())[0]):
            documents[term] = documents.get(term, 0) + 1
    assert lengths == [sum(n >= 2 for n in documents.values())] and sizes.sum() == len(docs)
    assert {t: counts[:, t].sum() for t in np.flatnonzero(counts.sum(axis=0))} == documents
    alone = tokenised(spark.createDataFrame([(1, "Nothing recurs.")], "doc bigint, body string"), "doc", "body")
    assert _leaf_terms(alone)[1].sum() == 1
