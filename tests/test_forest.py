import inspect

import numpy as np
from pyspark.ml.linalg import Vectors

from seismark.operators import forest, models


class Rows:
    def __init__(self, table, counts):
        at = [np.flatnonzero(r) for r in table]
        self.starts = np.append(0, np.cumsum([len(x) for x in at]))
        self.feature, self.value = np.concatenate(at).astype(np.int32), np.concatenate([r[x] for r, x in zip(table, at)]).astype(np.float32)
        self.counts, self.record = counts, np.arange(len(table))


def made(n=60, features=7, seed=3):
    rng = np.random.default_rng(seed)
    table = np.where(rng.random((n, features)) < 0.4, rng.integers(1, 5, (n, features)), 0).astype(np.float32)
    return table, rng.multinomial(2, [0.5, 0.3, 0.2], n).astype(np.int32)


def gini_left(weight, side):
    return sum((weight[x].sum(axis=0) ** 2).sum() / weight[x].sum() for x in (side, ~side))


def test_split_equals_brute_force():
    table, counts = made()
    weight = counts.astype(np.float32)
    node = np.arange(len(table)) % 2
    blocks = [Rows(table[:25], counts[:25]), Rows(table[25:], counts[25:])]
    entries = forest._entries(blocks, np.array([0, 25, 60]), node, 0, np.ones((2, 7), dtype=bool))
    total = np.stack([weight[node == k].sum(axis=0) for k in (0, 1)]).astype(float)
    at, feature, limit, _, above = forest._best_splits(*entries, weight, total, 7)
    assert at.tolist() == [0, 1]
    for k in (0, 1):
        mine = np.flatnonzero(node == k)
        best = max(gini_left(weight[mine], table[mine, f] > x) for f in range(7) for x in np.unique(table[mine, f])[:-1])
        assert abs(gini_left(weight[mine], table[mine, feature[k]] > limit[k]) - best) < 1e-4
        assert sorted(above[node[above] == k]) == mine[table[mine, feature[k]] > limit[k]].tolist()


def test_whole_tree_knows_its_sample_and_cuts_change_nothing(monkeypatch):
    table, counts = made(400, 30, 5)
    trees = []
    for entries, live in ((1 << 18, 0.3), (50, 2.0)):
        monkeypatch.setattr(forest, "ENTRIES_AT_ONCE", entries)
        monkeypatch.setattr(forest, "LIVE_SHARE", live)
        tree = forest.grown([Rows(table[:100], counts[:100]), Rows(table[100:], counts[100:])], 30, np.ones(3), 30, np.random.default_rng(1))
        trees.append(tree)
    assert (trees[0].feature == trees[1].feature).all() and (trees[0].limit == trees[1].limit).all()
    node = np.zeros(len(table), dtype=int)
    for _ in range(31):
        node = np.where(trees[0].feature[node] >= 0, trees[0].left[node] + (table[np.arange(len(table)), trees[0].feature[node]] > trees[0].limit[node]), node)
    assert (trees[0].shares[node] == trees[0].judged(Rows(table, counts))).all() and len(trees[0].feature) > 50


def test_forest_on_sparse_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **given: 1 / 0)
    rng, cells, rows = np.random.default_rng(2), [], []
    for d in range(400):
        at = sorted({int(x) for x in rng.integers(10, 60, 8)} | ({3} if d % 3 == 0 else {7} if d % 3 == 1 else set()))
        cells.append((f"d{d}", Vectors.sparse(60, at, [1.0 + float(x) for x in rng.random(len(at))])))
        rows += [(2 * d + k, f"d{d}", d % 3, d % 4 == 0) for k in (0, 1)]
    got = forest.sparse_forest(spark.createDataFrame(rows, "key bigint, document string, label int, is_test boolean"), spark.createDataFrame(cells, ["document", "features"]), "key", "document", "label", trees=60).collect()
    assert sorted(r["key"] for r in got) == [k for k, _, _, t in rows if t]
    assert sum(r["label"] == r["prediction"] for r in got) > 0.95 * len(got)


def test_articles_forest_makes_no_dense_rows_and_keeps_its_size(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(models, "RandomForestClassifier", lambda **given: 1 / 0)
    given = inspect.signature(forest.sparse_forest).parameters
    assert (given["trees"].default, given["depth"].default) == (200, 30)
    got = entry.queries()["rf_impact_articles"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 33 and got["prediction"].between(0, 5).all()
