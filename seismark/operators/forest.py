"""A random forest on sparse vectors: the rows lie in the shared folder as packed blocks, and each task grows some trees.

A split node looks at a random part of the features, of which a sparse row holds hardly any. One pass over the entries of
a level finds those that its nodes look at, and only they are sorted; rows without an entry are the lower side of it. No
dense table of rows by features is made, and no tree leaves its task: the rows to be judged are judged there, and the
classes' shares are summed over the trees.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.operators.models import MOST_CLASSES, balanced_weights
from seismark.session import cut_lineage, shared_folder

#: Cells of the table of features that the nodes of one pass look at.
CELLS_AT_ONCE = 1 << 26
#: Entries that are looked at together, few enough for a core's cache, and the share of their rows that are in question
#: below which these are looked up one by one.
ENTRIES_AT_ONCE, LIVE_SHARE = 1 << 18, 0.3
#: Tasks for each core that grow trees.
TASKS_PER_CORE = 3


class Block:
    """Rows of one packed block: entries of row i are ``starts[i]`` to ``starts[i + 1]``, features ascending, no zeros."""

    def __init__(self, folder: str, name: str) -> None:
        self.starts, self.feature, self.value, self.counts, self.record = (np.asarray(_read(f"{folder}/{name}-{part}.npy")) for part in ("starts", "feature", "value", "counts", "record"))


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _read(path: str) -> np.ndarray:
    """An array of the shared folder: mapped where the folder is a file system of this machine, else read."""
    from pyarrow import fs

    system, at = _at(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(at, mmap_mode="r")
    with system.open_input_file(at) as file:
        return np.load(file)


def packed(rows: DataFrame, record: str, features: str, counts: str, classes: int) -> tuple[str, list[str]]:
    """The folder and the names of blocks, one per task, of ``rows``: a string, a sparse vector, an array of whole numbers."""
    folder = f"{shared_folder(rows.sparkSession)}/blocks-{uuid.uuid4().hex}"
    held = F.unwrap_udt(features)
    every = F.sequence(F.lit(0), F.size(held["values"]) - 1)  # a dense vector names no features
    plain = rows.select(F.col(record).cast("string").alias("record"), F.coalesce(held["indices"], every).alias("feature"), held["values"].alias("value"), F.col(counts).cast("array<int>").alias("counts"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, feature, value, count, names = [], [], [], [], []
        for batch in batches:
            owner = np.repeat(np.arange(len(batch)), batch["feature"].map(len).to_numpy(dtype=np.int64))
            one = np.concatenate([*batch["value"], np.zeros(0)]).astype(np.float32)
            sizes.append(np.bincount(owner[one != 0], minlength=len(batch)))
            feature.append(np.concatenate([*batch["feature"], np.zeros(0, dtype=np.int32)]).astype(np.int32)[one != 0])
            value.append(one[one != 0])
            count.append(np.array(batch["counts"].tolist(), dtype=np.int32).reshape(-1, classes))
            names.append(np.char.encode(batch["record"].to_numpy(dtype="U"), "utf-8"))
        if not sum(map(len, sizes)):
            return
        name = uuid.uuid4().hex
        parts = {"starts": np.append(0, np.cumsum(np.concatenate(sizes))), "feature": np.concatenate(feature), "value": np.concatenate(value), "counts": np.concatenate(count), "record": np.concatenate(names)}
        for part, array in parts.items():
            system, at = _at(f"{folder}/{name}-{part}.npy")
            system.create_dir(at.rsplit("/", 1)[0])
            with system.open_output_stream(at) as file:
                np.save(file, array)
        yield pd.DataFrame({"name": [name]})

    # A task that is tried again writes under another name; only the names that arrive are read. One per task is collected.
    return folder, sorted(r[0] for r in plain.mapInPandas(pack, "name string").collect())


class Tree:
    """Nodes in order of their making: the feature asked (-1 in a leaf), the limit, the left child (the right one follows)
    and the classes' shares."""

    def __init__(self, classes: int) -> None:
        self.feature, self.limit, self.left = (np.zeros(0, dtype=t) for t in (np.int32, np.float32, np.int64))
        self.shares = np.zeros((0, classes), dtype=np.float32)

    def add(self, held: np.ndarray) -> None:
        n = len(held)
        self.feature = np.append(self.feature, np.full(n, -1, dtype=np.int32))
        self.limit, self.left = np.append(self.limit, np.zeros(n, dtype=np.float32)), np.append(self.left, np.zeros(n, dtype=np.int64))
        self.shares = np.concatenate([self.shares, (held / np.maximum(held.sum(axis=1, keepdims=True), 1e-300)).astype(np.float32)])

    def judged(self, block: Block) -> np.ndarray:
        """The shares of each row's leaf."""
        starts = block.starts
        node, live = np.zeros(len(starts) - 1, dtype=np.int64), np.arange(len(starts) - 1)
        while True:
            live = live[self.feature[node[live]] >= 0]
            if not len(live):
                return self.shares[node]
            want = self.feature[node[live]]
            low, high = starts[live].copy(), starts[live + 1].copy()
            while (open_ := low < high).any():
                middle = (low + high) >> 1
                less = open_ & (block.feature[np.minimum(middle, len(block.feature) - 1)] < want)
                low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
            at = np.minimum(low, len(block.feature) - 1)
            value = np.where((low < starts[live + 1]) & (block.feature[at] == want), block.value[at], 0)
            node[live] = self.left[node[live]] + (value > self.limit[node[live]])


def _looked_at(rng: np.random.Generator, nodes: int, features: int, some: int) -> np.ndarray:
    """For each node a row with True at ``some`` different features."""
    out, row = np.zeros((nodes, features), dtype=bool), np.arange(nodes)
    for last in range(features - some, features):
        drawn = rng.integers(0, last + 1, nodes)
        out[row, np.where(out[row, drawn], last, drawn)] = True
    return out


def _entries(blocks: list[Block], offsets: np.ndarray, node: np.ndarray, first: int, looked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node (from ``first`` on) times features plus feature, value and row of the entries that their nodes look at."""
    keys, values, rows = [], [], []
    features = looked.shape[1]
    flat = np.append(looked.ravel(), np.zeros(features, dtype=bool))  # the last node stands for rows that are elsewhere
    kind = np.int32 if len(flat) < 2**31 else np.int64
    for block, offset in zip(blocks, offsets):
        starts = block.starts
        mine = node[offset : offset + len(starts) - 1] - first
        live = (mine >= 0) & (mine < len(looked))
        base = (np.where(live, mine, len(looked)) * features).astype(kind)
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], ENTRIES_AT_ONCE)), len(starts) - 1))
        for low, high in zip(cuts[:-1], cuts[1:]):
            some = low + np.flatnonzero(live[low:high])
            if len(some) < LIVE_SHARE * (high - low):
                n = starts[some + 1] - starts[some]
                at = np.arange(n.sum()) + np.repeat(starts[some] - np.cumsum(n) + n, n)
                key = np.repeat(base[some], n) + block.feature[at]
                hit = np.flatnonzero(flat[key])
                place = at[hit]
            else:
                key = np.repeat(base[low:high], starts[low + 1 : high + 1] - starts[low:high])
                key += block.feature[starts[low] : starts[high]]
                hit = np.flatnonzero(flat[key])
                place = hit + starts[low]
            keys.append(key[hit].astype(np.int64))
            values.append(block.value[place])
            rows.append(np.searchsorted(starts, place, side="right") - 1 + offset)
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(values), np.concatenate(rows)


def _best_splits(key: np.ndarray, value: np.ndarray, row: np.ndarray, weight: np.ndarray, total: np.ndarray, features: int):
    """(node, feature, limit) of the split of each node that lowers the Gini impurity most, and (node, row) of the entries
    above the limit. ``weight``: rows by classes, ``total``: nodes by classes; nodes that no split helps are left out."""
    order = np.lexsort((value, key))
    key, value, row = key[order], value[order], row[order]
    opens = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(opens) - 1
    ends = np.append(np.flatnonzero(opens)[1:], len(key))[group]
    node = key // features
    sums, squares = np.zeros((2, len(key))), np.zeros((2, len(key)))
    for c in range(weight.shape[1]):
        upto = np.append(0.0, np.cumsum(weight[row, c], dtype=np.float64))
        above = upto[ends] - upto[:-1]
        below = total[node, c] - above
        for side, x in enumerate((below, above)):
            sums[side] += x
            squares[side] += x * x
    whole = total.sum(axis=1)
    least = 1e-9 * whole[node]
    before = np.where(opens, 0, np.append(0, value[:-1])).astype(np.float32)
    limit = ((before.astype(np.float64) + value) / 2).astype(np.float32)
    fine = (sums[0] > least) & (sums[1] > least) & (before <= limit) & (limit < value)
    both = np.where(fine, (squares / np.maximum(sums, 1e-300)).sum(axis=0), -1.0)
    start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    most = np.maximum.reduceat(both, start)
    asked = node[start]
    helps = most > (total[asked] ** 2).sum(axis=1) / whole[asked] * (1 + 1e-9)
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    won = np.flatnonzero(both == most[run])
    won = won[np.append(True, run[won][1:] != run[won][:-1])][helps]
    sizes = ends[won] - won
    over = np.arange(sizes.sum()) + np.repeat(won - np.cumsum(sizes) + sizes, sizes)
    return node[won], (key[won] % features).astype(np.int32), limit[won], node[over], row[over]


def grown(blocks: list[Block], features: int, class_weights: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """One tree on a bootstrap sample of all rows of ``blocks``."""
    sizes = [len(b.starts) - 1 for b in blocks]
    offsets = np.append(0, np.cumsum(sizes))
    weight = np.concatenate([rng.poisson(b.counts) for b in blocks]).astype(np.float32) * class_weights.astype(np.float32)
    node = np.where(weight.sum(axis=1) > 0, 0, -1)  # of the nodes of this level
    tree, some = Tree(weight.shape[1]), min(features, math.ceil(math.sqrt(features)))
    total = weight.sum(axis=0, dtype=np.float64)[None, :]
    tree.add(total)
    ids = np.zeros(1, dtype=np.int64)
    for _ in range(depth):
        # Only nodes of several classes go on.
        mixed = (total > 0).sum(axis=1) > 1
        place = np.append(np.where(mixed, np.cumsum(mixed) - 1, -1), -1)
        node, ids, total = place[node], ids[mixed], total[mixed]
        if not len(ids):
            break
        step, kept = max(1, CELLS_AT_ONCE // features), []
        child = np.full(len(ids), -1, dtype=np.int64)
        up = np.zeros(len(node), dtype=bool)
        for first in range(0, len(ids), step):
            looked = _looked_at(rng, min(step, len(ids) - first), features, some)
            key, value, row = _entries(blocks, offsets, node, first, looked)
            if len(key):
                at, feature, limit, _, above = _best_splits(key, value, row, weight, total[first : first + step], features)
                at = at + first
                tree.feature[ids[at]], tree.limit[ids[at]] = feature, limit
                up[above] = True
                kept.append(at)
        split = np.concatenate([*kept, np.zeros(0, dtype=np.int64)])
        if not len(split):
            break
        child[split] = 2 * np.arange(len(split))
        node = np.where(node >= 0, child[node], -1)
        node = np.where(node >= 0, node + up, -1)
        live = node >= 0
        total = np.stack([np.bincount(node[live], weight[live, c], 2 * len(split)) for c in range(weight.shape[1])], axis=1)
        tree.left[ids[split]] = len(tree.feature) + child[split]
        ids = len(tree.feature) + np.arange(2 * len(split))
        tree.add(total)
    return tree


def sparse_forest(rows: DataFrame, vectors: DataFrame, key: str, document: str, label: str, trees: int = 200, seed: int = 12, depth: int = 30) -> DataFrame:
    """key, label, prediction of a random forest fitted on the rows without is_test, for those with it.

    ``rows`` holds key, document, label and is_test, ``vectors`` document and features (no value below zero). Classes are
    balanced. Each tree sees a bootstrap sample of all training rows, and every split the square root of the number of
    features; limits lie between any two values of a node, not between bins. Ties go to the lesser class.
    """
    spark = rows.sparkSession
    rows = balanced_weights(rows.select(key, document, F.col(label).cast("double").alias(label), "is_test"), label)
    told = sorted((r[label], r["weight"]) for r in rows.select(label, "weight").distinct().limit(MOST_CLASSES + 1).collect())
    if len(told) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    first = vectors.select(F.unwrap_udt("features").alias("v")).first()
    if not told or first is None:
        return rows.where("is_test").select(key, label, F.lit(None).cast("double").alias("prediction"))
    features = first["v"]["size"] if first["v"]["size"] is not None else len(first["v"]["values"])
    classes, scale = [c for c, _ in told], np.array([w for _, w in told])
    counts = F.array(*[F.count_if(F.col(label) == c) for c in classes]).alias("counts")
    train = rows.where("NOT is_test").groupBy(document).agg(counts).join(vectors, document)
    asked = rows.where("is_test").select(document).distinct().join(vectors, document).withColumn("counts", F.array(*[F.lit(0) for _ in classes]))
    (folder, names), (asked_folder, asked_names) = (packed(x, document, "features", "counts", len(classes)) for x in (train, asked))
    columns = [f"share{i}" for i in range(len(classes))]

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = [int(t) for batch in batches for t in batch["id"]]
        if not mine or not names:
            return
        held, test = [Block(folder, n) for n in names], [Block(asked_folder, n) for n in asked_names]
        sums = [np.zeros((len(b.record), len(classes)), dtype=np.float32) for b in test]
        for t in mine:
            tree = grown(held, features, scale, depth, np.random.default_rng([seed, t]))
            for block, out in zip(test, sums):
                out += tree.judged(block)
        for block, out in zip(test, sums):
            for at in range(0, len(out), 10_000):
                part = pd.DataFrame(out[at : at + 10_000].astype(np.float64), columns=columns)
                part.insert(0, document, np.char.decode(block.record[at : at + 10_000], "utf-8").astype(object))
                yield part

    tasks = min(trees, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    shares = spark.range(0, trees, 1, tasks).mapInPandas(grow, f"{document} string, " + ", ".join(f"{c} double" for c in columns))
    # Growing is long: it is done once, whatever the plan above it does.
    summed = cut_lineage(shares.groupBy(document).agg(*[F.sum(c).alias(c) for c in columns]))
    best = F.array_max(F.array(*[F.struct(F.round(c, 6).alias("share"), F.lit(-k).alias("turn"), F.lit(x).alias("class")) for k, (c, x) in enumerate(zip(columns, classes))]))["class"]
    return rows.where("is_test").select(key, document, label).join(summed.select(document, best.alias("prediction")), document).select(key, label, "prediction")
