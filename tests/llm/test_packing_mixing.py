import os
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seismark.llm.mixing import mix_report, mix_sources
from seismark.llm.packing import best_fit, complete_bins, pack_documents, packing_report, undominated_fillings
from seismark.llm.tokens import TOKENIZER_FILE, token_counts


def least_bins(sizes, capacity):
    """Fewest containers by exhaustive search over subsets."""
    sizes = tuple(sorted(sizes, reverse=True))
    if not sizes:
        return 0
    best = len(sizes)
    first, rest = sizes[0], range(1, len(sizes))
    for n in range(len(sizes)):
        for chosen in combinations(rest, n):
            if first + sum(sizes[i] for i in chosen) <= capacity:
                left = [sizes[i] for i in rest if i not in chosen]
                best = min(best, 1 + least_bins(left, capacity))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bin_completion_is_optimal_on_small_input(sizes):
    bins = complete_bins(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 20 for b in bins) and len(bins) == least_bins(sizes, 20)


def test_bin_completion_beats_best_fit_where_it_can():
    sizes = [44, 44, 44, 32, 32, 24, 24, 24, 16, 16] * 3
    assert len(complete_bins(sizes, 100)) <= len(best_fit(sizes, 100))


def holds(filling, other):
    """Whether the documents of ``other`` can be put into those of ``filling`` as containers."""

    def put(k, rooms):
        return k == len(other) or any(room >= other[k] and put(k + 1, [*rooms[:j], room - other[k], *rooms[j + 1 :]]) for j, room in enumerate(rooms))

    return put(0, list(filling))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8), st.integers(1, 25))
def test_fillings_are_all_undominated_ones(sizes, room):
    fitting = {tuple(sorted(c)) for n in range(len(sizes) + 1) for c in combinations(sizes, n) if sum(c) <= room}
    undominated = {b for b in fitting if not any(a != b and holds(a, b) for a in fitting)}
    found = list(undominated_fillings([sizes.count(n) for n in range(26)], room, lambda: True))
    assert sorted(tuple(sorted(f)) for _, f in found) == sorted(undominated)
    assert [w for w, _ in found] == sorted(room - sum(f) for _, f in found)


def test_bin_completion_needs_more_than_the_first_fillings():
    sizes = [416, 406, 367, 420, 242, 355, 363, 253, 389, 291, 392, 223, 333, 324, 360, 245, 292, 232]
    assert len(complete_bins(sizes, 1000)) == 6  # the lower bound; 7 with 120 steps, 12 fillings and 6 branches


def test_packing_keeps_every_document_whole(spark):
    rows = [(i, 1 + (i * 37) % 300) for i in range(3000)] + [(5000, 2500), (5001, 1000), (5002, 2000), (5003, 0), (5004, None), (7, 12)]
    df = spark.createDataFrame([(i, n, "x") for i, n in rows], "doc bigint, n bigint, container string")
    placed = pack_documents(df, "doc", "n", 1000, group_tokens=50_000)
    out = placed.toPandas()
    assert out["tokens"].sum() == sum(n or 0 for _, n in rows)
    filled = out.dropna(subset=["container"]).groupby("container")["tokens"].sum()
    assert filled.max() <= 1000
    assert out[out["doc"] == 5000]["tokens"].tolist().count(1000) == 2 and set(out[out["tokens"] < 1000].query("doc < 5000").groupby("doc").size()) <= {1, 2}
    report = packing_report(placed, 1000).first()
    assert report["fill"] > 0.99 and report["containers"] >= report["least_containers"]
    assert pack_documents(df.limit(0), "doc", "n", 1000).count() == 0


def test_repeated_long_documents_share_no_container(spark):
    df = spark.createDataFrame([(1, 250), (1, 250), (2, 40), *[(3, 7)] * 50], "doc bigint, n bigint")
    placed = pack_documents(df, "doc", "n", 100, group_tokens=200)
    assert placed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] <= 100
    report = packing_report(placed, 100).first()
    assert report["tokens"] == 250 * 2 + 40 + 350 and report["containers"] >= report["least_containers"]


def test_exact_without_a_budget():
    sizes = [7, 6, 5, 4, 4, 3, 3, 2, 9, 8, 1]
    assert len(complete_bins(sizes, 13, nodes=None, steps=None)) == least_bins(sizes, 13)


def test_mixing_reaches_its_shares(spark):
    rows = [(i, s, 20 + (i * 53) % 400) for i, s in enumerate(["a"] * 1500 + ["b"] * 300 + ["c"] * 900)] + [(9000, None, 5), (9001, "other", 5), (9002, "a", None), (9003, "a", 0)]
    df = spark.createDataFrame([(i, s, n, 1) for i, s, n in rows], "doc bigint, src string, n bigint, copies int").drop("copies")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(df, "doc", "src", "n", targets)
    assert mixed.count() == len(rows)
    for r in mix_report(mixed, "src", "n", targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.01 and r["most_copies"] <= r["max_repeats"]
    assert mixed.where("src = 'other' OR src IS NULL OR n IS NULL").agg(F.sum("copies")).first()[0] == 0
    tilted = {r["n"]: r["rate"] for r in mixed.where("src = 'c' AND rate > 0").select("n", "rate").distinct().collect()}
    assert len({round(v, 12) for v in tilted.values()}) > 10  # rates follow the size
    assert mix_sources(df.limit(0), "doc", "src", "n", targets).count() == 0


def test_token_counts_cover_whole_texts(spark):
    if not os.path.exists(TOKENIZER_FILE):
        pytest.skip("no tokenizer file")
    df = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None), (4, "one two three " * 5000), (5, "<|endoftext|>")], "i bigint, text string")
    got = {r["i"]: r["tokens"] for r in token_counts(df, "text").collect()}
    assert got[1] == 3 and got[2] == 0 and got[3] is None and got[4] >= 15_000 and got[5] > 1
