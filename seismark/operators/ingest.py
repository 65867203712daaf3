"""Links to articles: fetch tasks, keep-first, strata, samples, offsets, batches and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seismark.session import broadcast_if_small, cut_lineage

#: Leading hex digits of a hash by which a group is counted in buckets, and the buckets that are broadcast at most.
BUCKET_DIGITS, BROADCAST_BUCKETS = 3, 2_000_000


def month_tasks(first: Column, last: Column, today: Column) -> Column:
    """Array of (month_start, month_end) from the month of ``first`` to that of ``last``, ends capped at ``today``."""
    starts = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.transform(starts, lambda m: F.struct(m.alias("month_start"), F.least(F.last_day(m), today).alias("month_end")))


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per non-null key, the least by ``order``, found by aggregation so that a hot key is combined map-side."""
    rest = [c for c in df.columns if c not in (key, *order)]
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("row"))
    return least.select(key, "row.*").select(*df.columns)


def strata_sample_sizes(df: DataFrame, strata: list[str], weight: Column, total: int) -> DataFrame:
    """Rows per stratum and its sample size: size times weight over their sum times ``total``, rounded half to even."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size")).withColumn("weighted", F.col("stratum_size") * weight)
    whole = sizes.agg(F.sum("weighted").alias("all_weighted"))
    share = F.col("weighted") / F.col("all_weighted") * total
    return sizes.crossJoin(F.broadcast(whole)).select(*strata, "stratum_size", F.bround(share, 0).cast("bigint").alias("sample_size"))


def first_by_hash(df: DataFrame, group: list[str], limits: DataFrame | None, limit: Column, key: Column, seed: int, name: str) -> DataFrame:
    """``df`` plus a boolean: whether a row is among the first of its group in the order of a seeded hash of ``key``.

    ``limit`` is an expression on ``_size``, the rows of the group, and the columns of ``limits``, which has one row per
    group; groups it leaves out, and limits of null, have none. The rows are counted per group and leading digits of
    the hash, and only those of the one bucket in which the limit falls are put in order, so a group may hold any share
    of the table. Nulls in the group's columns are values like others.
    """
    code = F.md5(F.concat(key, F.lit(str(seed))))
    coded = df.withColumns({"_key": key, "_code": code, "_bucket": F.coalesce(F.substring(code, 1, BUCKET_DIGITS), F.lit(""))})
    counts = coded.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    facts = counts.select("*", before.alias("_before"), F.sum("_n").over(whole).alias("_size"))
    marked = [f"_group{i}" for i in range(len(group))]
    facts = facts.withColumnsRenamed({**dict(zip(group, marked)), "_bucket": "_of_bucket"})
    if limits is not None:
        facts = facts.join(limits, [F.col(m).eqNullSafe(F.col(c)) for m, c in zip(marked, group)])
    facts = facts.select(*marked, "_of_bucket", (F.coalesce(limit, F.lit(0)) - F.col("_before")).alias("_left"), "_n")
    facts = broadcast_if_small(cut_lineage(facts), BROADCAST_BUCKETS)
    same = [F.col(c).eqNullSafe(F.col(m)) for c, m in zip((*group, "_bucket"), (*marked, "_of_bucket"))]
    met = coded.join(facts, same, "left").drop(*marked, "_of_bucket").withColumn("_left", F.coalesce("_left", F.lit(0)))
    undecided = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    order = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_code", "_key"))
    ordered = met.where(undecided).withColumn(name, order <= F.col("_left"))
    decided = met.where(~F.coalesce(undecided, F.lit(False))).withColumn(name, F.col("_left") > 0)
    return decided.unionByName(ordered).drop("_key", "_code", "_bucket", "_left", "_n")


def stratified_sample(df: DataFrame, strata: list[str], sizes: DataFrame, key: Column, seed: int) -> DataFrame:
    """At most sample_size rows of each stratum in the order of a seeded hash of ``key``; null-safe on the strata."""
    return first_by_hash(df, strata, sizes.select(*strata, "sample_size"), F.col("sample_size"), key, seed, "_drawn").where("_drawn").drop("_drawn")


def running_offsets(df: DataFrame, position: str, amount: Column, name: str = "offset", width: int = 4096) -> DataFrame:
    """``df`` plus the sum of ``amount`` over all rows of lesser ``position`` (unique integers).

    Sums run within ranges of ``width`` positions, then over the ranges' totals, so no task orders the whole table.
    """
    base = df.withColumns({"_amount": F.coalesce(amount, F.lit(0)).cast("bigint"), "_range": F.floor(F.col(position) / width)})
    totals = base.groupBy("_range").agg(F.sum("_amount").alias("_total")).withColumn("_block", F.floor(F.col("_range") / width))
    blocks = totals.groupBy("_block").agg(F.sum("_total").alias("_sum"))
    before_block = F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.join(blocks.select("_block", before_block.alias("_before")), "_block")
    before_range = F.coalesce(F.sum("_total").over(Window.partitionBy("_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_range", (F.col("_before") + before_range).alias("_start"))
    within = F.coalesce(F.sum("_amount").over(Window.partitionBy("_range").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return base.join(starts, "_range").withColumn(name, F.col("_start") + within).drop("_amount", "_range", "_start")


def unprocessed(links: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Rows whose key is in none of the tables in ``done`` (each with that one column); null keys are never processed."""
    seen = done[0]
    for more in done[1:]:
        seen = seen.unionByName(more)
    return links.where(F.col(key).isNotNull()).join(seen.where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def batch_completeness(items: DataFrame, position: str, processed: DataFrame, size: int) -> DataFrame:
    """batch, items, done, complete: whether every item of each batch of ``size`` positions has been processed."""
    marks = processed.select(position).distinct().withColumn("done", F.lit(1))
    joined = items.select(position).distinct().join(marks, position, "left")
    grouped = joined.groupBy(F.floor((F.col(position) - 1) / size).alias("batch")).agg(F.count(F.lit(1)).alias("items"), F.sum(F.coalesce("done", F.lit(0))).alias("done"))
    return grouped.withColumn("complete", F.col("items") == F.col("done"))


def seeded_split(df: DataFrame, label: list[str], key: Column, seed: int, test_share: float) -> DataFrame:
    """``df`` plus is_test: per label, the first share of rows in the order of a seeded hash, rounded up."""
    return first_by_hash(df, label, None, F.ceil(F.col("_size") * test_share), key, seed, "is_test")


def fold_of(key: Column, seed: int, folds: int) -> Column:
    """Fold of a row by a seeded hash of its key, 0 to folds - 1."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint") % folds
