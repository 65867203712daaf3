"""Documents of several sources mixed to target shares of all tokens, by entropy balancing.

The rates r of the documents are those closest in relative entropy to using each document once, under one constraint per
source: its rates times tokens sum to its share of the total. The solution is an exponential tilt, r = exp(l * tokens)
with one multiplier l per source, held to the source's largest allowed rate; the multipliers minimise a convex dual and
are found by Newton steps, each of which is one distributed sum of gradients and curvatures. The rates are rounded to
whole copies so that rounding errors cancel along documents of similar length.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seismark.session import broadcast_if_small, cut_lineage

#: Newton steps at most, and the relative error of a source's tokens at which it has settled.
STEPS, SETTLED = 60, 1e-9
#: Target sources at most: they are a table of parameters, and their multipliers are part of every task.
MOST_SOURCES = 10_000
#: Documents whose rates are rounded in one run.
ROUNDED_TOGETHER = 50_000


def mix_rates(sized: DataFrame, source: str, tokens: str, targets: DataFrame, target_source: str, share: str, most_repeats: str, total_tokens: int | None = None) -> tuple[DataFrame, dict]:
    """``sized`` plus rate, and the multipliers with what they reach, per source.

    The total is ``total_tokens``, but at most what every source can supply at its repeats; that is also the default.
    """
    rows = targets.select(target_source, share, most_repeats).where(F.col(target_source).isNotNull() & (F.col(share) > 0)).dropDuplicates([target_source]).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    # Equal sizes of a source share one rate: the steps run on counts per size, grouped once.
    sizes = sized.where(F.col(source).isin([r[0] for r in rows]) & (F.col(tokens) > 0)).groupBy(F.col(source).alias("source"), F.col(tokens).cast("double").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes)
    supply = {r["source"]: (r["tokens"], r["n"]) for r in sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"), F.sum("n").alias("n")).collect()}
    usable = [r for r in rows if r[0] in supply]
    shares = sum(r[1] for r in rows)
    most = min([supply[r[0]][0] * (r[2] or 1) / (r[1] / shares) for r in usable], default=0.0)
    total = min(most, float(total_tokens)) if total_tokens else most
    state = {r[0]: {"l": 0.0, "cap": float(r[2] or 1), "goal": total * r[1] / shares, "mean": supply[r[0]][0] / supply[r[0]][1], "low": -60.0, "high": 60.0} for r in usable}
    for s, x in state.items():
        if x["goal"] >= supply[s][0] * x["cap"] * (1 - 1e-12):
            x["l"] = math.inf  # every document at the cap
    for _ in range(STEPS):
        open_sources = {s: x for s, x in state.items() if math.isfinite(x["l"]) and not x.get("settled")}
        if not open_sources:
            break
        tilt = F.create_map(*[F.lit(v) for s, x in open_sources.items() for v in (s, x["l"] / x["mean"])])
        cap = F.create_map(*[F.lit(v) for s, x in open_sources.items() for v in (s, x["cap"])])
        exponent = F.least(tilt[F.col("source")] * F.col("size"), F.lit(700.0))
        rate = F.least(F.exp(exponent), cap[F.col("source")])
        scaled = F.when(F.exp(exponent) < cap[F.col("source")], F.col("n") * F.col("size") * F.col("size") * rate).otherwise(0.0)
        sums = sizes.where(F.col("source").isin(list(open_sources))).groupBy("source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("reached"), F.sum(scaled).alias("curve"))
        for r in sums.collect():
            x = state[r["source"]]
            gap = x["goal"] - r["reached"]
            x["reached"] = r["reached"]
            if abs(gap) <= SETTLED * x["goal"]:
                x["settled"] = True
                continue
            x["low" if gap > 0 else "high"] = x["l"]
            step = x["l"] + gap / (r["curve"] / x["mean"]) if r["curve"] > 0 else math.nan
            x["l"] = step if x["low"] < step < x["high"] else (x["low"] + x["high"]) / 2
    # One row per target source; there are at most MOST_SOURCES.
    settled = [(s, None if math.isinf(x["l"]) else x["l"] / x["mean"], x["cap"]) for s, x in state.items()]
    tilts = sized.sparkSession.createDataFrame(settled, "_source string, _tilt double, _cap double")
    tilted = F.least(F.exp(F.least(F.col("_tilt") * F.col(tokens), F.lit(700.0))), F.col("_cap"))
    rate = F.when(F.col("_tilt").isNull(), F.col("_cap")).otherwise(tilted)
    sized = sized.join(F.broadcast(tilts), F.col(source) == F.col("_source"), "left")
    rate = F.coalesce(rate, F.lit(0.0))
    return sized.withColumn("rate", F.when(F.coalesce(F.col(tokens), F.lit(0)) > 0, rate).otherwise(0.0)).drop("_source", "_tilt", "_cap"), state


def mix_sources(sized: DataFrame, document: str, source: str, tokens: str, targets: DataFrame, target_source: str = "source", share: str = "target_share", most_repeats: str = "max_repeats", total_tokens: int | None = None) -> DataFrame:
    """document, source, tokens, rate, copies: how often each document is used; sources without a target are not used.

    No document is used more often than its source's repeats allow. Null and empty texts and null sources get no copies;
    a target source without documents supplies nothing and the report shows it. Repeated rows are documents of their
    own. An empty table gives no rows.
    """
    rated, _ = mix_rates(sized, source, tokens, targets, target_source, share, most_repeats, total_tokens)
    rated = cut_lineage(rated.select(F.col(document).alias("document"), F.col(source).alias("source"), F.col(tokens).alias("tokens"), "rate"))
    used = rated.where("rate > 0")
    runs = used.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / ROUNDED_TOGETHER).alias("runs"))
    dealt = used.join(broadcast_if_small(cut_lineage(runs), MOST_SOURCES), "source").withColumn("run", F.pmod(F.xxhash64("document"), F.col("runs")))
    order = Window.partitionBy("source", "run").orderBy("tokens", "document")
    upto = F.sum(F.col("rate") - F.floor("rate")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fraction = F.col("rate") - F.floor("rate")
    dealt = dealt.withColumn("upto", upto)
    copies = F.floor("rate") + F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - fraction + 0.5)
    counted = dealt.select("document", "source", "tokens", "rate", copies.cast("int").alias("copies"))
    unused = rated.where("rate <= 0").select("document", "source", "tokens", "rate", F.lit(0).alias("copies"))
    return counted.unionByName(unused).withColumnsRenamed({"document": document, "source": source, "tokens": tokens})


def mix_report(mixed: DataFrame, source: str, tokens: str, targets: DataFrame, target_source: str = "source", share: str = "target_share", most_repeats: str = "max_repeats") -> DataFrame:
    """source, target_share, actual_share, used_tokens, documents, most_copies and max_repeats per target source."""
    used = mixed.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(tokens) * F.col("copies")).alias("used_tokens"), F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("documents"), F.max("copies").alias("most_copies"))
    wanted = targets.select(F.col(target_source).alias("source"), F.col(share).alias("target_share"), F.col(most_repeats).alias("max_repeats"))
    joined = wanted.join(used, "source", "left").fillna(0, ["used_tokens", "documents", "most_copies"])
    total = joined.agg(F.sum("used_tokens").alias("total"))
    return joined.crossJoin(F.broadcast(total)).select("source", "target_share", F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), F.col("total")), F.lit(0.0)).alias("actual_share"), "used_tokens", "documents", "most_copies", "max_repeats")
