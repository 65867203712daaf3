"""Mixed timestamp notations and time zones brought to one instant in UTC.

Numeric dates such as 03/04/2021 can be read in two orders. Per source, a mixture of the two orders is fitted by
expectation-maximisation: every value adds its likelihood under each order that gives an existing day (a day after the
row was seen is nearly impossible, a short delay likelier than a long one), and the posterior settles each value.
A declared order of a source enters as a prior. Posteriors near a half are reported as unresolved.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.functions.instants import date_components, month_number, number_at, wall_seconds, zone_offset_seconds
from seismark.session import broadcast_if_small, cut_lineage, written

#: Pseudo-counts of a declared and of an undeclared order.
DECLARED_PRIOR, FLAT_PRIOR = (1e6, 1.0), (1.0, 1.0)
#: Likelihood of a day after the row was seen, relative to one on the same day.
FUTURE_LIKELIHOOD = 1e-6
#: Posterior below which a value is marked unresolved.
RESOLVED_FROM = 0.9
EM_ROUNDS = 30
#: Rows of the table of sources or of zone abbreviations that are broadcast at most; larger ones are joined by shuffle.
BROADCAST_SOURCES = 500_000


def zone_abbreviations(zones: DataFrame, zone: str) -> DataFrame:
    """zone, abbreviation, offset_s: the abbreviations each IANA zone has used since 2000, from the zone database."""

    def offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for name in batch[zone]:
                try:
                    info = ZoneInfo(name)
                except (KeyError, ValueError, OSError):
                    continue
                for year in range(2000, 2038):
                    for month in (1, 4, 7, 10):
                        at = datetime(year, month, 1, tzinfo=timezone.utc).astimezone(info)
                        rows.add((name, at.tzname().upper(), int(at.utcoffset().total_seconds())))
            yield pd.DataFrame(sorted(rows), columns=[zone, "abbreviation", "abbreviation_s"]).drop_duplicates([zone, "abbreviation"])

    return zones.select(zone).where(F.col(zone).isNotNull()).distinct().mapInPandas(offsets, f"{zone} string, abbreviation string, abbreviation_s int")


def _delay_class(seen_s: Column, wall_s: Column) -> Column:
    days = (seen_s - wall_s) / 86400
    known = F.when(days < -2, F.lit(-1)).otherwise(F.least(F.floor(F.log2(F.greatest(days, F.lit(0.0)) + 1)), F.lit(12)).cast("int"))
    return F.when(wall_s.isNull(), F.lit(-2)).otherwise(F.coalesce(known, F.lit(0)))


def _likelihood(delay_class: Column) -> Column:
    return F.when(delay_class == -2, F.lit(0.0)).when(delay_class == -1, F.lit(FUTURE_LIKELIHOOD)).otherwise(F.pow(F.lit(2.0), -delay_class))


def order_mixture(parsed: DataFrame) -> DataFrame:
    """source, day_first_share: the mixture weight of day-first numeric dates, by EM on counts per delay class.

    Counts are pre-aggregated, so a source with a third of all rows is as small as any other (at most 225 classes).
    """
    classes = parsed.where(F.col("notation") == "numeric").groupBy("source", "declared_day_first", "class_d", "class_m").agg(F.count(F.lit(1)).alias("n"))
    prior_d = F.when(F.col("declared_day_first"), DECLARED_PRIOR[0]).when(~F.col("declared_day_first"), DECLARED_PRIOR[1]).otherwise(FLAT_PRIOR[0])
    prior_m = F.when(F.col("declared_day_first"), DECLARED_PRIOR[1]).when(~F.col("declared_day_first"), DECLARED_PRIOR[0]).otherwise(FLAT_PRIOR[1])
    stats = (
        classes.where((F.col("class_d") != -2) | (F.col("class_m") != -2))
        .groupBy("source")
        .agg(
            F.collect_list(F.struct(F.col("n").cast("double").alias("n"), _likelihood(F.col("class_d")).alias("l_d"), _likelihood(F.col("class_m")).alias("l_m"))).alias("classes"),
            F.max(prior_d).alias("prior_d"),
            F.max(prior_m).alias("prior_m"),
            F.sum("n").cast("double").alias("total"),
        )
    )

    def step(share: Column, _: Column) -> Column:
        expected = F.aggregate(
            "classes",
            F.lit(0.0),
            lambda acc, c: acc + c["n"] * share * c["l_d"] / (share * c["l_d"] + (1 - share) * c["l_m"]),
        )
        return (F.col("prior_d") + expected) / (F.col("prior_d") + F.col("prior_m") + F.col("total"))

    start = F.col("prior_d") / (F.col("prior_d") + F.col("prior_m"))
    return stats.select("source", F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, step).alias("day_first_share"))


def normalise_instants(df: DataFrame, text: str, source: str, seen_at: str | None = None, zone: str | None = None, day_first: str | None = None) -> DataFrame:
    """``df`` plus epoch_s (bigint), notation, posterior (double) and instant_status.

    text: the column with the timestamps; source: whose mixture of orders is fitted; seen_at: when the row arrived;
    zone: column with the IANA zone of values without one (UTC where null); day_first: column with the declared order.

    instant_status is 'ok', 'ambiguous' (both orders fit and no posterior reaches ``RESOLVED_FROM``; epoch_s then holds
    the likelier reading), or 'unreadable' with a null epoch_s: null and blank text, text of any length that names no full
    day, days or clock times that do not exist. A wall clock that occurs twice is read as its earlier instant, one that
    is skipped moves forward with the clocks. Repeated rows stay repeated, ties between readings go to day first,
    an empty table gives an empty result. Columns of ``df`` with the names of the added ones are replaced.
    """
    added = ("epoch_s", "notation", "posterior", "instant_status")
    df = df.drop(*added)
    kept = df.columns
    raw = F.col(text).cast("string")
    at = F.unix_seconds(F.col(seen_at)) if seen_at else F.lit(None).cast("bigint")
    base = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(source).alias("source"),
        at.alias("seen_s"),
        (F.col(zone) if zone else F.lit(None).cast("string")).alias("zone"),
        (F.col(day_first) if day_first else F.lit(None).cast("boolean")).alias("declared_day_first"),
        # One generated row each: the text is matched once, and the plan does not copy the match into every use of it.
        F.explode(F.array(date_components(raw))).alias("parts"),
    )
    parts = F.col("parts")
    year = F.when(F.length(parts[1]) == 2, number_at(parts, 1) + F.when(number_at(parts, 1) < 70, 2000).otherwise(1900)).otherwise(number_at(parts, 1))
    hour, minute, second = (F.coalesce(number_at(parts, k), F.lit(0)) for k in (4, 5, 6))
    half = F.get(parts, F.lit(7))
    clock_hour = F.when(half.isin("A", "P") & hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0)).otherwise(hour)
    of_day = F.when((clock_hour <= 23) & (minute <= 59) & (second <= 60), (clock_hour * 3600 + minute * 60 + second).cast("bigint"))
    first, middle = number_at(parts, 3), month_number(parts, 2)
    read = F.struct(
        F.get(parts, F.lit(0)).alias("notation"),
        F.when(F.get(parts, F.lit(0)) == "epoch", F.get(parts, F.lit(1)).try_cast("bigint")).alias("count_s"),
        F.nullif(F.get(parts, F.lit(8)), F.lit("")).alias("zone_text"),
        F.when(F.get(parts, F.lit(0)) != "epoch", wall_seconds(year, middle, first, of_day)).alias("wall_d"),
        F.when(F.get(parts, F.lit(0)) == "numeric", wall_seconds(year, first, number_at(parts, 2), of_day)).alias("wall_m"),
    )
    parsed = base.select("row", "source", "zone", "declared_day_first", "seen_s", F.explode(F.array(read)).alias("read")).select("*", "read.*").drop("read")
    parsed = parsed.withColumns({"class_d": _delay_class(F.col("seen_s"), F.col("wall_d")), "class_m": _delay_class(F.col("seen_s"), F.col("wall_m"))})

    # Written once: the mixture is fitted on all rows before any of them can be settled.
    parsed = written(parsed)
    resolved = parsed.join(broadcast_if_small(cut_lineage(order_mixture(parsed)), BROADCAST_SOURCES), "source", "left")
    share = F.coalesce(F.col("day_first_share"), F.lit(0.5))
    like_d, like_m = share * _likelihood(F.col("class_d")), (1 - share) * _likelihood(F.col("class_m"))
    twofold = (F.col("notation") == "numeric") & F.col("wall_d").isNotNull() & F.col("wall_m").isNotNull() & (F.col("wall_d") != F.col("wall_m"))
    posterior_d = F.when(twofold, like_d / (like_d + like_m))
    wall = F.when(twofold, F.when(posterior_d >= 0.5, F.col("wall_d")).otherwise(F.col("wall_m"))).otherwise(F.coalesce("wall_d", "wall_m"))
    resolved = resolved.select("row", "notation", "count_s", "zone", "zone_text", wall.alias("wall_s"), F.greatest(posterior_d, 1 - posterior_d).alias("two_p"))

    plain_offset = zone_offset_seconds(F.col("zone_text"))
    if zone:
        abbreviations = zone_abbreviations(df.select(F.col(zone).alias("zone")), "zone").withColumnRenamed("abbreviation", "zone_text")
        abbreviations = broadcast_if_small(cut_lineage(abbreviations), BROADCAST_SOURCES)
        resolved = resolved.join(abbreviations, ["zone", "zone_text"], "left")
        offset = F.coalesce(plain_offset, F.col("abbreviation_s"))
    else:
        offset = plain_offset
    local = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("wall_s"), F.coalesce(F.col("zone"), F.lit("UTC"))))
    epoch = F.coalesce(F.col("count_s"), F.when(F.col("zone_text").isNotNull(), F.col("wall_s") - offset).otherwise(local)).cast("bigint")
    done = resolved.select("row", epoch.alias("epoch_s"), "notation", F.coalesce("two_p", F.lit(1.0)).alias("posterior"))
    status = F.when(F.col("epoch_s").isNull(), "unreadable").when(F.col("posterior") < RESOLVED_FROM, "ambiguous").otherwise("ok")
    return done.select(
        *[F.col("row")[c].alias(c) for c in kept],
        "epoch_s",
        F.when(F.col("epoch_s").isNotNull(), F.col("notation")).alias("notation"),
        F.when(F.col("epoch_s").isNotNull(), F.col("posterior")).alias("posterior"),
        status.alias("instant_status"),
    )
