"""One surviving record per group, field by field.

Fields are unpivoted to long rows. Every usable value votes for its normalised form with the trust of its source times a
decay of its age; the votes are summed per form, the form with most votes wins by max_by, and the record that carries the
winning form best supplies the value. The winners are pivoted back to one record.

Strict precedence (the highest trust wins, then the latest) is a choice of weights: a step of trust outweighs all votes
below it together, and within one trust the latest vote outweighs all older ones together. The votes are summed per
form as before, and the form with most of them wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field to survive: its name, what makes a value usable, and the form under which equal values are pooled."""

    name: str
    usable: Column
    normalised: Column


#: Day (since 1970) against which ages are taken. One day for all groups scales the votes of a group alike and spares a
#: pass for its latest row.
FIXED_DAY = 20_000
_NEVER, _NO_TRUST = -(2**62), -1e6


def _decay(half_life_days: float) -> Column:
    days = F.col("at_us") / 86_400_000_000 - FIXED_DAY
    return F.when(F.col("at_us") > _NEVER, F.pow(F.lit(2.0), F.greatest(F.least(days / half_life_days, F.lit(500.0)), F.lit(-500.0)))).otherwise(0.0)


def votes(df: DataFrame, group: str, record: str, trust: str, at: str, fields: list[Field], half_life_days: float = 365.0, strict: bool = False) -> DataFrame:
    """group, field, form, support, top: the votes of each normalised form per group and field; losers included.

    support sums trust times 2^(-age / half-life); with ``strict``, it sums weights that keep precedence (see
    ``_strict_votes``). top is the best single vote as (trust, at, record). Rows count once per record. Missing trust or
    time ranks below any other. The group's rows meet only as partial sums, never as one list, so a group may hold any
    share of the table.
    """
    no_trust = _NO_TRUST if strict else 0.0
    long_rows = df.where(F.col(group).isNotNull() & F.col(record).isNotNull()).select(
        F.col(group).alias("group"), F.col(record).alias("record"), F.coalesce(F.col(trust).cast("double"), F.lit(no_trust)).alias("trust"), F.coalesce(F.unix_micros(at), F.lit(_NEVER)).alias("at_us"),
        F.explode(F.array(*[F.when(f.usable, F.struct(F.lit(f.name).alias("field"), f.normalised.cast("string").alias("form"))) for f in fields])).alias("vote"),
    ).where("vote IS NOT NULL")
    per_record = long_rows.select("group", "record", "trust", "at_us", "vote.field", "vote.form").dropDuplicates(["group", "field", "record", "form", "trust", "at_us"])
    top = F.max(F.struct("trust", "at_us", "record")).alias("top")
    if strict:
        return _strict_votes(per_record.groupBy("group", "field", "form", "trust").agg(top, F.count(F.lit(1)).alias("n"), F.sum(F.least(_decay(half_life_days), F.lit(1.0))).alias("recent")))
    return per_record.groupBy("group", "field", "form").agg(top, F.sum(F.col("trust") * _decay(half_life_days)).alias("support"))


def _strict_votes(levels: DataFrame) -> DataFrame:
    """support and top per group, field and form from its votes at each trust.

    Of N votes of a group and field, the latest at each trust weighs one and the older ones weigh their decay over N + 1,
    less than one together; a step of trust divides by 4 (N + 1), more than all votes of the lower trusts can make up.
    Hence the largest sum is always that of the form with the latest vote of the highest trust.
    """
    of_trust = levels.groupBy("group", "field", "trust").agg(F.max("top").alias("latest"), F.sum("n").alias("n"))
    of_field = of_trust.groupBy("group", "field").agg(F.max("trust").alias("highest"), F.sum("n").alias("all_n"))
    facts = of_trust.select("group", "field", "trust", "latest").join(of_field, ["group", "field"])
    met = levels.join(facts, ["group", "field", "trust"])
    vote = F.when(F.col("top") == F.col("latest"), 1.0).otherwise(0.0) + F.col("recent") / (F.col("all_n") + 1)
    step = F.pow((4.0 * (F.col("all_n") + 1)), F.greatest(F.col("trust") - F.col("highest"), F.lit(-1000.0)))
    return met.groupBy("group", "field", "form").agg(F.max("top").alias("top"), F.sum(vote * step).alias("support"))


def survivors(df: DataFrame, group: str, record: str, trust: str, at: str, fields: list[Field], half_life_days: float = 365.0, strict: bool = False) -> DataFrame:
    """group, field, record, form: per group and field, the record whose value survives.

    The form with the largest sum of votes wins and its best single vote supplies the record. ``strict``: the weights are
    such that the highest trust wins, then the latest, then the highest record id; trusts are whole numbers then.
    Otherwise equal sums fall to the better single vote. Groups with one record count too; fields without a usable value
    give no row; null groups and record ids are left out. Repeated rows change nothing; an empty table gives no rows.
    """
    tally = votes(df, group, record, trust, at, fields, half_life_days, strict)
    rank = F.struct("support", "form") if strict else F.struct("support", "top")
    won = tally.groupBy("group", "field").agg(F.max_by(F.struct("form", "top"), rank).alias("won"))
    return won.select(F.col("group").alias(group), "field", F.col("won.top.record").alias(record), F.col("won.form").alias("form"))


def surviving_records(winners: DataFrame, group: str, record: str, fields: list[str]) -> DataFrame:
    """The long winners pivoted back: one row per group with <field> and <field>_<record> for every field."""
    picks = [x for f in fields for x in (F.max(F.when(F.col("field") == f, F.col("form"))).alias(f), F.max(F.when(F.col("field") == f, F.col(record))).alias(f"{f}_{record}"))]
    return winners.groupBy(group).agg(*picks)
