"""Pairs of the members of a group, however large the group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Members of one key that meet in one task; larger groups are cut into blocks, and each pair of blocks meets.
BLOCK = 2_000


def pairs_within(rows: DataFrame, key: str, member: str, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """key, a, b and, of each side, <carried>_a, <carried>_b: the pairs a < b of members under one key.

    A key with more than ``block`` members is cut into blocks by a hash of the member, and each pair of blocks is joined
    under its own key, so that no task forms all pairs of a hot one. Null keys and members have no pairs; a member that
    is listed twice gives its pairs twice.
    """
    # One shuffle by key serves the counts and both sides of the join; keys of one member go no further.
    sized = rows.where(F.col(key).isNotNull() & F.col(member).isNotNull()).select(key, member, *carry, F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n")).where("_n > 1")

    def sides(some: DataFrame, *more: str) -> DataFrame:
        left, right = (some.select(key, *[F.col(m).alias(n) for m, n in zip(more, blocks)], F.col(member).alias(name), *[F.col(c).alias(f"{c}_{name}") for c in carry]) for name, blocks in (("a", ("_own", "_other")), ("b", ("_other", "_own"))))
        return left.join(right, [key, *[n for n in ("_own", "_other") if more]]).where("a < b").drop("_own", "_other")

    cold = sides(sized.where(F.col("_n") <= block))
    parts = F.ceil(F.col("_n") / block)
    hot = sized.where(F.col("_n") > block).withColumn("_mine", F.pmod(F.xxhash64(member), parts)).withColumn("_its", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return cold.unionByName(sides(hot, "_mine", "_its"))
