"""Places named in text, found by looking its word runs up in lists of countries, states and cities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.functions.text import title_case_share

# Accented letters of Latin scripts and their plain forms.
ACCENTED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def plain_name(text: Column) -> Column:
    """Lower case without accents, possessives, punctuation and repeated blanks."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"['’]s\b", ""), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def gazetteer(places: DataFrame, countries: DataFrame) -> DataFrame:
    """name, kind, country, rank: one row per name; a country wins over a state, a state over a city, then population."""
    named = countries.select(F.explode(F.array("country", "official_name")).alias("raw"), F.lit("country").alias("kind"), "country", F.lit(0).cast("bigint").alias("weight"))
    states = places.select(F.col("state").alias("raw"), F.lit("state").alias("kind"), "country", F.col("population").alias("weight"))
    cities = places.select(F.explode(F.array("city", "alt_name")).alias("raw"), F.lit("city").alias("kind"), "country", F.col("population").alias("weight"))
    rows = named.unionByName(states).unionByName(cities).where(F.col("raw").isNotNull()).withColumn("name", plain_name(F.regexp_replace("raw", "(?i)^the ", "")))
    order = F.struct(F.when(F.col("kind") == "country", 0).when(F.col("kind") == "state", 1).otherwise(2).alias("rank"), (-F.coalesce("weight", F.lit(0))).alias("smaller"), "country", "kind")
    return rows.where("name <> ''").groupBy("name").agg(F.min(order).alias("best")).select("name", "best.kind", "best.country", "best.rank")


def places_in(texts: DataFrame, key: str, text: str, names: DataFrame, longest: int = 3) -> DataFrame:
    """key, kind, name, country, position: every listed name among the runs of one to ``longest`` words of a text.

    The list is joined by equality on the run; a run within a longer match counts too. Text in which over four fifths of
    the words are capitalised is read like any other, since matching ignores case.
    """
    tokens = F.split(plain_name(F.col(text)), " ")
    base = texts.where(F.col(text).isNotNull()).select(F.col(key), tokens.alias("tokens"))

    def runs_of(n: int) -> Column:
        starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - n + 1))
        runs = F.transform(starts, lambda i: F.struct(i.alias("position"), F.array_join(F.slice("tokens", i, n), " ").alias("name")))
        return F.coalesce(runs, F.array().cast("array<struct<position:int,name:string>>"))

    runs = F.filter(F.flatten(F.array(*[runs_of(n) for n in range(1, longest + 1)])), lambda r: r["name"] != "")
    found = base.select(key, F.explode(runs).alias("run")).select(key, "run.position", "run.name")
    return found.join(names, "name").select(key, "kind", "name", "country", "position")


def mostly_capitalised(text: Column, share: float = 0.8) -> Column:
    return F.coalesce(title_case_share(text) > share, F.lit(False))
