"""Typed places of labels as entries of the lists of countries and cities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.llm.canonical import BROADCAST_VALUES, COUNTRY_ABBREVIATIONS, PLACE_ABBREVIATIONS, holds_name, match_values, with_answers
from seismark.session import broadcast_if_small, cut_lineage

# Words around a name in a description of a place.
_AROUND_LOC = r"(?i)\b(?:outskirts of|close to|near|off the coast of|and surrounding districts|border area|several provinces|northern|southern|eastern|western|central|coast of|outside|north of|south of|east of|west of|region of|suburbs of)\b"


def loc_pieces(loc: Column) -> Column:
    """The parts of a description that can be names."""
    parts = F.split(F.regexp_replace(loc, _AROUND_LOC, ","), r"\s*[,/:;()|]\s*|\s+-\s+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _answers(values: list, reference: DataFrame, ref_id: str, names: list[str], carry: list[str], abbreviations: dict) -> DataFrame:
    every = values[0]
    for more in values[1:]:
        every = every.union(more)
    return broadcast_if_small(cut_lineage(match_values(every, reference, ref_id, names, carry, abbreviations=abbreviations)), BROADCAST_VALUES)


def map_label_places(labels: DataFrame, places: DataFrame, countries: DataFrame) -> DataFrame:
    """``labels`` plus country_ref and city_ref: the ids meant, 0 for a name that is not listed, null where none is typed.

    An empty city is taken from loc if that names a listed city: the first of its pieces that is a city and no country,
    however many pieces and letters it has. Several places that fit a name are told apart by the country of the label,
    then that of loc, then by population and the lower id. Every distinct value and piece is looked up once. Repeated rows
    stay; columns of the added names are replaced.
    """
    kept = [c for c in labels.columns if c not in ("country_ref", "city_ref")]
    labels = labels.select(*kept)
    no_city = ~holds_name(F.col("city"))
    locs = labels.where(F.col("loc").isNotNull()).groupBy("loc").agg(F.max(no_city).alias("asked"))
    pieces = cut_lineage(locs.select("loc", "asked", F.posexplode(loc_pieces(F.col("loc"))).alias("position", "piece")))

    of_country = _answers([labels.select("country"), pieces.select("piece")], countries, "country_id", ["country", "official_name", "code3"], [], COUNTRY_ABBREVIATIONS)
    pieces = with_answers(pieces, "piece", of_country, "piece_countries")
    locality = F.when(F.col("asked") & (F.size("piece_countries") == 0), F.col("piece"))
    of_place = _answers([labels.select("city"), pieces.select(locality)], places, "place_id", ["city", "alt_name"], ["country_id", "population"], PLACE_ABBREVIATIONS)
    pieces = with_answers(pieces.withColumn("locality", locality), "locality", of_place, "locality_places")
    first = lambda c: F.min_by(F.when(F.size(c) > 0, F.col(c)), F.when(F.size(c) > 0, F.col("position")))
    of_loc = pieces.groupBy("loc").agg(first("piece_countries").alias("loc_countries"), first("locality_places").alias("loc_places"))
    of_loc = broadcast_if_small(cut_lineage(of_loc), BROADCAST_VALUES)

    df = with_answers(with_answers(labels, "country", of_country, "country_matches"), "city", of_place, "city_matches").join(of_loc, "loc", "left")
    own, around = F.get("country_matches", F.lit(0))["ref_id"], F.get("loc_countries", F.lit(0))["ref_id"]
    candidates = F.when(no_city, F.col("loc_places")).otherwise(F.col("city_matches"))
    ranked = F.transform(
        candidates,
        lambda m: F.struct(
            F.when(m["country_id"] == own, 0).when(m["country_id"] == around, 1).otherwise(2).alias("rank"),
            (-F.coalesce(m["population"], F.lit(0))).alias("smaller"),
            m["ref_id"].alias("ref_id"),
        ),
    )
    city_ref = F.when(candidates.isNotNull(), F.coalesce(F.array_min(ranked)["ref_id"], F.lit(0).cast("bigint")))
    country_ref = F.when(F.col("country_matches").isNotNull(), F.coalesce(own, F.lit(0).cast("bigint")))
    return df.select(*kept, country_ref.alias("country_ref"), city_ref.alias("city_ref"))
