"""Values typed freely, mapped to the closest entry of a reference list.

Values are folded (case, accents, quotes, brackets, abbreviations) and looked up in a BK-tree over the folded entries
under a true edit metric; the triangle inequality prunes, and every entry within the limit is seen. Each distinct value is
probed once. A reference list up to a checked bound is broadcast; a larger one is spread over shards, the values are
probed against each shard, and the shards' winners are merged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.llm.bktree import BKTree
from seismark.session import broadcast_if_small, cut_lineage, spread

#: Entries of a reference list that are broadcast at most; beyond, the list is sharded by this size.
BROADCAST_ENTRIES = 200_000
#: Distinct values whose answers are broadcast to the rows at most; more are joined by shuffle.
BROADCAST_VALUES = 200_000
#: Parts in which the distinct values meet each shard of a list that is not broadcast.
SLICES = 64

# Typed words that stand for "not known" or "no single place", without case and punctuation.
EMPTY_WORDS = (
    "unknown", "not known", "unkn", "n a", "na", "nan", "nil", "null", "none", "tbd", "tbc", "tba", "not specified", "unspecified", "not stated",
    "not available", "not applicable", "not given", "not provided", "undefined", "unclear", "various", "various places", "various locations", "various cities",
    "various countries", "multiple", "multiple places", "multiple locations", "multiple cities", "multiple countries", "several", "several places", "several locations",
    "several cities", "several countries", "many", "nationwide", "countrywide", "worldwide", "global", "international", "everywhere", "nowhere", "other", "blank", "empty", "missing", "x", "xx", "xxx",
)

# What a shortened first word of a place name can stand for.
PLACE_ABBREVIATIONS = {
    "pt": ("port", "point"), "p": ("port", "point"), "prt": ("port",), "lk": ("lake",), "l": ("lake",), "upr": ("upper",), "up": ("upper",), "lwr": ("lower",), "n": ("north", "new"), "no": ("north",), "nth": ("north",),
    "s": ("south", "saint"), "sth": ("south",), "so": ("south",), "e": ("east",), "w": ("west",), "mt": ("mount",), "mnt": ("mount",), "m": ("mount",), "st": ("saint",), "ste": ("saint",), "snt": ("saint",), "ft": ("fort",), "f": ("fort",), "nw": ("new",),
}

# Shortened words in official names of countries.
COUNTRY_ABBREVIATIONS = {"fed": ("federal",), "rep": ("republic",), "kgd": ("kingdom",), "kgdm": ("kingdom",), "cwealth": ("commonwealth",), "commonw": ("commonwealth",), "dem": ("democratic",), "st": ("states", "saint")}

_AROUND = re.compile(r"^(?:the )?(?:city of|town of|village of|greater|metropolitan|metro)\s+|\s+(?:city|town|village|metro area|area|district)$")


def holds_name(value: Column) -> Column:
    """Whether a typed value holds a name: not null, blank, bare punctuation or a word for "not known"."""
    words = F.lower(F.trim(F.regexp_replace(value, r"[^\p{L}\p{N}]+", " ")))
    return F.coalesce((words != "") & ~words.isin(*EMPTY_WORDS), F.lit(False))


def fold(value: str) -> str:
    """Lower case without accents, quotes and repeated blanks."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[\"'“”‘’`´]", "", plain)).strip()


def _words(text: str) -> str:
    return re.sub(r"[^\w]+", " ", text).strip()


def readings(value: str, abbreviations: dict[str, tuple[str, ...]], most_words: int) -> list[str]:
    """The forms in which a typed value may stand in the list: without brackets or what follows a comma or slash,
    turned round at a comma, without "city of" and the like, with abbreviations written out in every way. Forms of more
    than ``most_words`` words are left out."""
    folded = fold(value)
    bare = _words(re.sub(r"\([^)]*\)?", " ", folded))
    pieces = [x for x in re.split(r"\s*[,/;:|(]\s*|\s+-\s+", re.sub(r"\([^)]*\)?", " ", folded)) if x.strip(" .-")]
    forms = [bare]
    if len(pieces) == 2:
        forms.append(_words(f"{pieces[1]} {pieces[0]}"))
    if len(pieces) > 1:
        forms += [_words(x) for x in pieces[:1]]
    out: list[str] = []
    for form in forms:
        for x in (form, _AROUND.sub("", form), re.sub(r"^the ", "", form)):
            words = x.split()
            if len(words) <= most_words:
                out += map(" ".join, product(*[dict.fromkeys((*abbreviations.get(w, ()), w)) for w in words]))
    return [x for x in dict.fromkeys(out) if x]


class ValueIndex:
    """BK-tree over folded entries; ``lookup`` gives the ids of the closest entries and their distance."""

    def __init__(self, entries: list[tuple], limit: int, abbreviations: dict[str, tuple[str, ...]]) -> None:
        self.ids: dict[str, list[tuple]] = {}
        for name, *entry in entries:
            key = _words(fold(name))
            if key and tuple(entry) not in self.ids.setdefault(key, []):
                self.ids[key].append(tuple(entry))
        self.tree, self.limit, self.abbreviations = BKTree(self.ids), limit, abbreviations
        # An edit adds one letter, or one blank and thereby one word, so longer forms are near no entry.
        self.longest = max(map(len, self.ids), default=0) + limit
        self.most_words = max((len(x.split()) for x in self.ids), default=0) + limit

    def lookup(self, value: str) -> tuple[tuple, ...]:
        forms = [x for x in readings(value, self.abbreviations, self.most_words) if len(x) <= self.longest]
        exact = [(0, x) for x in forms if x in self.ids]
        near = exact or [(d, name) for x in forms for d, name in self.tree.nearest(x, min(self.limit, (len(x) - 1) // 3))]
        if not near:
            return ()
        least = min(d for d, _ in near)
        return tuple(dict.fromkeys((least, *entry) for d, name in near if d == least for entry in self.ids[name]))


def match_values(
    values: DataFrame,
    reference: DataFrame,
    ref_id: str,
    names: list[str],
    carry: list[str] | None = None,
    limit: int = 2,
    abbreviations: dict[str, tuple[str, ...]] | None = None,
    broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """value, matches: for each distinct value that is listed, the closest entries as ``map_values`` gives them."""
    carry, short = carry or [], abbreviations or {}
    facts = ["ref_id", *carry]
    entries = reference.select(F.explode(F.array(*[F.col(n).cast("string") for n in names])).alias("name"), F.col(ref_id).cast("bigint").alias("ref_id"), *[F.col(c).cast("bigint").alias(c) for c in carry])
    entries = entries.where(F.col("ref_id").isNotNull() & (F.trim("name") != "")).distinct()
    values = values.select(F.col(values.columns[0]).cast("string").alias("value"))
    values = values.where(holds_name(F.col("value"))).distinct()
    schema = "value string, distance int, " + ", ".join(f"{c} bigint" for c in facts)
    found = ["value", "distance", *facts]

    def ordered(rows: Iterable) -> list[tuple]:
        return sorted((tuple(r) for r in rows), key=lambda r: (r[1], r[0]))

    def answers(some: pd.Series, index: ValueIndex) -> pd.DataFrame:
        return pd.DataFrame([(v, *m) for v in some for m in index.lookup(v)], columns=found)

    if (count := entries.count()) <= broadcast_entries:
        listed = values.sparkSession.sparkContext.broadcast(ordered(entries.collect()))

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = ValueIndex(listed.value, limit, short)
            for batch in batches:
                yield answers(batch["value"], index)

        won = spread(values, "value").mapInPandas(probe, schema)
    else:
        shards = -(-count // broadcast_entries)
        parts = entries.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int"))
        asked = values.select("value", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("value"), F.lit(SLICES)).cast("int").alias("slice"))
        parts = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))

        def probe_shard(some: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
            return answers(some["value"], ValueIndex(ordered(shard[["name", *facts]].itertuples(index=False)), limit, short))

        won = spread(asked, "shard", "slice").groupBy("shard", "slice").cogroup(spread(parts, "shard", "slice").groupBy("shard", "slice")).applyInPandas(probe_shard, schema)
    merged = won.groupBy("value").agg(F.array_sort(F.collect_set(F.struct("distance", *facts))).alias("won"))
    return merged.select("value", F.filter("won", lambda m: m["distance"] == F.col("won")[0]["distance"]).alias("matches"))


def with_answers(df: DataFrame, column: str, answers: DataFrame, name: str) -> DataFrame:
    """``df`` plus the matches of a column's value: null where it holds no name, empty where it is not listed."""
    kind = answers.schema["matches"].dataType
    found = answers.select(F.col("value").alias("_value"), F.col("matches").alias("_matches"))
    joined = df.withColumn("_value", F.when(holds_name(F.col(column)), F.col(column).cast("string"))).join(found, "_value", "left")
    return joined.withColumn(name, F.when(F.col("_value").isNotNull(), F.coalesce("_matches", F.array().cast(kind)))).drop("_value", "_matches")


def map_values(
    df: DataFrame,
    columns: list[str],
    reference: DataFrame,
    ref_id: str,
    names: list[str],
    carry: list[str] | None = None,
    limit: int = 2,
    abbreviations: dict[str, tuple[str, ...]] | None = None,
    broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """``df`` plus, for each column, <column>_matches: array of (distance, ref_id, carried bigints), the closest entries.

    An edit is an insertion, deletion, substitution or swap of neighbours after folding; at most ``limit`` are allowed,
    fewer in names of under seven letters. Null stands for a value that holds no name (null, blank, punctuation,
    "unknown"), an empty array for one that is not listed; ties of distance give every closest entry, by id. Repeated
    rows stay, values of any length are read, empty tables and an empty list are allowed, entries with a null id or name
    are left out. Columns of ``df`` with the names of the added ones are replaced.
    """
    added = [f"{c}_matches" for c in columns]
    df = df.drop(*added)
    kept = df.columns
    values = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value"))
    answers = broadcast_if_small(cut_lineage(match_values(values, reference, ref_id, names, carry, limit, abbreviations, broadcast_entries)), BROADCAST_VALUES)
    for column, name in zip(columns, added):
        df = with_answers(df, column, answers, name)
    return df.select(*kept, *added)
