"""Date phrases in text, resolved against the day of publication, preferring the past."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English weekdays, Monday first.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

DATE_PHRASE = r"(?i)\b(?:yesterday|today|last night|monday|tuesday|wednesday|thursday|friday|saturday|sunday|\d{4}-\d{2}-\d{2})\b"


def date_phrases(text: Column) -> Column:
    """The date phrases of a text in order of appearance, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(DATE_PHRASE), F.lit(0)), lambda p: F.lower(p))


def resolve_phrase(phrase: Column, published: Column) -> Column:
    """The day a phrase means: a weekday is the latest such day up to the publication, the same weekday that very day."""
    number = F.create_map(*[F.lit(x) for i, d in enumerate(WEEKDAYS) for x in (d, i)])[phrase]
    back = F.pmod(F.weekday(published) - number, F.lit(7))
    return (
        F.when(phrase == "today", published)
        .when(phrase.isin("yesterday", "last night"), F.date_sub(published, 1))
        .when(number.isNotNull(), F.date_sub(published, back))
        .otherwise(F.try_to_date(phrase, "yyyy-MM-dd"))
    )


def event_day(content: Column, title: Column, published: Column) -> Column:
    """The first day up to the publication that the content names, else that the title names; null if neither does."""

    def first(text: Column) -> Column:
        days = F.transform(date_phrases(text), lambda p: resolve_phrase(p, published))
        return F.get(F.filter(days, lambda d: d <= published), F.lit(0))

    return F.coalesce(first(content), first(title))
