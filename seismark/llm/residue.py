"""Records whose text is missing or unfinished: error pages, notices about scripts, filler and unfilled slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.llm.pagelines import judged_lines
from seismark.session import cut_lineage

def slot_name(slot: Column) -> Column:
    """The name in a slot, without marks, case and separators: ``{{ article.body }}`` and ``[articlebody]`` agree."""
    return F.regexp_replace(F.lower(slot), r"^\[insert |^xx|xx$| here>>$|^\{%\s*block|[^a-z0-9]", "")


def page_verdicts(pages: DataFrame, page: str, host: str, text: str, furniture: bool = True) -> DataFrame:
    """page, furniture_lines (if asked for), sentences, messages, sure_slots, possible_slots: what each page with text holds.

    ``sentences`` counts those of the report, ``messages`` those of message templates and filler; furniture is in
    neither. Slots are looked for in the lines of the report only. Repeated rows of a page are judged as one; pages with
    null or blank text are left out; a page without a host is judged by what all hosts share. An empty table gives no
    rows.
    """
    lines, slots = judged_lines(pages, page, host, text)
    # Sums are kept in rows of a fixed size; the few lists are made apart from them, since a list for each page is sorted for.
    report = F.col("is_unit") & ~F.col("furniture")
    wanted = [F.collect_set(F.when(F.col("furniture"), F.col("line_no"))).alias("furniture_lines")] if furniture else []
    counts = lines.groupBy("page").agg(*wanted, *[F.sum((report & kind).cast("bigint")).alias(name) for name, kind in (("sentences", ~F.col("message")), ("messages", F.col("message")))])
    slots = slots.where("NOT furniture").groupBy(F.col("page").alias("of_page")).agg(*[F.flatten(F.collect_list(k)).alias(f"{k}_slots") for k in ("sure", "possible")])
    verdicts = counts.join(slots, F.col("page").eqNullSafe(F.col("of_page")), "left").drop("of_page")
    verdicts = verdicts.withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k in ("sure_slots", "possible_slots")})
    return cut_lineage(verdicts)


def residue_pages(verdicts: DataFrame) -> DataFrame:
    """page, reason: pages without a report ('no_report') or with unfilled slots in it ('unfilled_slots').

    A page holds no report if the sentences of messages and filler are as many as those of the report, or there are none
    of either. A report that quotes a message has more of its own. A single-bracket mark counts as a slot only if its name
    is also used in an unmistakable slot somewhere in the corpus.
    """
    missing = F.col("sentences") <= F.col("messages")
    sure = verdicts.where(F.size("sure_slots") > 0)
    names = sure.select(F.explode("sure_slots").alias("slot")).select(slot_name(F.col("slot")).alias("name")).where("name <> ''").distinct()
    possible = verdicts.where((F.size("sure_slots") == 0) & (F.size("possible_slots") > 0)).select("page", F.explode("possible_slots").alias("slot"))
    by_name = possible.select("page", slot_name(F.col("slot")).alias("name")).join(names, "name", "left_semi").select("page").distinct()
    plain = verdicts.where((F.size("sure_slots") > 0) | missing)
    plain = plain.select("page", F.when(missing, "no_report").otherwise("unfilled_slots").alias("reason"))
    return plain.unionByName(by_name.select("page", F.lit("unfilled_slots").alias("reason"))).groupBy("page").agg(F.min("reason").alias("reason"))
