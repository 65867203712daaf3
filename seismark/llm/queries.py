"""Queries of the data-preparation problems that belong to this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.llm.canonical import holds_name
from seismark.llm.mixing import mix_report, mix_sources
from seismark.llm.neardup import duplicate_groups, expanded_pairs, near_duplicates
from seismark.llm.pagelines import checked_broadcast
from seismark.llm.packing import pack_documents, packing_report
from seismark.llm.placenames import map_label_places
from seismark.llm.residue import page_verdicts, residue_pages
from seismark.llm.subjects import document_subjects, fit_subjects, tokenised
from seismark.llm.survivors import Field, surviving_records, survivors
from seismark.llm.tokens import token_counts
from seismark.operators.instants import normalise_instants
from seismark.session import cut_lineage
from seismark.sources import read_table


def _article_verdicts(spark: SparkSession, folder: str, furniture: bool = True) -> DataFrame:
    return page_verdicts(read_table(spark, folder, "articles", "index_id", "domain", "content"), "index_id", "domain", "content", furniture)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue_pages(_article_verdicts(spark, folder, furniture=False)).select(F.col("page").alias("index_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = _article_verdicts(spark, folder)
    whole = verdicts.join(residue_pages(verdicts), "page", "left_anti")
    return whole.select(F.col("page").alias("index_id"), F.explode("furniture_lines").alias("line_no"))


def _similar_articles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    articles = read_table(spark, folder, "articles", "index_id", "title", "content").where(F.trim("content", F.lit(" \t\r\n\u00a0")) != "")
    usable = articles.join(checked_broadcast(cut_lineage(p1_found(spark, folder))), "index_id", "left_anti")
    return near_duplicates(usable, "index_id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.col("content")), words=3, threshold=0.6)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = expanded_pairs(*_similar_articles(spark, folder))
    return pairs.select(F.col("a").alias("index_id_a"), F.col("b").alias("index_id_b"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_groups(*_similar_articles(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels", "label_id", "loc", "city", "country").distinct()
    mapped = map_label_places(labels, read_table(spark, folder, "places"), read_table(spark, folder, "countries"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_ref").alias("ref_id")) for f in ("country", "city")])
    return mapped.select("label_id", F.inline(fields)).where(F.col("ref_id").isNotNull())


def _label_fields() -> list[Field]:
    typed = [Field(c, holds_name(F.col(c)), F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))) for c in ("city", "country")]
    return [Field("impact", F.col("impact").between(0, 5), F.col("impact")), Field("dt", F.col("epoch_s").isNotNull(), F.col("epoch_s")), *typed]


def _trusted_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Usable columns of labels with the trust of their labeller and dt as an instant."""
    labels = read_table(spark, folder, "labels", "label_id", "index_id", "impact", "dt", "city", "country", "labeller", "labelled_at")
    trust = read_table(spark, folder, "labellers", "labeller", "trust").dropDuplicates(["labeller"])
    dated = normalise_instants(labels.join(trust, "labeller", "left"), "dt", "labeller", seen_at="labelled_at")
    return dated


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = _trusted_labels(spark, folder)
    winners = survivors(labels, "index_id", "label_id", "trust", "labelled_at", _label_fields(), strict=True)
    several = read_table(spark, folder, "labels", "index_id", "label_id").groupBy("index_id").agg(F.min("label_id").alias("least"), F.max("label_id").alias("most")).where("least < most")
    return winners.join(several, "index_id", "left_semi").select("index_id", "field", "label_id")


def p4_voted(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving label per article by summed votes, pivoted back."""
    winners = survivors(_trusted_labels(spark, folder), "index_id", "label_id", "trust", "labelled_at", _label_fields(), half_life_days=180.0)
    return surviving_records(winners, "index_id", "label_id", ["impact", "dt", "city", "country"])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    terms = tokenised(read_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    names, weights = fit_subjects(terms, read_table(spark, folder, "subject_examples"), "subject", "text")
    return document_subjects(terms, names, weights).select(F.col("document").alias("doc_id"), "subject")


#: Tokens of a container.
CAPACITY = 2048


def _sized_documents(spark: SparkSession, folder: str) -> DataFrame:
    # Counted once: the operators read the sizes several times.
    return cut_lineage(token_counts(read_table(spark, folder, "documents", "doc_id", "source", "text"), "text"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_sized_documents(spark, folder), "doc_id", "tokens", CAPACITY)


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(p8_packed(spark, folder), CAPACITY)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_sized_documents(spark, folder), "doc_id", "source", "tokens", read_table(spark, folder, "source_targets"))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(p9_mix(spark, folder), "source", "tokens", read_table(spark, folder, "source_targets"))


QUERIES = {"p8_packed": p8_packed, "p8_report": p8_report, "p9_mix": p9_mix, "p9_report": p9_report, "p10_found": p10_found, "p1_found": p1_found, "p6_found": p6_found, "p6_groups": p6_groups, "p3_found": p3_found, "p2_found": p2_found, "p4_found": p4_found, "p4_voted": p4_voted}
ORACLES: dict[str, str] = {}
