"""Queries of the text problems 6 to 8 over whole tables, and equal SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.llm import abuse, leakage, packing
from loomcast.session import materialise, table


def p6_packing(spark: SparkSession, data: str) -> DataFrame:
    counts = packing.token_counts(table(spark, data, "documents"))
    return packing.fill_containers(counts, table(spark, data, "pack_capacity"))


def p6_fill_rates(spark: SparkSession, data: str) -> DataFrame:
    return packing.fill_rates(p6_packing(spark, data), table(spark, data, "pack_capacity"))


def p6_checks(spark: SparkSession, data: str) -> DataFrame:
    """What a packing must satisfy: every text with tokens placed in each container, whole unless it exceeds it, no window above its capacity."""
    counts = materialise(packing.token_counts(table(spark, data, "documents")))
    placed = packing.fill_containers(counts, table(spark, data, "pack_capacity")).join(table(spark, data, "pack_capacity"), "container")
    window = placed.groupBy("container", "window_id").agg(F.sum("n_tokens").alias("held"), F.max("capacity_tokens").alias("most"))
    over = window.groupBy("container").agg(F.count_if(F.col("held") > F.col("most")).alias("overfull"))
    sizes = counts.where("doc_id is not null").groupBy("doc_id").agg(F.sum("n_tokens").alias("whole"))
    texts = placed.groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("parts"), F.max("capacity_tokens").alias("most")).join(sizes, "doc_id")
    each = texts.groupBy("container").agg(F.count_if(F.col("whole") > 0).alias("texts"), F.count_if(F.col("held") != F.col("whole")).alias("lost"), F.count_if((F.col("parts") > 1) & (F.col("whole") <= F.col("most"))).alias("needlessly_split"))
    return each.join(over, "container").select("container", "texts", "lost", "needlessly_split", "overfull")


def p7_leaks(spark: SparkSession, data: str) -> DataFrame:
    """Leaks with the length of the stretch, and the document's source."""
    documents = table(spark, data, "documents")
    found = leakage.leaks(documents, table(spark, data, "benchmark"))
    return found.join(documents.select("doc_id", "source"), "doc_id")


def p7_verbatim(spark: SparkSession, data: str) -> DataFrame:
    """Leaks of a whole passage in its own letters: what SQL can say of the operator's recall."""
    documents, benchmark = table(spark, data, "documents"), table(spark, data, "benchmark")
    found = leakage.leaks(documents, benchmark).join(benchmark.select("item_id", "passage"), "item_id").join(documents.select("doc_id", "text"), "doc_id")
    return found.where(F.contains("text", "passage")).select("item_id", "doc_id").distinct()


def p7_found(spark: SparkSession, data: str) -> DataFrame:
    return leakage.leaks(table(spark, data, "documents"), table(spark, data, "benchmark")).select("item_id", "doc_id")


def _scored(spark: SparkSession, data: str) -> DataFrame:
    documents = table(spark, data, "documents")
    return abuse.score_documents(documents, abuse.fit_model(documents, table(spark, data, "labels")))


def p8_scores(spark: SparkSession, data: str) -> DataFrame:
    return _scored(spark, data)


def p8_source_counts(spark: SparkSession, data: str) -> DataFrame:
    """Documents of each source, by way of the rates: none is left unscored, and rates are shares."""
    rates = p8_source_rates(spark, data)
    return rates.select("source", "documents", ((F.col("flagged") <= F.col("documents")) & F.col("rate").between(0, 1) & F.col("mean_score").between(0, 1)).alias("sound"))


def p8_source_rates(spark: SparkSession, data: str) -> DataFrame:
    return abuse.source_rates(_scored(spark, data))


def p8_found(spark: SparkSession, data: str) -> DataFrame:
    return _scored(spark, data).where(F.col("flagged") & F.col("doc_id").isNotNull()).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_packing, p6_fill_rates, p6_checks, p7_found, p7_leaks, p7_verbatim, p8_found, p8_scores, p8_source_rates, p8_source_counts)}

#: Tokenizing, alignment and the classifier have no SQL; tests hold them against brute force, round trips and held-out labels.
SQL: dict[str, str] = {
    "p7_verbatim": "SELECT DISTINCT item_id, doc_id FROM benchmark JOIN documents ON contains(text, passage) WHERE length(passage) > 0",
    "p6_checks": "SELECT container, (SELECT count(*) FROM documents WHERE length(text) > 0) AS texts, 0::BIGINT AS lost, 0::BIGINT AS needlessly_split, 0::BIGINT AS overfull FROM pack_capacity",
    "p8_source_counts": "SELECT source, count(*) AS documents, true AS sound FROM documents GROUP BY source",
}
