"""Queries of the training-data operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecframe.llm._common import table
from vecframe.llm.cluster import cluster, components
from vecframe.llm.knn import knn
from vecframe.llm.mixing import Mix
from vecframe.llm.neardup import near_duplicates
from vecframe.llm.spam import spam_pages, spam_shapes
from vecframe.llm.split import split_oversized
from vecframe.llm.truncation import truncated, truncation_by_source
from vecframe.llm.tokenize import encode_corpus


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "doc_entities"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cut = split_oversized(table(spark, d, "doc_entities"), table(spark, d, "split_limits"), with_text=False)
    return cut.where("piece = 1").select("id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "doc_entities"), table(spark, d, "split_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn(table(spark, d, "doc_entities"), table(spark, d, "knn_probes").select("id"))
    return near.select(F.least("query_id", "id").alias("id_a"), F.greatest("query_id", "id").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Ten neighbours of every record whose id is divisible by 100, among all records."""
    entities = table(spark, d, "doc_entities")
    return knn(entities, entities.where("id % 100 = 0").select("id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "doc_entities")).where("cut").select("id", "field_name")


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation_by_source(table(spark, d, "doc_entities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components(table(spark, d, "doc_entities"), 0.68)


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster(table(spark, d, "doc_entities"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).choice()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents")).where("spam").select("doc_id")


def p8_shapes(spark: SparkSession, d: str) -> DataFrame:
    return spam_shapes(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p4_found": p4_found, "p4_sources": p4_sources, "p5_found": p5_found, "p5_clusters": p5_clusters, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p2_found": p2_found, "p2_pieces": p2_pieces, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_shapes": p8_shapes}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            SELECT DISTINCT e.id FROM doc_entities e JOIN split_limits l USING (partition_name)
            WHERE length(e.content) > l.max_chars
        """,
    }
