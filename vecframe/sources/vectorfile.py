"""Vectors from JSON: a list of vectors, or ``{"vectors": [...], "limit": n, "ttl": s}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(position, vector, limit, ttl)``; limit and ttl are null where the file does not give them."""
    text = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", "array<array<double>>")
    wrapped = F.from_json("value", "struct<vectors:array<array<double>>,limit:int,ttl:double>")
    is_list = F.ltrim("value").startswith("[")
    both = text.select(F.when(is_list, plain).otherwise(wrapped["vectors"]).alias("v"), F.when(~is_list, wrapped["limit"]).alias("limit"), F.when(~is_list, wrapped["ttl"]).alias("ttl"))
    return both.select(F.posexplode("v").alias("position", "vector"), "limit", "ttl")
