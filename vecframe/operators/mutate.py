"""Insert-or-replace and delete as DataFrame rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_of(delta: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """Of rows of one key the last by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return delta.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with their key and are added otherwise (a key once in ``delta``)."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta, allowMissingColumns=True)


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")
