"""Mixes of documents by source: target shares of tokens, whole epochs first, the rest by weighted sampling.

A source's budget is its share of the mix's size. Its documents are all used as often as they fit in whole (epochs);
what is left of the budget goes to documents in the order of exponential keys divided by their quality weights
(Efraimidis and Spirakis), cut by a prefix sum of tokens. The prefix sum runs over a histogram of the keys first and
within one bucket of it last, so no source is ever sorted in one task. Buckets are steps of the keys' logarithm: whatever
the quality weights, an exponential key falls into a step of width w with a probability of at most w / e, so a bucket
holds no more than that share of its source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecframe.llm._common import Stage
from vecframe.llm.tokenize import VOCABULARY, token_counts

#: Buckets for each factor e of a source's keys: about 1 / (e * STEPS) of the source is in the fullest one.
STEPS = 2048


def text_quality(text: Column) -> Column:
    """A weight in (0, 1]: the share of letters in the text, of short texts less."""
    size = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.01), F.coalesce(letters / F.greatest(size, F.lit(1)) * F.least(F.lit(1.0), size / 400.0), F.lit(0.01)))


def _budgets(pdf: pd.DataFrame) -> pd.DataFrame:
    """Budgets of one mix: shares of the wanted size; what a source cannot supply goes to the others by weight."""
    pdf = pdf.sort_values("source").reset_index(drop=True)
    share = pdf.weight / pdf.weight.sum() if pdf.weight.sum() > 0 else pdf.weight * 0
    size = float(pdf.size_ratio.iloc[0] * pdf.all_tokens.iloc[0])
    most = (pdf.tokens * pdf.max_repeats).astype(float)
    budget = pd.Series(0.0, index=pdf.index)
    full = (most <= 0) | (share <= 0)
    left = size
    while left > 0.5 and not full.all():
        part = left * share.where(~full, 0) / share[~full].sum()
        over = ~full & (budget + part >= most)
        if not over.any():
            budget += part
            break
        left -= (most - budget)[over].sum()
        budget[over] = most[over]
        full |= over
    epochs = (budget // pdf.tokens.where(pdf.tokens > 0, 1)).astype("int64").clip(upper=pdf.max_repeats)
    rest = (budget - epochs * pdf.tokens).where(epochs < pdf.max_repeats, 0.0)
    return pd.DataFrame({"mix_name": pdf.mix_name, "source": pdf.source, "target_share": share, "target_tokens": share * size, "budget": budget, "epochs": epochs, "rest": rest})


class Mix:
    """The choice and the report of all mixes of a target table over one table of documents.

    Weights are relative; targets that are null, not positive, or without a source or a mix are left out, repeated ones
    count once (largest weight). Null and empty texts have no tokens and are never chosen; a null source is no
    target. A source that cannot supply its budget is used ``max_repeats`` times and its shortfall goes to the other
    sources by weight; a target without documents has the actual share 0. The choice depends on the ids and the seed
    only, not on partitions.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, seed: int = 7, quality: Column | None = None, steps: int = STEPS) -> None:
        t = F.col(text).cast("string")
        counted = documents.select(F.col(key).alias("id"), F.col("source").alias("source"), token_counts(t, vocabulary).cast("long").alias("tokens"), (quality if quality is not None else text_quality(t)).cast("double").alias("quality"))
        self.key = key
        self.docs = Stage(counted)
        docs = self.docs.df
        good = targets.where("mix_name is not null and source is not null and weight > 0 and max_repeats > 0 and size_ratio > 0")
        good = good.groupBy("mix_name", "source").agg(F.max(F.struct("weight", "max_repeats", "size_ratio")).alias("t")).select("mix_name", "source", "t.*")
        totals = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))
        everything = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
        # One row each, and one row per target.
        inputs = good.join(totals, "source", "left").fillna(0, ["tokens"]).withColumn("_one", F.lit(1)).join(everything.withColumn("_one", F.lit(1)), "_one").drop("_one")
        plan = inputs.groupBy("mix_name").applyInPandas(_budgets, "mix_name string, source string, target_share double, target_tokens double, budget double, epochs bigint, rest double")
        self.plan = Stage(plan)
        rows = docs.where("tokens > 0").join(self.plan.df.where("budget > 0").select("mix_name", "source", "epochs", "rest"), "source")
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_name", "id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        rows = rows.withColumn("k", -F.log(u) / F.col("quality")).withColumn("bucket", F.floor(F.log("k") * steps).cast("int"))
        sums = rows.where("rest > 0").groupBy("mix_name", "source", "bucket").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
        w = Window.partitionBy("mix_name", "source").orderBy("bucket")
        upto = sums.withColumn("upto", F.sum("t").over(w)).where("upto > rest")
        edge = upto.groupBy("mix_name", "source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("base"))).alias("e")).select("mix_name", "source", F.col("e.bucket").alias("edge"), F.col("e.base").alias("base"))
        placed = rows.join(edge, ["mix_name", "source"], "left")
        inside = placed.where("bucket = edge").withColumn("upto", F.col("base") + F.sum("tokens").over(Window.partitionBy("mix_name", "source").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)))
        at_edge = inside.select("mix_name", "source", "id", "tokens", (F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("long")).alias("repeats"))
        outside = placed.where("edge is null or bucket <> edge").select("mix_name", "source", "id", "tokens", (F.col("epochs") + ((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))).cast("long")).alias("repeats"))
        self.chosen = outside.unionByName(at_edge).where("repeats > 0")

    def choice(self) -> DataFrame:
        """``(mix_name, source, key, repeats, tokens)`` of the documents used."""
        return self.chosen.select("mix_name", "source", F.col("id").alias(self.key), "repeats", "tokens")

    def shares(self) -> DataFrame:
        """``(mix_name, source, target_share, actual_share, target_tokens, actual_tokens, documents, most_repeats)``."""
        used = self.chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
        out = self.plan.df.select("mix_name", "source", "target_share", "target_tokens").join(used, ["mix_name", "source"], "left").fillna(0, ["actual_tokens", "documents", "most_repeats"])
        total = F.sum("actual_tokens").over(Window.partitionBy("mix_name"))
        share = F.when(total > 0, F.col("actual_tokens") / total).otherwise(F.lit(0.0))
        return out.select("mix_name", "source", "target_share", share.alias("actual_share"), "target_tokens", "actual_tokens", "documents", "most_repeats")
