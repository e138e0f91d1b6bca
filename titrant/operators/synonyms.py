"""Generated alias keys: what is asked for, which proposals are accepted, and why the others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alias_key

SHOWN = 20  # of each kind of rejected keys in a report


def topics(chunks: DataFrame, ids: str = "test_ids", topic: str = "topic") -> DataFrame:
    """test_id, topics (sorted, distinct)."""
    return chunks.select(F.explode(ids).alias("test_id"), topic).groupBy("test_id").agg(F.sort_array(F.collect_set(topic)).alias("topics"))


def unasked(topics: DataFrame, asked: DataFrame, force: bool = False) -> DataFrame:
    """test_id, topics that no run has asked for yet (all with ``force``). asked: test_id."""
    return topics if force else topics.join(asked.select("test_id"), "test_id", "left_anti")


def judged(proposals: DataFrame, existing: DataFrame) -> DataFrame:
    """alias_key, test_id (the smallest proposed), n_ids, existing_id, verdict (accepted, ambiguous, collision) of each key of
    proposals (alias, test_id): ambiguous if it names several ids, a collision if it is an alias of another already."""
    keyed = proposals.select(alias_key("alias").alias("alias_key"), "test_id").where("alias_key != ''").distinct()
    one = keyed.groupBy("alias_key").agg(F.min("test_id").alias("test_id"), F.count(F.lit(1)).alias("n_ids"))
    known = existing.select(F.col("alias_key").alias("_k"), F.col("test_id").alias("existing_id"))
    out = one.join(known, F.col("alias_key") == F.col("_k"), "left").drop("_k")
    verdict = F.when(F.col("n_ids") > 1, "ambiguous").when(F.col("existing_id").isNotNull() & (F.col("existing_id") != F.col("test_id")), "collision").otherwise("accepted")
    return out.withColumn("verdict", verdict)


def accept(proposals: DataFrame, existing: DataFrame) -> DataFrame:
    """alias_key, test_id of proposals (alias, test_id) that name one id only and contradict no existing alias."""
    return judged(proposals, existing).where("verdict = 'accepted'").select("alias_key", "test_id")


def rejected(judgements: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first ``shown`` keys of each kind of rejection, by key: a report."""
    bad = judgements.where("verdict != 'accepted'")
    kinds = [bad.where(F.col("verdict") == v).orderBy("alias_key").limit(shown) for v in ("ambiguous", "collision")]
    return kinds[0].unionByName(kinds[1])
