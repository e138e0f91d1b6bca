"""Retrieval and explanation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_complete, patient_text, readability


def retrieval_metrics(cases: DataFrame, found: DataFrame, by: list[str] | None = None, k: int = 3) -> DataFrame:
    """Cases (query_id, expected) against found (query_id, rank, tags): n, precision at 1, recall at k, misses."""
    hit = F.array_contains("tags", F.col("expected"))
    scored = cases.join(found, "query_id", "left").groupBy("query_id", *(by or [])).agg(
        F.coalesce(F.max((hit & (F.col("rank") == 1)).cast("int")), F.lit(0)).alias("first"),
        F.coalesce(F.max((hit & (F.col("rank") <= k)).cast("int")), F.lit(0)).alias("any"),
    )
    group = scored.groupBy(*by) if by else scored.groupBy()
    return group.agg(F.count(F.lit(1)).alias("n"), F.avg("first").alias("precision_at_1"), F.avg("any").alias("recall_at_k"), F.sum(1 - F.col("any")).alias("misses"))


def rejection_rate(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Share of out-of-corpus cases (query_id) for which nothing was found."""
    return cases.join(found.select("query_id").distinct().withColumn("_hit", F.lit(1)), "query_id", "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_hit").isNull().cast("int")).alias("rejected"))


def score_explanations(rows: DataFrame) -> DataFrame:
    """rows with patient_text, complete and fk_grade."""
    text = patient_text("what_it_measures", "lifestyle_suggestions", "gp_question")
    return rows.withColumns({"patient_text": text, "complete": is_complete("what_it_measures", "lifestyle_suggestions", "gp_question")}).withColumn("fk_grade", readability("patient_text")["grade"])


def rollup_metrics(rows: DataFrame, category: str, passed: Column, complete: Column, grade: Column) -> DataFrame:
    """Per category and Overall: n, percentages and mean grade to one decimal; null grades are skipped."""
    pct = lambda c: F.round(100 * F.avg(c.cast("int")), 1)
    rows = rows.withColumn("_c", F.coalesce(category, F.lit("unknown")))
    out = rows.rollup("_c").agg(F.grouping("_c").alias("_g"), F.count(F.lit(1)).alias("n"), pct(passed).alias("accuracy_pct"), pct(complete).alias("completeness_pct"), F.round(F.avg(grade), 1).alias("fk_grade"))
    return out.select(F.when(F.col("_g") == 1, "Overall").otherwise(F.col("_c")).alias("category"), "n", "accuracy_pct", "completeness_pct", "fk_grade")


def generation_metrics(rows: DataFrame) -> DataFrame:
    """One row: tests, grounded ones, and the mean grade of the grounded (0 without any)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("grounded").alias("n_grounded"), F.coalesce(F.avg(F.when(F.col("grounded"), F.col("fk_grade"))), F.lit(0.0)).alias("mean_grade"))
