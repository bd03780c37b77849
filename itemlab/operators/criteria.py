"""Criteria and free-text answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rounded


def scoped(rows: DataFrame, import_id: int | None) -> DataFrame:
    """The rows of an import, or all rows if it has none."""
    if import_id is None:
        return rows
    inside = rows.where(F.col("import_id") == import_id)  # reaches the scan
    return rows if inside.isEmpty() else inside


def criteria_performance(details: DataFrame, criteria: DataFrame, works: DataFrame, import_id: int | None = None) -> DataFrame:
    rows = scoped(details.join(works.select("work_id", "import_id"), "work_id"), import_id)
    rows = rows.join(criteria, "criteria_id").groupBy("criteria_id", "name", "weight_percent").agg(
        F.avg("score").alias("mean"), F.count("*").alias("evaluations"), F.min("score").alias("min_score"),
        F.max("score").alias("max_score"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"),
    )
    mean = F.col("mean")
    level = F.when(mean >= 85, "excellent").when(mean >= 70, "good").when(mean >= 50, "satisfactory").otherwise("poor")
    return rows.select(
        "criteria_id", "name", "weight_percent", rounded(mean, 2).alias("avg_score"), "evaluations", "min_score", "max_score",
        rounded(F.col("std"), 2).alias("std_score"), level.alias("performance_level"),
    )


def answers_by_language(answers: DataFrame, import_id: int | None = None) -> DataFrame:
    """Answers, scores and penalties by language; a penalty counts as plagiarism."""
    copied = F.count_if(F.col("plagiarism_penalty") > 0)
    return scoped(answers, import_id).groupBy("language").agg(
        F.count("*").alias("total_answers"),
        rounded(F.avg("final_score"), 2).alias("avg_score"),
        rounded(F.avg("plagiarism_penalty"), 2).alias("avg_penalty"),
        copied.alias("plagiarism_count"),
        rounded(100 * copied / F.count("*"), 2).alias("plagiarism_rate"),
    )


def criteria_by_question(details: DataFrame, criteria: DataFrame, works: DataFrame, import_id: int | None = None) -> DataFrame:
    """For each question its criteria with mean and evaluations, as an array of structs."""
    rows = scoped(details.join(works.select("work_id", "import_id", "question_id"), "work_id"), import_id)
    rows = rows.join(criteria.select("criteria_id", "name"), "criteria_id").groupBy("question_id", "criteria_id", "name")
    rows = rows.agg(rounded(F.avg("score"), 2).alias("avg"), F.count("*").alias("evaluations"))
    entry = F.struct("name", "criteria_id", "avg", "evaluations")
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("criteria"))
