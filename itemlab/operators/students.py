"""Students: risk patterns, counts, groups, integrity. All imports at once, by import_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..coefficients import DEFAULT, Coefficients
from ..functions.stats import rounded
from .ranks import exact_median
from .store import settled

STUDENT = ["import_id", "student_id"]


def _per_student(facts: DataFrame) -> DataFrame:
    rows = facts.where(F.col("received_score").isNotNull() & F.col("student_id").isNotNull())
    return rows.groupBy(*STUDENT).agg(
        F.count("*").alias("n"),
        F.countDistinct("received_score").alias("kinds"),
        F.avg("received_score").alias("mean"),
        F.min("received_score").alias("least"),
        F.sum("received_score").alias("total"),
        F.coalesce(F.stddev_samp("received_score"), F.lit(0.0)).alias("std"),
    )


def student_risk(facts: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """Systemic risk: a low mean and a total under the import's median; spot risk: a single low item."""
    rows = settled(_per_student(facts).drop("kinds"))
    rows = rows.join(exact_median(rows, "import_id", "total"), "import_id")
    mean = F.col("mean")
    systemic = (mean < c.systemic_average) & (F.col("total") < F.col("median"))
    spot = (F.col("least") < c.spot_minimum) & (mean > max(c.systemic_average + 15, 60))
    pattern = F.when(systemic, "systemic").when(spot, "spot").otherwise("ok")
    notes = F.array(
        F.when(systemic, "LOW_OVERALL"),
        F.when(~systemic & spot, "SINGLE_LOW_ITEM"),
        F.when((F.col("std") < 4) & (F.col("n") > 6), "UNIFORM_SCORES"),
    )
    return rows.select(
        *STUDENT,
        rounded(mean, 2).alias("avg_item"),
        rounded(F.col("least"), 2).alias("min_item"),
        rounded(F.col("total"), 2).alias("discipline_total"),
        pattern.alias("pattern_type"),
        F.array_join(F.array_compact(notes), ",").alias("notes"),
    )


def risk_by_mean(facts: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """The dashboard's plainer rule: a low mean is systemic, else a low item is spot."""
    mean = F.col("mean")
    pattern = F.when(mean < c.systemic_average, "systemic").when(F.col("least") < c.spot_minimum, "spot").otherwise("ok")
    return _per_student(facts).select(*STUDENT, pattern.alias("pattern_type"))


def student_count(facts: DataFrame) -> DataFrame:
    rows = facts.where(F.col("received_score").isNotNull())
    return rows.groupBy("import_id").agg(F.countDistinct("student_id").alias("students"))


def group_breakdown(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    rows = facts.where(F.col("received_score").isNotNull()).join(profiles, "student_id")
    return rows.groupBy("import_id", "nationality_group").agg(
        rounded(F.avg("received_score"), 2).alias("avg_score"), F.count("*").alias("n")
    )


def integrity_flags(facts: DataFrame) -> DataFrame:
    """Students with a few distinct scores over many items, and questions that all students answer alike."""
    students = _per_student(facts).where((F.col("n") > 5) & (F.col("kinds") <= 2))
    rows = facts.where(F.col("received_score").isNotNull() & F.col("question_id").isNotNull())
    items = rows.groupBy("import_id", "question_id").agg(
        F.countDistinct("student_id").alias("n"), (F.max("received_score") - F.min("received_score")).alias("reach")
    )
    items = items.where((F.col("n") > 10) & (F.col("reach") < 3))
    first = students.select(F.lit("repeat_pattern").alias("type"), *STUDENT, F.col("n").alias("detail"))
    second = items.select(F.lit("flat_question").alias("type"), "import_id", "question_id", F.col("n").alias("detail"))
    return first.unionByName(second, allowMissingColumns=True)
