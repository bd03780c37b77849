"""Items: quality, correlation, discrimination, ranking, weights. All imports at once, by import_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..coefficients import DEFAULT, Coefficients
from ..functions.stats import clamped, pearson, rounded

ITEM = ["import_id", "question_id"]


def scored(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("received_score").isNotNull() & F.col("question_id").isNotNull())


def _maximum(c: Coefficients) -> Column:
    return F.coalesce(F.nullif("max_score", F.lit(0.0)), F.lit(c.default_maximum))


def figures(facts: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """``import_id, question_id, n, mean, std, passed, students``: attempts with a score, their mean, deviation and share of passes, and all students."""
    score = F.col("received_score")
    return facts.where(F.col("question_id").isNotNull()).groupBy(*ITEM).agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"),
        F.avg(F.when(score >= c.pass_mark, 1.0).when(score.isNotNull(), 0.0)).alias("passed"),
        F.countDistinct("student_id").alias("students"),
    )


def _means(facts: DataFrame, questions: DataFrame, c: Coefficients) -> DataFrame:
    """Attempts, mean, deviation, share of passes and share of the maximum of each item."""
    return _with_ratio(figures(scored(facts), c).drop("students"), questions, c)


def _with_ratio(own: DataFrame, questions: DataFrame, c: Coefficients) -> DataFrame:
    own = own.join(questions.select("question_id", "max_score"), "question_id", "left")
    maximum = _maximum(c)
    return own.withColumn("ratio", F.when(maximum > 0, F.col("mean") / maximum).otherwise(0.0))


def item_quality(facts: DataFrame, questions: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """Easy, hard and normal items by the share of the maximum that is reached; the unrounded mean decides."""
    return quality_of(figures(scored(facts), c), questions, c)


def quality_of(own: DataFrame, questions: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """item_quality from figures; items without scores have none."""
    flag = F.when(F.col("ratio") >= c.easy, "too_easy").when(F.col("ratio") <= c.hard, "too_hard").otherwise("normal")
    return _with_ratio(own.where("n > 0"), questions, c).select(
        *ITEM,
        "n",
        rounded(F.col("mean"), 2).alias("mean_score"),
        rounded(F.col("std"), 2).alias("std_score"),
        rounded(F.col("passed"), 3).alias("p_correct"),
        rounded(100 * (1 - F.col("ratio")), 1).alias("difficulty_pct"),
        flag.alias("flag"),
    )


def item_total_correlation(facts: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """Correlation of an item with the rest of the student's total; attempts repeated are rows of their own."""
    rows = scored(facts).where(F.col("student_id").isNotNull())
    total = F.sum("received_score").over(Window.partitionBy("import_id", "student_id"))
    rows = rows.withColumn("rest", total - F.col("received_score"))
    r = rounded(pearson(F.col("received_score"), F.col("rest"), 4, 1e-9), 4)
    out = rows.groupBy(*ITEM).agg(r.alias("r"))
    return out.withColumn("flag", F.when(F.abs("r") < c.low_correlation, "low_corr").otherwise("ok"))


def discrimination_index(facts: DataFrame, c: Coefficients = DEFAULT, least: int | None = None) -> DataFrame:
    """Correlation of an item's scores with the students' means, for the items of each import.

    The figures themselves are over all imports: attempts without a score count, as 0.
    """
    score = F.coalesce("received_score", F.lit(0.0))
    rows = facts.where(F.col("question_id").isNotNull())
    students = facts.where(F.col("student_id").isNotNull()).groupBy("student_id")
    students = students.agg(F.coalesce(F.avg("received_score"), F.lit(0.0)).alias("ability"))
    pairs = rows.join(students, "student_id", "left").withColumn("score", score)
    ability = F.coalesce("ability", F.lit(0.0))
    own = pairs.groupBy("question_id").agg(
        F.count("*").alias("attempts"), rounded(pearson(F.col("score"), ability, 2, 0.0), 3).alias("discrimination")
    )
    own = own.where(F.col("attempts") >= (c.min_students if least is None else max(2, least)))
    value = F.col("discrimination")
    label = F.when(value >= c.discrimination_strong, "strong").when(value >= c.discrimination_medium, "medium").otherwise("weak")
    return rows.select(*ITEM).distinct().join(own.withColumn("label", label), "question_id").select(
        *ITEM, "discrimination", "label"
    )


def question_metrics(facts: DataFrame, questions: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """What the rules of classification look at, for each question over all imports; zeros without attempts."""
    own = facts.where(F.col("question_id").isNotNull()).groupBy("question_id")
    own = own.agg(F.count("*").alias("attempts"), F.avg("received_score").alias("mean"))
    index = discrimination_index(facts, c, 2).select("question_id", "discrimination").distinct()
    rows = questions.select("question_id", "max_score").join(own, "question_id", "left").join(index, "question_id", "left")
    none = F.coalesce("attempts", F.lit(0)) == 0
    return rows.select(
        "question_id",
        rounded(F.coalesce("mean", F.lit(0.0)), 2).alias("avg_score"),
        F.when(none, 0.0).otherwise(rounded(1 - F.coalesce("mean", F.lit(0.0)) / _maximum(c), 3)).alias("difficulty_index"),
        F.coalesce("discrimination", F.lit(0.0)).alias("discrimination_index"),
        F.when(none, 0.0).otherwise(1.0).alias("reliability"),
        F.coalesce("attempts", F.lit(0)).alias("total_attempts"),
    )


def item_ranking(facts: DataFrame, questions: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """A score of each item from its passes, discrimination and difficulty, and what to do with it."""
    rows = item_quality(facts, questions, c).join(discrimination_index(facts, c), ITEM, "left")
    index = clamped(F.coalesce("discrimination", F.lit(0.0)), 0.0, 30.0)
    flagged = F.when(F.col("flag") != "normal", 15.0).otherwise(0.0)
    score = 40 * F.col("p_correct") + index + 0.15 * (100 - F.col("difficulty_pct")) - flagged
    advice = F.when(F.col("flag") == "too_easy", "make_harder").when(F.col("flag") == "too_hard", "revise").otherwise("keep")
    advice = F.concat(advice, F.when(F.col("label") == "weak", "+check_discrimination").otherwise(""))
    return rows.select(*ITEM, rounded(score, 1).alias("quality_score"), advice.alias("recommendation"))


def item_weights(facts: DataFrame, questions: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """Weights of an import's items, by difficulty, as shares of 100."""
    rows = item_quality(facts, questions, c)
    weight = clamped(F.col("difficulty_pct") / 100, 0.15, 1.5).cast("decimal(18,6)")
    rows = rows.withColumn("w", weight)
    totals = rows.groupBy("import_id").agg(F.sum("w").alias("total"))  # an import is too large for one window
    rows = rows.join(totals, "import_id")
    share = 100 * F.col("w").cast("double") / F.col("total").cast("double")
    return rows.select(*ITEM, rounded(share, 2).alias("weight_pct"))


def stat_gate(facts: DataFrame, questions: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """Items that deserve the expensive analyses; all items of an import none of which does."""
    rows = scored(facts)
    students = rows.groupBy(*ITEM).agg(F.countDistinct("student_id").alias("students"))
    rows = _means(facts, questions, c).join(students, ITEM)
    hot = (F.col("ratio") >= c.easy) | (F.col("ratio") <= c.hard) | (F.col("students") < c.validation_attempts)
    rows = rows.withColumn("flagged", hot)
    some = rows.groupBy("import_id").agg(F.bool_or("flagged").alias("some"))
    return rows.join(some, "import_id").where(F.col("flagged") | ~F.col("some")).select(*ITEM, "flagged")
