"""Cached results by import, brought up to date by what has changed.

A cache is a table partitioned by import. Beside each partition stands the fingerprint of the rows
it was made of; a refresh computes the imports whose fingerprints differ, and only those.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..coefficients import DEFAULT, Coefficients
from . import alignment
from .store import settled, write_partition


def _hashed(rows: DataFrame) -> Column:
    return F.xxhash64(*(F.col(c) for c in sorted(rows.columns)))


def _added(name: str) -> Column:
    """Sums of hashes as decimals, which are exact for any number of rows."""
    return F.sum(F.col(name).cast("decimal(38,0)")).alias(name)


def by_question(facts: DataFrame) -> DataFrame:
    """``import_id, question_id, mean, students, n, high, low``: all that a refresh takes from the facts, in one scan.

    n rows whose hashes' halves add up to high and low, which are longs.
    """
    rows = facts.withColumn("__hash", _hashed(facts))
    return rows.groupBy("import_id", "question_id").agg(
        F.avg("received_score").alias("mean"), F.countDistinct("student_id").alias("students"), F.count("*").alias("n"),
        F.sum(F.shiftright("__hash", 32)).alias("high"), F.sum(F.col("__hash").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
    )


def fingerprints(own: DataFrame, questions: DataFrame, topics: DataFrame) -> DataFrame:
    """``import_id, fingerprint`` of each import: of its facts (own is by_question of them), their questions, and these questions' topics, in any order of rows."""
    of_topics = topics.select("syllabus_topic_id", _hashed(topics).alias("topics"))
    of_questions = questions.select("question_id", "syllabus_topic_id", _hashed(questions).alias("questions")).join(of_topics, "syllabus_topic_id", "left")
    linked = own.select("import_id", "question_id").join(of_questions, "question_id")
    linked = linked.groupBy("import_id").agg(_added("questions"), _added("topics"))
    out = own.groupBy("import_id").agg(F.sum("n").alias("n"), _added("high"), _added("low")).join(linked, "import_id", "left")
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("n", "high", "low", "questions", "topics"))
    return out.select("import_id", F.sha2(F.concat_ws(" ", *parts), 256).alias("fingerprint"))


class Cache:
    """A table in a folder, partitioned by import."""

    def __init__(self, spark, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _read(self, name: str, schema: str) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def rows(self, import_id: int | None = None) -> DataFrame:
        """The cached rows, of an import if one is given: of the others nothing is read."""
        out = self._read("rows", self.schema)
        return out if import_id is None else out.where(F.col("import_id") == import_id)

    def stale(self, now: DataFrame) -> list[int]:
        """Imports whose fingerprint isn't the cache's; a number for each import, of which there are as many as files were sent."""
        known = self._read("fingerprints", "fingerprint string, import_id int")
        changed = now.join(known, ["import_id", "fingerprint"], "left_anti").select("import_id")
        return sorted(r.import_id for r in changed.collect())

    def refresh(self, now: DataFrame, compute: Callable[[list[int]], DataFrame]) -> list[int]:
        """Computes the stale imports and puts their rows in the place of the cached ones; which they were.

        The fingerprint is written last, so that an import whose refresh failed is stale still.
        """
        stale = self.stale(now)
        if stale:
            write_partition(compute(stale), f"{self.path}/rows")
            write_partition(now.where(F.col("import_id").isin(stale)), f"{self.path}/fingerprints")
        return stale


#: The caches of validation and of alignment.
VALIDATION = "question_id long, title string, topic_code string, keyword_coverage double, tfidf_score double, semantic_similarity double, combined_score double, avg_score double, attempts long, issues string, status string, import_id int"
ALIGNMENT = "question_id long, syllabus_topic_id int, title string, discipline_name string, text_similarity double, semantic_similarity double, combined_score double, alignment_level string, average_score double, student_attempts long, import_id int"


def refresh_caches(
    validation: Cache, aligned: Cache, facts: DataFrame, questions: DataFrame, topics: DataFrame, semantic: DataFrame | None = None, c: Coefficients = DEFAULT
) -> dict[str, list[int]]:
    """Brings the cache of validation up to date, then that of alignment; the imports that each of them computed."""
    topics = settled(topics)  # a row for each topic
    own = settled(by_question(facts))
    now = settled(fingerprints(own, questions, topics))
    texts = cache(lambda: settled(alignment.linked_texts(questions, topics, semantic, c)))  # once for both, if anything is stale
    of = lambda ids: own.where(F.col("import_id").isin(ids))
    return {
        "validation": validation.refresh(now, lambda ids: alignment.validation_of(of(ids), texts(), c)),
        "alignment": aligned.refresh(now, lambda ids: alignment.alignment_of(of(ids), texts(), c)),
    }
