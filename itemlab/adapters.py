"""The examination tables, derived from the driver tables; in each case with the same table in SQL.

A line item is a student's attempt at a question: the order is the student, the part the question,
the return flag the import. Scores are whole numbers, so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazily read examination tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def facts(self) -> DataFrame:
        items = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
        part = self.read("part").select("p_partkey", "p_brand")
        rows = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
        question, student = F.col("l_partkey"), F.col("l_orderkey")
        score = F.col("l_quantity").cast("int") + 25 + (question % 7 - 3) * 15 + (student % 11 - 5) * 5
        return rows.select(
            (student * 10 + F.col("l_linenumber")).alias("raw_id"),
            F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("import_id"),
            F.col("l_suppkey").alias("exam_id"),
            F.col("p_brand").alias("discipline_name"),
            question.alias("question_id"),
            student.alias("student_id"),
            F.least(F.greatest(score, F.lit(0)), F.lit(100)).cast("double").alias("received_score"),
        )

    def questions(self) -> DataFrame:
        topic = F.when(F.col("p_size") <= 40, F.col("p_size"))
        return self.read("part").select(
            F.col("p_partkey").alias("question_id"),
            F.concat_ws(" ", "p_name", "p_type").alias("question_text"),
            F.when(F.col("p_partkey") % 50 != 0, F.when(F.col("p_partkey") % 3 == 0, 80.0).otherwise(100.0)).alias("max_score"),
            topic.alias("syllabus_topic_id"),
        )

    def topics(self) -> DataFrame:
        part = self.read("part").where("p_size <= 40").groupBy(F.col("p_size").alias("syllabus_topic_id"))
        return part.agg(
            F.min("p_name").alias("title"),
            F.concat(F.lit("T"), F.col("p_size")).alias("topic_code"),
            F.array_join(F.array_sort(F.collect_set(F.lower("p_type"))), ", ").alias("keywords"),
            F.min("p_brand").alias("discipline_name"),
        )

    def profiles(self) -> DataFrame:
        nation = self.read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        customer = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nation, "c_nationkey")
        orders = self.read("orders").select("o_orderkey", "o_custkey")
        return orders.join(customer, "o_custkey").select(F.col("o_orderkey").alias("student_id"), F.col("n_name").alias("nationality_group"))

    def criteria(self) -> DataFrame:
        """Criteria are event types, with weights."""
        names = self.read("events").select(F.col("event_type").alias("name")).distinct()
        return names.select(
            (F.ascii("name") * 1000 + F.length("name")).alias("criteria_id"), "name", (20.0 + F.length("name")).alias("weight_percent")
        )

    def details(self) -> DataFrame:
        value = F.floor(F.col("value"))
        return self.read("events").select(
            F.col("event_id"),
            F.concat_ws("_", F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string")).alias("work_id"),
            (F.ascii("event_type") * 1000 + F.length("event_type")).alias("criteria_id"),
            value.cast("double").alias("score"),
        )

    def works(self) -> DataFrame:
        """Work of a student on a question, with the import it came with."""
        rows = self.details().select("work_id").distinct()
        parts = F.split("work_id", "_")
        rows = rows.select("work_id", parts[0].cast("long").alias("student_id"), parts[1].cast("long").alias("question_id"))
        return rows.withColumn("import_id", (F.col("question_id") % 3 + 1).cast("int"))

    def answers(self) -> DataFrame:
        labels = self.read("labels").select("doc_id", "toxic")
        docs = self.read("documents").join(labels, "doc_id", "left")
        return docs.select(
            F.col("doc_id").alias("answer_id"),
            (F.col("doc_id") % 3 + 1).cast("int").alias("import_id"),
            F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("work_id"),
            F.col("lang").alias("language"),
            F.col("text").alias("answer_text"),
            (F.col("n_chars") % 101).cast("double").alias("final_score"),
            F.coalesce(F.col("toxic") * 15.0, F.lit(0.0)).alias("plagiarism_penalty"),
        )

    def imports(self) -> DataFrame:
        """The log of imports: one for each return flag, and one without rows."""
        rows = self.facts().groupBy("import_id").agg(F.count("*").alias("rows_imported"))
        rows = rows.select("import_id", F.concat(F.lit("results_"), "import_id", F.lit(".csv")).alias("source_filename"), F.lit("exam_results_upload").alias("import_type"), "rows_imported")
        empty = self.spark.createDataFrame([(9, "empty.csv", "exam_results_upload", 0)], rows.schema)
        return rows.union(empty)


#: The same tables for SQL, as common table expressions.
SQL = {
    "facts": """facts AS (SELECT l_orderkey * 10 + l_linenumber AS raw_id,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS import_id, l_suppkey AS exam_id,
  p_brand AS discipline_name, l_partkey AS question_id, l_orderkey AS student_id,
  CAST(least(greatest(CAST(l_quantity AS INT) + 25 + (l_partkey % 7 - 3) * 15 + (l_orderkey % 11 - 5) * 5, 0), 100) AS DOUBLE)
    AS received_score FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "questions": """questions AS (SELECT p_partkey AS question_id, p_name || ' ' || p_type AS question_text,
  CASE WHEN p_partkey % 50 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 80.0::DOUBLE ELSE 100.0::DOUBLE END END AS max_score,
  CASE WHEN p_size <= 40 THEN p_size END AS syllabus_topic_id FROM part)""",
    "topics": """topics AS (SELECT p_size AS syllabus_topic_id, min(p_name) AS title, 'T' || p_size AS topic_code,
  array_to_string(list_sort(list(DISTINCT lower(p_type))), ', ') AS keywords, min(p_brand) AS discipline_name
  FROM part WHERE p_size <= 40 GROUP BY p_size)""",
    "imports": """imports AS (SELECT import_id, 'results_' || import_id || '.csv' AS source_filename, 'exam_results_upload' AS import_type,
  count(*) AS rows_imported FROM facts GROUP BY 1 UNION ALL SELECT 9, 'empty.csv', 'exam_results_upload', 0)""",
    "profiles": """profiles AS (SELECT o_orderkey AS student_id, n_name AS nationality_group
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "criteria": """criteria AS (SELECT ascii(name) * 1000 + length(name) AS criteria_id, name AS criteria_key, name, 20.0 + length(name) AS weight_percent
  FROM (SELECT DISTINCT event_type AS name FROM events))""",
    "details": """details AS (SELECT event_id, user_id || '_' || event_id % 97 AS work_id, event_type AS criteria_key,
  floor(value) AS score FROM events)""",
    "works": """works AS (SELECT work_id, CAST(split_part(work_id, '_', 1) AS BIGINT) AS student_id,
  CAST(split_part(work_id, '_', 2) AS BIGINT) AS question_id,
  CAST(CAST(split_part(work_id, '_', 2) AS BIGINT) % 3 + 1 AS INT) AS import_id FROM (SELECT DISTINCT work_id FROM details))""",
    "answers": """answers AS (SELECT d.doc_id AS answer_id, CAST(d.doc_id % 3 + 1 AS INT) AS import_id, 'w' || d.doc_id AS work_id, lang AS language,
  text AS answer_text, CAST(n_chars % 101 AS DOUBLE) AS final_score, coalesce(toxic * 15.0, 0.0)::DOUBLE AS plagiarism_penalty
  FROM documents d LEFT JOIN labels l USING (doc_id))""",
}


def with_tables(*names: str, more: str = "") -> str:
    """The beginning of a SQL query over these tables."""
    parts = [SQL[n] for n in names] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n"
