"""Changes of tables that are files: rows in, a new table out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row, by order, of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The existing rows and the first new row, by seq, of each key that isn't there."""
    first = first_rows(new, key, [seq]).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(first.select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key by seq; new rows win over existing ones."""
    columns = existing.columns
    both = existing.select(*columns, F.lit(0).alias("__new"), F.lit(None).cast(new.schema[seq].dataType).alias("__seq"))
    both = both.unionByName(new.select(*columns, F.lit(1).alias("__new"), F.col(seq).alias("__seq")))
    return first_rows(both, key, [F.desc("__new"), F.desc("__seq")]).select(*columns)


def update(existing: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows with the non-null values of changes (one row for each key)."""
    names = [c for c in changes.columns if c not in key]
    rows = existing.join(changes.select(*key, *(F.col(c).alias(f"__{c}") for c in names)), key, "left")
    return rows.select(*(F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in existing.columns))


def delete(existing: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return existing.join(keys, key, "left_anti")


def work_mapping(facts: DataFrame) -> DataFrame:
    """The work of each student on each question, with the first import that has it."""
    rows = facts.where(F.col("student_id").isNotNull() & F.col("question_id").isNotNull())
    rows = rows.groupBy("student_id", "question_id").agg(F.min("import_id").alias("import_id"))
    return rows.select(F.concat_ws("_", F.col("student_id").cast("string"), F.col("question_id").cast("string")).alias("work_id"), "*")


def linked(questions: DataFrame, chosen: DataFrame, topic_id: int) -> DataFrame:
    """Questions with the topic set for the chosen ones."""
    return update(questions, chosen.select("question_id").distinct().withColumn("syllabus_topic_id", F.lit(topic_id)), ["question_id"])


def mark_duplicate(questions: DataFrame, question_id: int, of: int) -> DataFrame:
    hit = F.col("question_id") == question_id
    return questions.withColumns(
        {"is_duplicate": F.when(hit, True).otherwise(F.col("is_duplicate")), "duplicate_of": F.when(hit, of).otherwise(F.col("duplicate_of"))}
    )


def write_partition(rows: DataFrame, path: str, by: str = "import_id") -> None:
    """Replaces the partitions that rows have, and only those."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def cache_is_valid(cached: DataFrame, expected: DataFrame) -> DataFrame:
    """For each import whether its cache has a row for each expected question."""
    a = cached.groupBy("import_id").agg(F.count("*").alias("cached"))
    b = expected.groupBy("import_id").agg(F.countDistinct("question_id").alias("expected"))
    both = b.join(a, "import_id", "left")
    return both.select("import_id", (F.coalesce("cached", F.lit(0)) == F.col("expected")).alias("valid"))


def append_partition(rows: DataFrame, path: str, by: str = "import_id") -> None:
    """Adds rows to the table; those of earlier imports stay."""
    rows.write.mode("append").partitionBy(by).parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes the table beside its place and puts it there once it is whole, so that readers never see a part.

    rows may read the table itself.
    """
    spark = rows.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(new)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def write_csv(rows: DataFrame, path: str, separator: str = ";") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def as_json(rows: DataFrame) -> DataFrame:
    """``json``: each row as an object, nulls included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def ensure_tables(spark: SparkSession, schemas: dict[str, str]) -> list[str]:
    """Creates the tables that the catalog lacks, empty; their names."""
    missing = [name for name in schemas if not spark.catalog.tableExists(name)]
    for name in missing:
        spark.createDataFrame([], schemas[name]).write.saveAsTable(name)
    return missing


def rows_of(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """The rows of a query with named parameters, which are values and never SQL."""
    return spark.sql(sql, args=parameters)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local session without that folder gets a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        place = spark.sparkContext.getCheckpointDir()
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame) -> DataFrame:
    """The rows, written once in the shared folder and read again, for several uses."""
    path = shared_path(rows.sparkSession, "settled")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def link_and_invalidate(questions: DataFrame, chosen: DataFrame, topic_id: int, caches: dict[str, DataFrame], import_id: int):
    """The linked questions, how many changed, and the caches without the import; an empty choice is an error."""
    keys = chosen.select("question_id").distinct()
    if keys.isEmpty():
        raise ValueError("no question is chosen")
    hit = questions.join(keys, "question_id", "left_semi")
    changed = hit.where(~F.col("syllabus_topic_id").eqNullSafe(F.lit(topic_id))).count()
    left = {name: rows.where(F.col("import_id") != import_id) for name, rows in caches.items()}
    return linked(questions, chosen, topic_id), changed, left


def rebuilt(cache: DataFrame, fresh: DataFrame, import_id: int) -> DataFrame:
    """The cache with the import's rows replaced by fresh ones."""
    return cache.where(F.col("import_id") != import_id).unionByName(fresh.where(F.col("import_id") == import_id).select(*cache.columns))
