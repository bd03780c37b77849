"""Caches follow what has changed, and nothing else."""

import os

from pyspark.sql import functions as F

from itemlab.adapters import Tables
from itemlab.operators import alignment, caches

SF = "/root/testdata/sf0.001"


def files_of(path):
    return sorted((d, f, os.path.getmtime(f"{d}/{f}")) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_refresh(spark, tmp_path):
    t = Tables(spark, SF)
    facts, questions, topics = t.facts(), t.questions(), t.topics()
    v, a = caches.Cache(spark, f"{tmp_path}/v", caches.VALIDATION), caches.Cache(spark, f"{tmp_path}/a", caches.ALIGNMENT)
    assert v.rows().count() == 0 and v.rows(1).columns == a.rows().columns[:0] + v.rows().columns
    run = lambda f=facts, q=questions, tp=topics: caches.refresh_caches(v, a, f, q, tp)
    assert run() == {"validation": [1, 2, 3], "alignment": [1, 2, 3]}
    before = files_of(tmp_path)
    assert run(facts.repartition(3)) == {"validation": [], "alignment": []} and files_of(tmp_path) == before  # nothing is written
    fewer = facts.where("import_id <> 2 OR raw_id % 5 <> 0")
    assert run(fewer) == {"validation": [2], "alignment": [2]}
    kept = [f for f in files_of(tmp_path) if "import_id=2" not in f[0]]
    assert kept == [f for f in before if "import_id=2" not in f[0]]
    key = ["import_id", "question_id"]
    want = sorted(map(str, alignment.validation(fewer, questions, topics).select(*key, "status", "attempts", "combined_score").collect()))
    assert sorted(map(str, v.rows().select(*key, "status", "attempts", "combined_score").collect())) == want
    # a question's link and a topic's words make the imports with it stale
    one = fewer.where("import_id = 1").join(questions.where("syllabus_topic_id IS NOT NULL"), "question_id").first().question_id
    holders = sorted(r.import_id for r in fewer.where(F.col("question_id") == one).select("import_id").distinct().collect())
    changed = questions.withColumn("syllabus_topic_id", F.when(F.col("question_id") == one, 39).otherwise(F.col("syllabus_topic_id")))
    assert run(fewer, changed)["validation"] == holders
    plan = v.rows(3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(import_id" in plan


def test_a_failed_refresh_stays_stale(spark, tmp_path):
    cache = caches.Cache(spark, str(tmp_path / "c"), "x long, import_id int")
    now = spark.createDataFrame([(1, "a"), (2, "b")], "import_id int, fingerprint string")
    rows = spark.createDataFrame([(5, 1), (6, 2)], "x long, import_id int")

    def broken(ids):
        raise OSError("lost")

    try:
        cache.refresh(now, broken)
    except OSError:
        pass
    assert cache.stale(now) == [1, 2]
    assert cache.refresh(now, lambda ids: rows) == [1, 2] and cache.stale(now) == []
    later = spark.createDataFrame([(1, "a"), (2, "c")], "import_id int, fingerprint string")
    assert cache.refresh(later, lambda ids: rows.where(F.col("import_id").isin(ids)).withColumn("x", F.col("x") * 10)) == [2]
    assert sorted(tuple(r) for r in cache.rows().select("import_id", "x").collect()) == [(1, 5), (2, 60)]
