"""Numbering, medians and reliability of groups that no task holds, against brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemlab.operators import imports, ranks, reliability


def data(spark, n=6000):
    rng = random.Random(3)
    kinds = {
        "normal": lambda k: rng.gauss(50, 20), "ties": lambda k: float(rng.choice([1, 2, 2, 2, 3])), "one": lambda k: 7.0,
        "far": lambda k: rng.choice([-1e300, 1e300, rng.random()]), "even": lambda k: float(k), "few": lambda k: float(k),
    }
    rows = [(g, k, f(k)) for g, f in kinds.items() for k in range(3 if g == "few" else n - (g == "normal"))]
    rows += [("nothing", 1, None), ("normal", -1, None), (None, 1, 4.0), (None, 2, 5.0)]
    return rows, spark.createDataFrame(rows, "g string, id long, v double").repartition(7)


@pytest.mark.parametrize("limit", [1, 50, 1_000_000])
def test_median_against_sorting(spark, limit):
    rows, df = data(spark)
    want = {g: statistics.median(v for h, _, v in rows if h == g and v is not None) for g in {r[0] for r in rows} if g not in ("nothing", None)}
    got = {r.g: r.median for r in ranks.exact_median(df, "g", "v", limit).collect()}
    assert {g: m for g, m in got.items() if g is not None} == want
    assert ranks.exact_median(df.where("false"), "g", "v", limit).count() == 0


def test_numbering(spark):
    rows, df = data(spark, 500)
    got = ranks.numbered(df, ["g"], ["v", "id"]).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] if r[2] is not None else 0, r[1]))
        assert [(r.v, r.id) for r in sorted((x for x in got if x.g == g), key=lambda x: x.position)] == [(r[2], r[1]) for r in own]
        assert sorted(x.position for x in got if x.g == g) == list(range(1, len(own) + 1))


def test_numbering_deals_one_group_over_tasks(spark):
    df = spark.range(40_000).select(F.lit(1).alias("g"), F.reverse(F.col("id").cast("string")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranks.numbered(df, ["g"], ["k"])
        sizes = [r["count"] for r in df.repartitionByRange("g", "k").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 20_000
    assert tuple(out.agg(F.max("position"), F.count_distinct("position")).first()) == (40_000, 40_000)


def test_zip_by_position(spark):
    left = spark.createDataFrame([(1, k) for k in range(5)] + [(2, 9)], "g int, a int")
    right = spark.createDataFrame([(1, k) for k in "xyz"] + [(2, "p"), (2, "q"), (3, "r")], "g int, b string")
    got = sorted((r.g, r.position, r.a, r.b) for r in imports.by_position(left, ["a"], right, [F.desc("b")], ["g"]).collect())
    assert got == [(1, 1, 0, "z"), (1, 2, 1, "y"), (1, 3, 2, "x"), (2, 1, 9, "q")]


def exam(spark, students, items, exam_id="e"):
    s, q = F.col("id") % students, F.floor(F.col("id") / students)
    score = F.floor(F.pmod(F.xxhash64(s), 40) + F.pmod(F.xxhash64(s, q), 60)).cast("double")
    return spark.range(students * items).select(F.lit(exam_id).alias("exam_id"), s.alias("student_id"), q.alias("question_id"), score.alias("score"), F.lit(1).alias("seq"))


@pytest.mark.parametrize("block,cells,batch", [(128, 1 << 22, 1 << 22), (4, 40, 100), (3, 1, 1)])
def test_reliability_against_numpy(spark, monkeypatch, block, cells, batch):
    for name, value in (("BLOCK", block), ("CELLS", cells), ("BATCH", batch)):
        monkeypatch.setattr(reliability, name, value)
    df = exam(spark, 50, 17).union(exam(spark, 30, 5, "f")).union(spark.createDataFrame([("e", 99, 1, 5.0, 1), ("f", 3, 0, None, 2), ("g", 1, 1, 1.0, 1)], "exam_id string, student_id long, question_id long, score double, seq int"))
    got = {r.exam_id: r for r in reliability.exam_reliability(df.repartition(5)).collect()}
    for name, students, k, without in (("e", 50, 17, None), ("f", 29, 5, 3)):
        x = np.zeros((50 if name == "e" else 30, k))
        for r in df.where(F.col("exam_id") == name).where("student_id < 50 AND score IS NOT NULL").collect():
            x[r.student_id, r.question_id] = r.score
        x = np.delete(x, 3, 0) if without else x
        r = np.round(np.corrcoef(x.T)[np.triu_indices(k, 1)], 3).mean()
        assert (got[name].k, got[name].students) == (k, students)
        assert got[name].avg_inter_item_r == pytest.approx(r, abs=0.0011) and got[name].alpha == pytest.approx(k * r / (1 + (k - 1) * r), abs=0.002)
    assert (got["g"].k, got["g"].students, got["g"].alpha) == (1, 1, 0.0)


def test_shuffle_of_pairs_does_not_grow_with_students(spark):
    sizes = {}
    for students in (200, 2000):
        complete, _ = reliability.vectors(exam(spark, students, 150))
        complete = complete.repartition(4)
        partial = complete.sortWithinPartitions("exam_id").mapInArrow(reliability._partial, f"exam_id string, {reliability._SUMS}")
        sizes[students] = partial.count()
    assert sizes[200] == sizes[2000] == 4 * 3  # tasks and pairs of blocks


def test_median_is_a_written_table(spark):
    """A row for each group, of known size, so that a join with it doesn't deal all values of a group to one task."""
    rows = spark.range(100).selectExpr("id % 3 AS g", "id AS v")
    assert "Join" not in ranks.exact_median(rows, "g", "v")._jdf.queryExecution().optimizedPlan().toString()
