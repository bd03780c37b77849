"""What the join of similar texts sends and leaves on disk, and its blocks, rounds and groups."""

import os
import random

from pyspark.sql import functions as F

from itemlab.operators import duplicates


def texts(spark, n):
    """Texts of which a sixth shares a rare word, and each tenth is near the one before it."""
    rng = random.Random(7)
    rows = [(k, " ".join([f"rare{k % 6}", *(f"own{k}of{j}" for j in range(2)), *rng.choices([f"word{j}" for j in range(9)], k=4)])) for k in range(n)]
    rows = [(k, rows[k - 1][1] + " word1" if k % 10 == 9 else t) for k, t in rows]
    return spark.createDataFrame(rows, "id long, text string")


def written(spark):
    """Rows of all shuffles so far, by stages."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_that_are_apart_are_not_sent(spark):
    """Four times the texts are four times the rows to send, though eight times the pairs share one of their two words."""
    sent = []
    for m in (12, 24):
        grid = spark.createDataFrame([(i * m + j, f"left{i} right{j}") for i in range(m) for j in range(m)], "id long, text string")
        prefix = duplicates._prefixes(duplicates._vectors(duplicates._keyed(grid)), 0.7).cache()
        prefix.count()
        before = written(spark)
        assert duplicates._candidates(prefix, prefix, 0.7).count() == 0
        sent.append(written(spark) - before)
    assert sent[1] < 5 * sent[0]


def test_blocks_rounds_and_groups_give_the_same_pairs(spark, monkeypatch):
    df = texts(spark, 150)
    pairs = lambda: sorted(map(tuple, duplicates.similar_texts(df, 0.7)[0].collect()))
    plain = pairs()
    for name, value in (("PREFIXES", 25), ("ROUND", 4), ("GROUP", 2), ("SENT", 3), ("ASKING", 20), ("SUMS", 50), ("POSTINGS", 7)):
        monkeypatch.setattr(duplicates, name, value)
    assert pairs() == plain and len(plain) >= 10


def test_only_pairs_and_classes_stay_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(duplicates, "settled", lambda rows, seen=iter(range(1000)): kept(rows, f"{tmp_path}/{next(seen)}"))
    found, classes = duplicates.similar_texts(texts(spark, 60), 0.7)
    left = {name for name in os.listdir(tmp_path)}
    used = {f.split("/")[-2] for f in found.inputFiles() + classes.inputFiles()}
    assert used <= left and not any({"terms", "token", "rank"} & set(spark.read.parquet(f"{tmp_path}/{name}").columns) for name in left)
    assert found.where(F.col("similarity") <= 0.7).count() == 0


def kept(rows, path):
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
