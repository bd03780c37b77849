"""Reliability of an exam from the correlations of its items.

A student with a score for each question is a row of a matrix X. All correlations come from sums of
products of its columns, X'X, which each task adds up for its own students, in blocks of items;
the blocks of all tasks are added in two steps. So what is shuffled for the pairs of items grows with their number
and that of the tasks, not with the students.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..coefficients import DEFAULT, Coefficients
from ..functions.stats import alpha, rounded

#: Items in a block, and cells of blocks that a task holds before it gives them out.
BLOCK, CELLS = 128, 1 << 22
#: Scores of students that are multiplied at once.
BATCH = 1 << 22
_SUMS = "task int, i int, j int, n long, rows int, columns int, products array<double>, of_rows array<double>, of_columns array<double>, squares_rows array<double>, squares_columns array<double>"
_ARRAYS = ["products", "of_rows", "of_columns", "squares_rows", "squares_columns"]


def vectors(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``exam_id, v`` of each student with a score for every question of the exam, in the questions' order; and ``exam_id, k``.

    Of a student's repeated attempts at a question the last by seq counts.
    """
    dealt = scores.repartition("exam_id", "student_id")  # both groupings below are within it
    last = dealt.groupBy("exam_id", "student_id", "question_id").agg(F.max_by("score", "seq").alias("score"))
    size = scores.groupBy("exam_id", "question_id").agg(F.lit(1)).groupBy("exam_id").agg(F.count("*").alias("k"))
    own = last.where(F.col("score").isNotNull()).groupBy("exam_id", "student_id").agg(F.array_sort(F.collect_list(F.struct("question_id", F.col("score").cast("double").alias("score")))).alias("own"))
    complete = own.join(size, "exam_id").where(F.size("own") == F.col("k"))
    return complete.select("exam_id", F.col("own.score").alias("v")), size


class _Sums:
    """Sums of products of the columns of one exam, by pairs of blocks ``i <= j``."""

    def __init__(self, exam):
        self.exam, self.blocks, self.held, self.n_held = exam, {}, [], 0

    def add(self, x: np.ndarray):
        """Takes in rows of scores; gives blocks out where there are too many to hold."""
        self.held.append(x)
        self.n_held += x.size
        if self.n_held >= BATCH:
            yield from self.multiplied()

    def multiplied(self):
        x = np.concatenate(self.held)
        self.held, self.n_held = [], 0
        cuts = range(0, x.shape[1], BLOCK)
        for i, a in enumerate(cuts):
            rows = x[:, a : a + BLOCK]
            for j, b in list(enumerate(cuts))[i:]:
                columns = x[:, b : b + BLOCK]
                own = self.blocks.get((i, j))
                parts = [rows.T @ columns, rows.sum(0), columns.sum(0), (rows * rows).sum(0), (columns * columns).sum(0)]
                self.blocks[i, j] = (len(x), parts) if own is None else (own[0] + len(x), [p + q for p, q in zip(own[1], parts, strict=True)])
                if len(self.blocks) * BLOCK * BLOCK > CELLS:
                    yield from self.given()

    def given(self):
        for (i, j), (n, parts) in self.blocks.items():
            yield self.exam, i, j, n, parts[0].shape, [p.ravel() for p in parts]
        self.blocks = {}


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _schema(exam: pa.DataType) -> pa.Schema:
    names = ["task", "i", "j", "rows", "columns"]
    return pa.schema([("exam_id", exam), *((c, pa.int32()) for c in names[:3]), ("n", pa.int64()), *((c, pa.int32()) for c in names[3:]), *((c, pa.list_(pa.float64())) for c in _ARRAYS)])


def _partial(batches):
    """Blocks of the exams in a partition, which is sorted by them."""
    task, sums = TaskContext.get().partitionId(), None

    def rows(found):
        return [dict(zip(["exam_id", "task", "i", "j", "n", "rows", "columns", *_ARRAYS], [e, task, i, j, n, *shape, *arrays], strict=True)) for e, i, j, n, shape, arrays in found]

    for batch in batches:
        schema = _schema(batch.schema.field("exam_id").type)
        exams, v = batch.column("exam_id").to_pylist(), batch.column("v")
        begin = 0
        while begin < len(exams):
            end = begin + 1
            while end < len(exams) and exams[end] == exams[begin]:
                end += 1
            if sums is None or sums.exam != exams[begin]:
                if sums is not None:
                    for one in rows([*(sums.multiplied() if sums.held else ()), *sums.given()]):
                        yield _batch([one], schema)
                sums = _Sums(exams[begin])
            x = v.slice(begin, end - begin).flatten().to_numpy(zero_copy_only=False).reshape(end - begin, -1)
            for one in rows(sums.add(x)):
                yield _batch([one], schema)
            begin = end
    if sums is not None:
        for one in rows([*(sums.multiplied() if sums.held else ()), *sums.given()]):
            yield _batch([one], schema)


def _added(batches):
    """The sums of consecutive rows with equal keys; one block is held."""
    key, row = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            one = {c: batch.column(c)[k].as_py() for c in ("exam_id", "task", "i", "j", "n", "rows", "columns")}
            arrays = [batch.column(c)[k].values.to_numpy() for c in _ARRAYS]
            now = (one["exam_id"], one["task"], one["i"], one["j"])
            if now == key:
                row["n"] += one["n"]
                for a, b in zip(held, arrays, strict=True):
                    a += b
            else:
                if key is not None:
                    yield _batch([row | dict(zip(_ARRAYS, held, strict=True))], schema)
                key, row, held, schema = now, one, [a.copy() for a in arrays], batch.schema
    if key is not None:
        yield _batch([row | dict(zip(_ARRAYS, held, strict=True))], schema)


def _summed(blocks: DataFrame) -> DataFrame:
    keys = ["exam_id", "task", "i", "j"]
    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added, blocks.schema)


def _correlations(batches):
    """``exam_id, r``: the correlations of the pairs of items in each block, each pair once."""
    for batch in batches:
        for k in range(batch.num_rows):
            n, shape = batch.column("n")[k].as_py(), (batch.column("rows")[k].as_py(), batch.column("columns")[k].as_py())
            xy, x, y, xx, yy = (batch.column(c)[k].values.to_numpy() for c in _ARRAYS)
            covariance = xy.reshape(shape) - np.outer(x, y) / n
            bottom = np.sqrt(np.outer(np.maximum(xx - x * x / n, 0), np.maximum(yy - y * y / n, 0)))
            r = np.divide(covariance, bottom, out=np.zeros(shape), where=bottom > 0) if n >= 2 else np.zeros(shape)
            own = batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
            r = r[np.triu_indices(shape[0], 1)] if own else r.ravel()
            yield pa.RecordBatch.from_arrays([batch.column("exam_id").slice(k, 1), pa.array([r], pa.list_(pa.float64()))], ["exam_id", "r"])


def pair_sums(complete: DataFrame) -> DataFrame:
    """Blocks of the sums of products of each exam's items, over all its complete students (``exam_id, v``)."""
    kind = complete.schema["exam_id"].dataType.simpleString()
    partial = complete.sortWithinPartitions("exam_id").mapInArrow(_partial, f"exam_id {kind}, {_SUMS}")
    groups = F.ceil(F.sqrt(F.lit(float(complete.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).cast("int")
    return _summed(_summed(partial.withColumn("task", F.pmod("task", groups))).withColumn("task", F.lit(0)))


def exam_reliability(scores: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """``exam_id, k, students, alpha, avg_inter_item_r, interpretation`` of rows ``exam_id, student_id, question_id, score, seq``.

    Of a student's repeated attempts at a question the last by seq counts, and only students with a
    score for each of the k questions do. With under two questions or ten such students alpha is 0.
    """
    complete, size = vectors(scores)
    blocks = pair_sums(complete)
    kind = scores.schema["exam_id"].dataType.simpleString()
    r = blocks.mapInArrow(_correlations, f"exam_id {kind}, r array<double>")
    zero = F.lit(0).cast("decimal(28,3)")
    total = F.aggregate("r", zero, lambda s, x: (s + rounded(x, 3).cast("decimal(10,3)")).cast("decimal(28,3)"))
    mean = r.select("exam_id", total.alias("total"), F.size("r").alias("pairs")).groupBy("exam_id")
    mean = mean.agg((F.sum("total").cast("double") / F.nullif(F.sum("pairs"), F.lit(0))).alias("mean_r"))
    students = complete.groupBy("exam_id").agg(F.count("*").alias("students"))
    out = size.join(students, "exam_id", "left").join(mean, "exam_id", "left").fillna(0, ["students"])
    enough = (F.col("k") >= 2) & (F.col("students") >= c.complete_students)
    mean_r = F.when(enough, F.coalesce("mean_r", F.lit(0.0))).otherwise(0.0)
    value = rounded(F.when(enough, alpha(F.col("k"), mean_r)).otherwise(0.0), 3)
    text = (
        F.when(F.col("alpha") >= 0.9, "excellent").when(F.col("alpha") >= 0.8, "good")
        .when(F.col("alpha") >= 0.7, "acceptable").when(F.col("alpha") >= 0.6, "questionable").otherwise("low")
    )
    out = out.select("exam_id", "k", "students", value.alias("alpha"), rounded(mean_r, 3).alias("avg_inter_item_r"))
    return out.withColumn("interpretation", text)
