"""Cosine similarity of vectors: pairs above a threshold, nearest vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import settled

#: Vectors that meet in one task.
BLOCK = 2048


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1; 0 if either is zero or missing, null if their lengths differ."""
    a, b = (F.transform(x, lambda v: v.cast("double")) for x in (a, b))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    bottom = norm(a) * norm(b)
    value = F.when(bottom > 0, dot / bottom).otherwise(0.0)
    return F.when(F.size(a) == F.size(b), F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


#: Pivots at most, and vectors of a sample, chosen by a hash of id, that they are chosen from.
PIVOTS, SAMPLE = 128, 4096
#: What rounding may add to a distance.
SLACK = 1e-9


def pivots_of(rows: DataFrame, n: int) -> np.ndarray:
    """Up to PIVOTS unit vectors that are far from one another, of a bounded sample of n rows' vectors."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(sample):
        return np.zeros((1, 1))
    m = _unit(sample)
    chosen, far = [0], np.linalg.norm(m - m[0], axis=1)
    while len(chosen) < min(PIVOTS, max(1, int(n**0.5))) and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(m - m[chosen[-1]], axis=1))
    return m[chosen]


def celled(rows: DataFrame, pivots: np.ndarray, reach: float | None = None) -> DataFrame:
    """Rows ``id, vector`` with ``cell``, their nearest pivot, ``far``, the distance to it, and ``visits``.

    visits: the cells of smaller number that may have a vector within reach. A vector nearer to another pivot than to
    this one's is at least half the difference of the two distances away.
    """

    def run(batches):
        for pdf in batches:
            m = _unit(pdf["vector"])
            d = np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * m @ pivots.T))
            cell = d.argmin(1)
            far = d[np.arange(len(d)), cell]
            visits = [[]] * len(d) if reach is None else [np.flatnonzero((row[:c] - f) / 2 <= reach + SLACK).tolist() for row, c, f in zip(d, cell, far, strict=True)]
            yield pdf[["id", "vector"]].assign(cell=cell, far=far, visits=visits)

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("id", "vector").mapInPandas(run, f"id long, vector {kind}, cell int, far double, visits array<int>")


def met(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows ``id, vector, cell, own, i, j, guest``: what meets in each task ``cell, i, j`` to find the pairs above threshold.

    Cells' own vectors meet one another, and those that visit; blocks of either have BLOCK vectors or so.
    """
    rows = settled(rows.where(F.col("vector").isNotNull()).select("id", "vector"))
    pivots = pivots_of(rows, rows.count())
    at = settled(celled(rows, pivots, (2 - 2 * max(threshold, -1.0)) ** 0.5))
    homes = at.select("id", "vector", "cell", F.lit(False).alias("guest"))
    guests = at.select("id", "vector", F.explode("visits").alias("cell"), F.lit(True).alias("guest"))
    radius = at.groupBy("cell").agg(F.max("far").alias("radius"))
    both = homes.unionByName(guests)
    sizes = both.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests")).join(radius, "cell")
    parts = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    sizes = sizes.select("cell", parts("homes").alias("h"), parts("guests").alias("g"))  # a row for each pivot at most
    both = both.join(F.broadcast(sizes), "cell")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("g")).otherwise(F.col("h"))).cast("int")
    both = both.withColumn("own", own)
    # a home block meets the home blocks, as pairs i <= j, and each block of guests, whose numbers are below 0
    among = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    with_guests = F.transform(F.sequence(F.lit(1), F.col("g")), lambda k: F.struct((-k).alias("i"), F.col("own").alias("j")))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: F.struct((-F.col("own") - 1).alias("i"), k.alias("j")))
    tasks = F.when(F.col("guest"), as_guest).otherwise(F.concat(among, with_guests))
    return both.select("id", "vector", "cell", "own", "guest", F.inline(tasks))


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """``id_a, id_b, similarity`` of all pairs of ``id, vector``, of one length, with a cosine above threshold, id_a < id_b.

    For unit vectors a cosine is a distance. Vectors are dealt to the nearest of a few pivots; by the
    triangle inequality most pairs of pivots have no pair of vectors so near, and aren't compared. A task
    holds 2 BLOCK vectors, and only pairs above the threshold leave it. Null vectors have no pairs; the cosine with a zero vector is 0.
    """
    if threshold < 0:
        raise ValueError("below 0 all pairs are alike")
    rows = rows.where(F.exists("vector", lambda x: x != 0))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a = pdf[pdf["guest"]] if i < 0 else pdf[~pdf["guest"] & (pdf["own"] == i)]
        b = pdf[~pdf["guest"] & (pdf["own"] == j)]
        if not len(a) or not len(b):
            return pd.DataFrame({"id_a": [], "id_b": [], "similarity": []})
        s = np.clip(_unit(a["vector"]) @ _unit(b["vector"]).T, -1, 1)
        k, m = np.nonzero(s > threshold)
        x, y = a["id"].to_numpy()[k], b["id"].to_numpy()[m]
        keep = (x < y) if i == j else x != y
        return pd.DataFrame({"id_a": np.minimum(x, y)[keep], "id_b": np.maximum(x, y)[keep], "similarity": s[k, m][keep]})

    return met(rows, threshold).groupBy("cell", "i", "j").applyInPandas(compare, "id_a long, id_b long, similarity double")


class VectorIndex:
    """Vectors by cells, in a folder, for exact searches that read only the cells that can hold an answer."""

    def __init__(self, rows: DataFrame, path: str):
        """Writes rows ``id, vector``, of one length, a folder for each cell; zero and null vectors have the cosine 0 and are left out."""
        self.spark, self.path = rows.sparkSession, path
        rows = settled(rows.where(F.exists("vector", lambda x: x != 0)).select("id", "vector"))
        self.pivots = pivots_of(rows, rows.count())
        celled(rows, self.pivots).drop("visits").repartition("cell").write.partitionBy("cell").parquet(path)
        cells = self.rows().groupBy("cell").agg(F.max("far").alias("radius"), F.min("far").alias("inner"), F.count("*").alias("n")).toPandas()
        self.cells = cells.sort_values("cell").reset_index(drop=True)  # a row for each pivot at most

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _distances(self, query: list[float]) -> np.ndarray:
        """From the query, as a unit vector, to the cells' pivots."""
        return np.linalg.norm(self.pivots[self.cells["cell"]] - _unit(pd.Series([query]))[0], axis=1)

    def first(self, query: list[float], k: int) -> list[int]:
        """Cells that have k vectors, those whose farthest vector can be nearest."""
        order = np.argsort(self._distances(query) + self.cells["radius"].to_numpy())
        n = int(np.searchsorted(np.cumsum(self.cells["n"].to_numpy()[order]), k)) + 1
        return self.cells["cell"].to_numpy()[order[:n]].tolist()

    def within(self, query: list[float], distance: float) -> list[int]:
        """Cells that, by the triangle inequality, can have a vector so near."""
        to = self._distances(query)
        least = np.maximum(to - self.cells["radius"].to_numpy(), self.cells["inner"].to_numpy() - to)
        return self.cells["cell"].to_numpy()[least <= distance + 1e-6].tolist()

    def nearest(self, query: list[float], k: int) -> DataFrame:
        """``id, similarity`` of the k rows with the greatest cosine to the query, the smaller id first among equals.

        A few cells give k vectors; only cells that can have one as near as the last of these are read then.
        """
        search = lambda cells: nearest(self.rows().where(F.col("cell").isin(cells)).select("id", "vector"), query, k).select("id", "similarity")
        found = search(self.first(query, k)).agg(F.min("similarity").alias("least"), F.count("*").alias("n")).first()
        far = max(0.0, 2 - 2 * found.least) ** 0.5 if found.n >= k else np.inf
        return search(self.within(query, far))


def nearest(self, query: list[float], k: int) -> DataFrame:
        """``id, similarity`` of the k rows with the greatest cosine to the query, the smaller id first among equals."""
        first = self.rows().where(F.col("cell").isin(self.among(query, k)))
        found = nearest(first.select("id", "vector"), query, k).select("id", "similarity")
        least = found.agg(F.min("similarity").alias("s"), F.count("*").alias("n")).first()
        if least.n < k:
            return found
        # with the k-th cosine known, fewer cells are left
        q = _unit(pd.Series([query]))[0]
        to = np.linalg.norm(self.pivots[self.cells["cell"]] - q, axis=1)
        far = max(0.0, 2 - 2 * least.s) ** 0.5 + 1e-6
        left = self.cells["cell"][np.maximum(to - self.cells["radius"], self.cells["inner"] - to) <= far].tolist()
        return nearest(self.rows().where(F.col("cell").isin(left)).select("id", "vector"), query, k).select("id", "similarity")


def nearest(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows (``id, vector``, more) with the greatest cosine to the query; vectors of other lengths are skipped."""
    value = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    return rows.withColumn("similarity", value).where("similarity IS NOT NULL").orderBy(F.desc("similarity"), "id").limit(k)
