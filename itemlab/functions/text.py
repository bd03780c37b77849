"""Tokens, coverage, tf-idf and similarity of texts."""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing about a topic (fixed values).
STOP_WORDS = ["и", "в", "на", "с", "для", "по", "из", "к", "а", "the", "and", "of", "to", "in", "for", "with", "on", "at", "from", "by"]


def tokens(text: Column, min_length: int = 2, stop: list[str] | None = None) -> Column:
    """Lower-cased runs of letters and digits longer than min_length, repeated ones too."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    kept = F.filter(words, lambda w: F.length(w) > min_length)
    return F.filter(kept, lambda w: ~w.isin(stop)) if stop else kept


def coverage(reference: Column, question: Column) -> Column:
    """Share of the distinct reference tokens that are in the question; 0 if either has none."""
    a, b = F.array_distinct(reference), F.array_distinct(question)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(a))


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of the comma or semicolon separated keywords that occur in the answer; null without keywords."""
    keys = F.filter(F.transform(F.split(keywords, "[,;]+"), lambda k: F.trim(k)), lambda k: k != "")
    found = F.filter(keys, lambda k: F.lower(answer).contains(F.lower(k)))
    return F.when(F.size(keys) > 0, F.size(found) / F.size(keys))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def frequencies(docs: DataFrame) -> DataFrame:
    """``token, df, idf`` from ``tokens``: the documents with each token, and ln((1 + N) / (1 + df)) + 1."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    df = df.crossJoin(F.broadcast(n))  # one row
    return df.select("token", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(docs: DataFrame) -> DataFrame:
    """``id, token, weight, df`` from ``id, tokens``: vectors of unit length, and the documents with each token.

    idf = ln((1 + N) / (1 + df)) + 1 over all docs. Documents without tokens have no rows.
    """
    return weighted(docs, frequencies(docs))


def weighted(docs: DataFrame, known: DataFrame) -> DataFrame:
    """tfidf of the docs by frequencies that are known."""
    counts = docs.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    rows = counts.join(known, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return rows.select("id", "token", (F.col("w") / norm).alias("weight"), "df")


def normalised(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def _similar(a: str, b: str) -> float:
    """Share of matching bytes, by longest common substrings, in percent."""
    a, b = normalised(a), normalised(b)
    if not a or not b:
        return 0.0
    x, y = a.encode("utf-8", "replace"), b.encode("utf-8", "replace")
    return round(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() * 100, 1)


def similar_text(a: Column, b: Column) -> Column:
    """Similarity of two texts in percent, one decimal; it depends on their order. 0 if either is empty."""

    def kernel(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([_similar(x, y) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(kernel, "double")(a, b)


def common_subsequence(a: bytes, b: bytes) -> int:
    """Length of the longest common subsequence, a bit of one number for each byte of a."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def byte_counts(texts: list[bytes]) -> np.ndarray:
    return np.array([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in texts], np.int64).reshape(-1, 256)


def similar_among(left: list[str], right: list[str], least: float):
    """``k, m, similarity`` of the pairs of left and right at least so similar in percent.

    What matches is a common subsequence and no more than the bytes both have; pairs whose bound is under least are spared the
    comparison, first by counts of bytes, then by the subsequence.
    """
    x, y = ([normalised(t).encode("utf-8", "replace") for t in texts] for texts in (left, right))
    a, b = byte_counts(x), byte_counts(y)
    sizes = b.sum(1)
    for k in range(len(x)):
        bound = 200 * np.minimum(a[k], b).sum(1) / np.maximum(1, a[k].sum() + sizes)
        for m in np.flatnonzero(bound >= least - 0.06):
            if not x[k] or not y[m] or 200 * common_subsequence(x[k], y[m]) / (len(x[k]) + len(y[m])) < least - 0.06:
                continue
            s = _similar(left[k], right[m])
            if s >= least:
                yield k, int(m), s
