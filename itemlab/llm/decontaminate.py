"""Benchmark passages in training documents: n-gram seeds, then Smith-Waterman alignment.

The n-grams of the test items seed windows of the documents, and local alignment of a window's
words with the item's scores copies, edited ones too. No seed is dropped for being in many
documents: what survives in an edited copy that many share is frequent, and may be all there is.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_ngrams, hash_words, resident, small_batches, table, valid

#: Words of a seed; items of fewer words aren't looked for.
SEED = 3
#: Scores of the alignment of words; the best alignment of an item with itself has MATCH for each word.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best score from which a passage counts as a copy.
THRESHOLD = 0.5
#: Characters of test items that are held in memory and broadcast at once; more are taken in blocks.
BLOCK_CHARS = 20_000_000

#: Scripts without spaces between words (Thai to Lao, Tibetan to Myanmar, Khmer, kana, Han and their extensions): a character is a word.
_DENSE = "\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_PLAIN, _WORD, _HAS_DENSE = re.compile(r"\w+"), re.compile(rf"[^\W{_DENSE}]+|(?:(?=[{_DENSE}])\w)"), re.compile(f"[{_DENSE}]")
_MATCHES = "array<struct<item_id: long, score: double, first_word: int, last_word: int>>"


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words: runs of letters, digits and underscores, single characters of dense scripts."""
    if not text:
        return np.empty(0, np.uint64)
    word = _PLAIN
    try:
        text.encode("latin-1")  # quicker than to look for characters beyond it
    except UnicodeEncodeError:
        word = _WORD if _HAS_DENSE.search(text) else _PLAIN
    return hash_words([w.encode("utf-8", "surrogatepass") for w in word.findall(text.lower())])


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of the words b with a passage of a: its score, and first and last word in a (-1: none).

    A row of the matrix at a time: gaps along it are a running maximum.
    """
    n = len(a)
    at = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), np.tile(at, 1)
    best = (0, -1, -1)
    for word in b:
        diagonal = np.concatenate([[0], row[:-1] + np.where(a == word, MATCH, MISMATCH)])
        from_diagonal = np.concatenate([[0], start[:-1]])
        above = row + GAP
        cell = np.maximum(np.maximum(diagonal, above), 0)
        begin = np.where(cell == 0, at, np.where(cell == diagonal, from_diagonal, start))
        lifted = cell - GAP * at
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0))
        row = top + GAP * at
        start = np.where(row > 0, begin[source], at)
        row = np.maximum(row, 0)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(start[k]), k - 1)
    return best


class Items:
    """Test items with their seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.words = [], []
        for item, text in zip(ids, texts, strict=True):
            w = tokens(text)
            if len(w) >= SEED:
                self.ids.append(item), self.words.append(w)
        grams = [hash_ngrams(w, SEED) for w in self.words]
        own = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(own, kind="stable")
        self.gram = own[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else own.astype(np.int64)
        self.seeds = np.unique(own)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.length) - self.length
        flat = np.concatenate(self.words) if self.words else own
        self.vocabulary, self.entry = np.unique(flat, return_inverse=True)  # of each word of each item

    def in_common(self, words: np.ndarray, items: np.ndarray) -> np.ndarray:
        """How many words of each of these items are among words, repeated ones each time: no alignment matches more."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        there = np.zeros(len(self.vocabulary), bool)
        there[at[self.vocabulary[at] == words]] = True
        length = self.length[items]
        begin = np.cumsum(length) - length
        places = np.repeat(self.first[items] - begin, length) + np.arange(length.sum())
        return np.add.reduceat(there[self.entry[places]], begin, dtype=np.int64)

    def found(self, grams: np.ndarray) -> np.ndarray:
        """Positions of the n-grams that are seeds."""
        if not len(self.seeds):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        return np.flatnonzero(self.seeds[at] == grams)

    def matches(self, text: str | None, threshold: float) -> list[dict]:
        """Copies of items in a text, the best of each item."""
        words = tokens(text)
        grams = hash_ngrams(words, SEED)
        hits = self.found(grams)
        if not len(hits):
            return []
        low, high = np.searchsorted(self.gram, grams[hits], "left"), np.searchsorted(self.gram, grams[hits], "right")
        times = high - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        item, begin = self.item[entry], np.repeat(hits, times) - self.place[entry]
        some, which = np.unique(item, return_inverse=True)
        enough = self.in_common(words, some) / self.length[some] >= threshold
        item, begin = item[enough[which]], begin[enough[which]]
        if not len(item):
            return []
        order = np.lexsort((begin, item))
        item, begin = item[order], begin[order]
        out = []
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            b = self.words[item[part[0]]]
            best, margin = (0, -1, -1), len(b) // 2 + 1
            starts = begin[part]
            for window in np.split(starts, np.flatnonzero(np.diff(starts) > 2 * margin) + 1):
                first = max(0, int(window[0]) - margin)
                a = words[first : int(window[-1]) + len(b) + margin]
                if np.isin(b, a).sum() / len(b) < threshold:
                    continue  # too few words in common, even if all of them matched
                score, i, j = align(a, b)
                if score > best[0]:
                    best = score, first + i, first + j
            share = best[0] / (MATCH * len(b))
            if share >= threshold:
                out.append({"item_id": self.ids[item[part[0]]], "score": share, "first_word": best[1], "last_word": best[2]})
        return out


def with_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``matches`` to docs (``text``): the items of benchmark (``item_id, text``) copied in the whole text.

    A match has item_id, score (share of the best alignment score, threshold or more), and its first
    and last word in the text. An empty array for null, empty and clean texts. Items with null text
    or fewer than SEED words match nothing; repeated items and documents each get their matches.
    A column ``matches`` of docs is replaced. Items are taken in blocks of about BLOCK_CHARS, each of
    which is held against all documents.
    """
    spark = docs.sparkSession
    benchmark = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    out = docs.withColumn("matches", F.array().cast(_MATCHES))
    for k in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else benchmark
        rows = part.toArrow()
        items = Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())
        if not len(items.seeds):
            continue
        name, shipped = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

        def run(texts: pa.Array, name=name, shipped=shipped) -> pa.Array:
            own = resident(name, lambda: shipped.value)
            found = [own.matches(t, threshold) for t in texts.to_pylist()]
            kind = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())])
            return pa.array(found, pa.list_(kind))

        # Else a filter on the matches would be pushed below them with a second call.
        out = out.withColumn("matches", F.concat("matches", F.arrow_udf(_one(run), _MATCHES).asNondeterministic()(valid("text"))))
    return out


def _one(run):
    def kernel(texts: pa.Array) -> pa.Array:
        return run(texts)

    return kernel


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word`` for each copy of an item in a document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_matches(docs, benchmark, threshold).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.score", "m.first_word", "m.last_word")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
