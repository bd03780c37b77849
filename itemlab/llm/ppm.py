"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ORDER bytes. A symbol's probability is that in the
longest context known to the language; where the context hasn't seen the symbol, an escape is paid
and the next shorter one is asked, down to a uniform choice of 256 bytes (escape method C, without
exclusion). With frozen statistics this is a function of ORDER + 1 bytes, so the trees of all
languages are laid out as one table: a row per context that any language knows, a column per byte,
and in it each language's code length in bits.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import has_letter, resident, small_batches, table, valid

#: Bytes of the longest context.
ORDER = 3
#: About so many labelled documents of a language, chosen by a hash of doc_id, make its tree.
MAX_DOCUMENTS = 2000
_SEED = 6


def ngram_counts(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of order + 1 bytes (big-endian integers) and their counts; texts begin after zero bytes."""
    pad = bytes(order)
    b = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.int64)
    code = np.zeros(len(b) - order, np.int64)
    for k in range(order + 1):
        code = (code << 8) | b[k : k + len(code)]
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + order) - order  # positions of predicted bytes are those outside the padding
    inside = np.ones(len(code), bool)
    for k in range(order):
        at = ends[:-1] + k
        inside[at[at < len(code)]] = False
    return np.unique(code[inside], return_counts=True)


class Model:
    """Code lengths of bytes for each of several languages, from counts of runs of ORDER + 1 bytes."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.langs, self.order = langs, order
        symbols = np.unique(np.concatenate([[0], *(c & 255 for c, _ in counts)]))  # 0 stands before a text
        # Class 0 stands for every byte that training never predicts; its code length is the same for all.
        self.classes = k = len(symbols) + 1
        self.of_byte = np.zeros(256, np.int64)
        self.of_byte[symbols] = np.arange(1, k)
        #: By the classes of ORDER bytes: the row of the longest known context that ends there.
        self.row_of = np.zeros(k**order, np.int32)
        tables, rows = [], 0
        contexts, bits = np.zeros(1, np.int64), np.full((1, k, len(langs)), 8.0, np.float32)
        for m in range(order + 1):  # bytes of context
            seen = [self._shortened(codes, n, m) for codes, n in counts]
            shorter, known = contexts, np.unique(np.concatenate([ids // k for ids, _ in seen]))
            bits = bits[np.searchsorted(shorter, known % k ** (m - 1))] if m else bits
            for lang, (ids, n) in enumerate(seen):
                at = np.searchsorted(known, ids // k)
                total, kinds = np.bincount(at, n, len(known)), np.bincount(at, minlength=len(known))
                own = np.flatnonzero(kinds)
                bits[own, :, lang] += np.log2((total + kinds)[own] / kinds[own])[:, None]
                bits[at, ids % k, lang] = np.log2((total + kinds)[at] / n)
            self.row_of.reshape(-1, k**m)[:, known] = rows + np.arange(len(known))
            contexts, rows = known, rows + len(known)
            tables.append(bits.reshape(-1, len(langs)))
        self.bits = np.concatenate(tables)

    def _shortened(self, codes: np.ndarray, n: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of m + 1 classes at the ends of the coded runs, and their counts."""
        ids = np.zeros(len(codes), np.int64)
        for j in range(m, -1, -1):
            ids = ids * self.classes + self.of_byte[(codes >> (8 * j)) & 255]
        ids, at = np.unique(ids, return_inverse=True)
        return ids, np.bincount(at, n, len(ids))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        pad = bytes(self.order)
        begin = 0
        while begin < len(texts):  # about half a megabyte at a time; longer texts alone
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) < 1 << 19):
                size += len(texts[end])
                end += 1
            out[begin:end] = self._chunk(texts[begin:end], pad)
            begin = end
        return out

    def _chunk(self, texts: list[bytes], pad: bytes) -> np.ndarray:
        order, k = self.order, self.classes
        c = self.of_byte[np.frombuffer(pad + pad.join(texts), np.uint8)]
        n = len(c) - order
        context = np.zeros(n, np.int64)
        for j in range(order):
            context = context * k + c[j : j + n]
        at = self.row_of[context].astype(np.int64) * k + c[order:]
        sums = np.zeros((len(texts), len(self.langs)))
        start = 0
        for i, t in enumerate(texts):
            for piece in range(start, start + len(t), 1 << 16):
                sums[i] += self.bits[at[piece : min(piece + (1 << 16), start + len(t))]].sum(0, dtype=np.float64)
            start += len(t) + order
        return sums


def training_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, code, n`` over documents ``doc_id, text, lang``, about MAX_DOCUMENTS of each language."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    share = (F.xxhash64("doc_id", F.lit(_SEED)).cast("double") / 2.0**64) + 0.5
    chosen = labelled.join(F.broadcast(sizes), "lang").where(share <= F.lit(MAX_DOCUMENTS) / F.col("size"))

    def run(batches):
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
            for lang, texts in by.items():
                codes, n = ngram_counts(texts, order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], ["lang", "code", "n"]
                )

    return chosen.select("lang", valid("text")).mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, order: int = ORDER) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts by language, on the driver; their size is bounded by the sample's bounds."""
    rows = training_counts(labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()), order).toArrow()
    langs = rows.column("lang").to_numpy(zero_copy_only=False)
    codes, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    return {str(x): (codes[langs == x], n[langs == x]) for x in sorted(set(langs.tolist()))}


def predict(docs: DataFrame, counts: dict, order: int = ORDER) -> DataFrame:
    """Adds ``lang_pred, score, bits_per_byte`` to docs, which has ``text``; the text is read whole.

    lang_pred is the language of the shortest code, the first by name of several; score is its share
    of the probability over all languages. A text that is null or has no letter, and every text where
    nothing was learned, is ``und`` with score 0 and bits_per_byte null.
    """
    spark = docs.sparkSession
    if not counts:
        return docs.withColumns(
            {"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")}
        )
    name = uuid.uuid4().hex
    shipped = spark.sparkContext.broadcast((list(counts), list(counts.values())))

    def run(texts: pa.Array) -> pa.Array:
        model = resident(name, lambda: Model(*shipped.value, order))
        raw = [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts.to_pylist()]
        bits = model.code_lengths(raw)
        best = bits.argmin(1)
        low = bits[np.arange(len(raw)), best]
        share = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
        size = np.maximum(1, [len(x) for x in raw])
        return pa.StructArray.from_arrays(
            [pa.array([model.langs[k] for k in best], pa.string()), pa.array(share), pa.array(low / size)],
            ["lang", "score", "bits"],
        )

    # Else a filter on the result would be pushed below it with a second call.
    kernel = F.arrow_udf(run, "struct<lang: string, score: double, bits: double>").asNondeterministic()
    letter = has_letter(F.col("text"))
    out = docs.withColumn("__ppm", kernel(F.when(letter, valid("text"))))
    return out.withColumns(
        {
            "lang_pred": F.when(letter, F.col("__ppm.lang")).otherwise(F.lit("und")),
            "score": F.when(letter, F.col("__ppm.score")).otherwise(F.lit(0.0)),
            "bits_per_byte": F.when(letter, F.col("__ppm.bits")),
        }
    ).drop("__ppm")


def crc_mod(n: int, key: str = "doc_id"):
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def identify_languages(docs: DataFrame, held_out) -> DataFrame:
    """docs with ``held_out, lang_pred, score, bits_per_byte``; trees come from rows that aren't held out.

    lang, source and doc_id never reach a prediction. Rows with null text or lang teach nothing.
    Repeated rows count each time; extra columns stay, but for those with the added names, which are
    replaced. An empty table, or one without labels, predicts ``und`` throughout.
    """
    docs = docs.withColumn("held_out", held_out)
    labelled = docs.where(~F.col("held_out")).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    return predict(docs, fit(labelled))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify_languages(docs, crc_mod(4) == 2)
    return out.select("doc_id", "held_out", "lang_pred", "score")
