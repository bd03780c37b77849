"""Corpus pipeline: documents to token ids in five stages.

Each stage is written as Parquet in the shared folder and read again by the next. The first four
return the columns of documents; the last returns the encoding's digests. SQL can't express the
stages; tests hold them against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlab.llm import bpe, decontaminate, minhash, pii, ppm
from itemlab.llm.common import Scratch, small_batches, stored, table

#: A document is rejected if its language's code needs so many bits a byte: no better than none.
MAX_BITS = 8.0
#: Dropped documents' keys (16 bytes each) that are broadcast at most; beyond that both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns an operator reads, and the whole row as one more, out of the way of what it adds."""
    return docs.select(*names, F.struct("*").alias("__row"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs again, but for changed ones."""
    return rows.select(*(changed[c].alias(c) if c in changed else F.col("__row").getField(c).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with that as lang; those that are ``und`` go."""
    small_batches(spark)
    counts = ppm.fit(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")))
    known = ppm.predict(_packed(docs, "text"), counts)
    known = known.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < MAX_BITS))
    return _unpacked(known, docs, lang=F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates, once.

    Rows of one doc_id are repeats only if their texts are equal; documents without a doc_id stay.
    """
    small_batches(spark)
    marked = minhash.near_duplicates(docs.select("doc_id", "text"))
    keys = ["__id", "__hash"]
    rows = _packed(docs, F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__hash"))
    marked = marked.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "kept")
    gone = marked.where(~F.col("kept")).select(*keys).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    rest = rows.join(gone, keys, "left_anti")
    repeated = marked.where("kept").groupBy(*keys).count().where("count > 1").select(*keys)
    if not repeated.isEmpty():
        several = rest.join(repeated, keys, "left_semi")
        order = Window.partitionBy(*keys).orderBy(F.to_json("__row"))
        several = several.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
        rest = rest.join(repeated, keys, "left_anti").unionByName(several)
    return _unpacked(rest, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item."""
    small_batches(spark)
    found = decontaminate.with_matches(_packed(docs, "text"), table(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(F.size("matches") == 0), docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in their texts, and n_chars of these."""
    small_batches(spark)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _unpacked(pii.with_surrogates(_packed(docs, "text")), docs, **changed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of ids and decoded text, of each document."""
    small_batches(spark)
    return bpe.digests(bpe.encode_documents(docs, bpe.tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            docs = scratch.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
            if k:
                scratch.drop(f"pipeline-{STAGES[k - 1][0]}")
        name, stage = STAGES[-1]
        return stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
