"""What the operators of this subpackage share: words, hashes, scratch space."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_hash = xxhash.xxh3_64_intdigest
#: Odd multiplier of the hash that joins word hashes into the hash of an n-gram.
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive items; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= _MULTIPLIER
        out ^= hashes[k : k + count]
        out ^= out >> np.uint64(29)
    return mix(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a local session names none (as in tests) a temporary one is set; a cluster's must name one,
    as each machine would write its own.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(place)
        place = spark.sparkContext.getCheckpointDir()
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{re.sub(r'[^a-z0-9]+', '-', name.lower())}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a block; the user's own comes back after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows and bytes of a batch of rows that Spark hands to Python, at most: texts are large rows.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def _smaller(spark: SparkSession) -> dict[str, str]:
    out = {}
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(str(spark.conf.get(key)).rstrip("b")) <= most:
            out[key] = str(most)
    return out


def stored(df: DataFrame, name: str, partition_by: str | list[str] | None = None, path: str | None = None) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read again.

    Cuts the lineage: what is computed once isn't computed anew for each use, nor after the loss
    of an executor, and every use sees the same rows. The shuffles that led to it are given back.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with contextlib.ExitStack() as during:
        for key, value in {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **_smaller(spark)}.items():
            during.enter_context(setting(spark, key, value))
        df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables that one operator stores for itself; those not dropped before go at the end of the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def store(self, df: DataFrame, name: str, partition_by: str | list[str] | None = None) -> DataFrame:
        self.paths[name] = scratch_path(self.spark, name)
        return stored(df, name, partition_by, self.paths[name])

    def drop(self, *names: str, part: str | None = None) -> None:
        """Removes tables, or one partition of them."""
        for name in names:
            removed(self.spark, f"{self.paths[name]}/{part}" if part else self.paths.pop(name))

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)


_resident: dict = {}


def resident(key: str, build):
    """What build() gives for a key, kept in this Python worker until another key is asked for.

    A worker serves tasks of many stages, so it holds one model or vocabulary at a time, and gives
    the memory of the last one back before it takes that of the next.
    """
    if key not in _resident:
        _resident.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _resident[key] = build()
    return _resident[key]


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batches for Python to what keeps a worker's memory small, if they are larger.

    For queries and pipelines, which own their session. Operators leave it as it is; what they store
    themselves they write with small batches.
    """
    for key, value in _smaller(spark).items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def valid(name: str) -> F.Column:
    """A column of text in which what isn't UTF-8 has become replacement characters, as Python needs it."""
    return F.make_valid_utf8(F.col(name).cast("string")).alias(name)


def has_letter(column) -> F.Column:
    return F.coalesce(column.rlike(r"\p{L}"), F.lit(False))


def runs(batches, keys: list[str]):
    """Groups of consecutive rows with equal keys, from Arrow batches sorted by these keys.

    Yields pyarrow tables, one per group; holds one batch and the group that crosses its end.
    """
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(n - 1, bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held:
                if end == n:
                    held.append(batch.slice(begin, end - begin))
                else:
                    yield pa.Table.from_batches([*held, batch.slice(begin, end - begin)])
                    held = []
            elif end == n:
                held = [batch.slice(begin, end - begin)]
            else:
                yield pa.Table.from_batches([batch.slice(begin, end - begin)])
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
