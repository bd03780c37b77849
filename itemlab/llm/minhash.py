"""Near-duplicate documents by min-max hashing.

Under each permutation the smallest and the largest image of a document's shingles are kept, so that
a signature of 2P values costs P hash evaluations per shingle; each value agrees between two
documents with a probability that equals the Jaccard similarity of their sets. Bands of the
signature propose candidates, and every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_ngrams, hash_words, mix, resident, runs, small_batches, stored, table, valid, words_of
from .components import connected_components

#: Signature values in a band; even, as a permutation gives two.
ROWS = 8
#: Chance that a pair of just the threshold's similarity shares no band.
MISS = 1e-6
#: Standard errors by which a signature may understate a similarity before a candidate is dropped.
SLACK = 5.5
#: Members of a group that meet in one task; larger groups are compared block against block.
BLOCK = 1024
#: Keys of more members than all have on the average of so many keys are joined by a broadcast; there are fewer than that.
LARGE_KEYS = 500_000
#: Rows of candidates' ids (48 bytes each) that are broadcast to the texts at most.
BROADCAST_ROWS = 1_000_000


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole text if it has fewer words."""
    words = words_of(text)
    return np.unique(hash_ngrams(hash_words(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def n_bands(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS)))


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**32, count, np.uint32) | np.uint32(1), r.integers(0, 2**32, count, np.uint32)


def min_max_signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(P, 2): the least and the greatest of a * x + b modulo 2**32, for each of P permutations."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(a), 2), np.uint32)
    for k in range(0, len(x), 2048):
        y = a[:, None] * x[None, k : k + 2048]
        y += b[:, None]
        low, high = y.min(1), y.max(1)
        out[:, 0] = np.minimum(out[:, 0], low) if k else low
        out[:, 1] = np.maximum(out[:, 1], high) if k else high
    return out


def _sign(n: int, bands: int):
    a, b = permutations(bands * ROWS // 2)
    r = np.random.default_rng(2)
    weights = r.integers(0, 2**63, (bands, ROWS), np.int64).astype(np.uint64) | np.uint64(1)
    salt = np.arange(bands, dtype=np.uint64) << np.uint64(48)

    def run(batches):
        resident("minhash", lambda: None)
        for batch in batches:
            sizes, prints, keys, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, n)
                sizes.append(len(s))
                if not len(s):
                    prints.append(None), keys.append(None), sigs.append(None)
                    continue
                sig = min_max_signature(s, a, b)
                key = mix((sig.reshape(bands, ROWS).astype(np.uint64) * weights).sum(1) + salt)
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(key.view(np.int64))
                sigs.append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "print", "bands", "sig"],
            )

    return run


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """The members of each key in pairs of blocks ``i <= j`` of at most about BLOCK, so that any two meet.

    Keys of many members are joined by a broadcast of their sizes, which the number of members bounds; so no task
    has all members of one.
    """
    many = max(BLOCK, -(-members.count() // LARGE_KEYS))
    sizes = members.groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") > 1)
    large = F.broadcast(sizes.where(F.col("size") > many))
    rest = members.join(large.select(key), key, "left_anti").join(sizes.where(F.col("size") <= many), key)
    members = members.join(large, key).unionByName(rest)
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", key), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    return (
        members.withColumn("own", own)
        .withColumn("other", other)
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("own", "other", "size")
    )


def _meet(members: DataFrame, key: str, function) -> DataFrame:
    """Runs function on the rows of each block pair; it gives edges ``u, v``."""
    members = members.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")
    return members.mapInArrow(function, "u long, v long")


def _edges(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v = (np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def forest(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which near(k, rest) gives the positions in rest linked with k."""
    rest, out = np.arange(1, n), []
    queue, seed = [0], 0
    while True:
        while queue and len(rest):
            k = queue.pop()
            hit = near(k, rest)
            if len(hit):
                found = rest[hit]
                out += [(k, int(x)) for x in found]
                queue += found.tolist()
                rest = np.delete(rest, hit)
        if not len(rest):
            return out
        seed, rest = int(rest[0]), rest[1:]
        queue = [seed]


def _alike(threshold: float, width: int):
    """Forests of the pairs in a bucket whose signatures may belong to a pair of the threshold's similarity."""
    # Values are compared by their low 8 bits: unlike ones agree once in 256.
    least = (threshold - SLACK * math.sqrt(threshold * (1 - threshold) / width)) * width

    def run(batches):
        out = []
        for group in runs(batches, ["key", "i", "j"]):
            ids = np.unique(group.column("rep").to_numpy(), return_index=True)
            rep, at = ids
            if len(rep) < 2:
                continue
            sigs = group.column("sig").take(pa.array(at)).to_pylist()
            m = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(rep), width)
            pairs = forest(len(rep), lambda k, rest, m=m: np.flatnonzero((m[rest] == m[k]).sum(1) >= least))
            if pairs:
                p = np.array(pairs)
                out.append((rep[p[:, 0]], rep[p[:, 1]]))
            if len(out) >= 1000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


class _Sets:
    """Intersections of one set with many, through the lists of the sets that hold each item."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.item = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        self.n_items = int(self.item.max(initial=-1)) + 1
        self.among = None

    def _index(self, among: np.ndarray) -> None:
        chosen = np.zeros(len(self.size), bool)
        chosen[among] = True
        at = np.flatnonzero(chosen[self.owner])
        at = at[np.argsort(self.item[at], kind="stable")]
        self.lists = self.owner[at]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.item[at], minlength=self.n_items))])
        self.among = len(among)

    def shared(self, k: int, rest: np.ndarray) -> np.ndarray:
        """Size of the intersection of set k with each set of rest, which only ever loses members."""
        if self.among is None or len(rest) < self.among // 2:
            self._index(rest)
        items = self.item[self.begin[k] : self.begin[k + 1]]
        lengths = self.first[items + 1] - self.first[items]
        flat = np.repeat(self.first[items] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        owners = self.lists[flat + np.arange(len(flat))]
        return np.bincount(owners, minlength=len(self.size))[rest]


def link_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the sets linked by 100 * intersection >= percent * union."""
    s = _Sets(sets)

    def near(k, rest):
        both = s.shared(k, rest)
        return np.flatnonzero(100 * both >= percent * (s.size[k] + s.size[rest] - both))

    return forest(len(sets), near)


def _confirm(n: int, percent: int):
    def run(batches):
        out = []
        for group in runs(batches, ["g", "i", "j"]):
            rep, at = np.unique(group.column("rep").to_numpy(), return_index=True)
            if len(rep) < 2:
                continue
            sets = [shingles(t, n) for t in group.column("text").take(pa.array(at)).to_pylist()]
            if pairs := link_forest(sets, percent):
                p = np.array(pairs)
                out.append((rep[p[:, 0]], rep[p[:, 1]]))
            if len(out) >= 1000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` for each row of docs (``doc_id, text``).

    Documents are linked where 100 * intersection >= percent * union of their sets of n-word
    shingles; component_id is the smallest doc_id that links reach, kept marks that document.

    * Equal sets collapse before anything is compared, so that copies of any number cost one row
      each. Texts of one doc_id that differ are sets of their own, each with its links.
    * Buckets of a band, and candidate groups, of more than BLOCK members are compared block against
      block; no bucket, group or candidate is capped.
    * A null, empty or wordless text has an empty set (n_shingles 0), is linked with nothing and kept.
    * text_hash, Spark's xxhash64 of the text, tells rows apart that have one doc_id and different texts.
    * Rows that repeat a doc_id with one text are each returned, with equal columns. A null doc_id
      takes no part in linking: component_id null, kept true.
    * Other columns of docs are ignored; an empty table gives an empty result.
    """
    threshold = percent / 100
    bands = n_bands(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text"), F.xxhash64("text").alias("text_hash"))
    with Scratch(docs.sparkSession) as scratch:
        signed = docs.mapInArrow(_sign(n, bands), "doc_id long, text_hash long, n_shingles long, print binary, bands array<long>, sig binary")
        signed = scratch.store(signed, "minhash-signatures")
        real = signed.where(F.col("doc_id").isNotNull() & F.col("print").isNotNull())
        # sets are numbered by themselves: a doc_id may have several texts
        who = F.min(F.struct("doc_id", "text_hash")).alias("who")
        first = real.groupBy("print").agg(who).select("print", "who.doc_id", "who.text_hash", F.monotonically_increasing_id().alias("rep"))
        first = scratch.store(first, "minhash-sets")
        reps = real.join(first, ["print", "doc_id", "text_hash"]).select("rep", "bands", "sig")

        keyed = reps.select(F.explode("bands").alias("key"), "rep")
        shared = keyed.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
        shared = shared.where(F.col("a") < F.col("b")).select("key")
        members = scratch.store(keyed.join(shared, "key").distinct(), "minhash-buckets")
        signs = reps.select("rep", "sig")
        buckets = _blocks(members, "key").join(signs, "rep")
        alike = _meet(buckets.select("key", "i", "j", "rep", "sig"), "key", _alike(threshold, bands * ROWS))

        groups = connected_components(alike, scratch, "minhash-candidates")
        scratch.drop("minhash-buckets")
        groups = _blocks(groups.select(F.col("component").alias("g"), F.col("node").alias("rep")), "g")
        groups = groups.join(first.drop("print"), "rep")
        groups = scratch.store(groups, "minhash-groups")
        if groups.count() <= BROADCAST_ROWS:  # else both sides are shuffled
            groups = F.broadcast(groups)
        texts = docs.join(groups, ["doc_id", "text_hash"]).select("g", "i", "j", "rep", "text")
        links = _meet(texts, "g", _confirm(n, percent))
        reached = connected_components(links, scratch, "minhash-links").withColumnRenamed("node", "rep")

        linked = reached.join(first.select("rep", "doc_id"), "rep")
        least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
        linked = linked.join(least, "component").select("rep", "least")
        named = first.join(linked, "rep", "left").select("print", F.coalesce("least", "doc_id").alias("component"))
        out = signed.select("doc_id", "text_hash", "n_shingles", "print").join(named, "print", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        kept = component.isNull() | (component == F.col("doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash")
        return stored(out, "minhash-result")


def op1_minhash(spark, sf_dir) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
