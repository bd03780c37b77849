"""Language-model scores by Katz backoff over words.

An n-gram of order k is a word after k - 1 others; texts begin with marks and end with an end, which
is a word. P_k(w | h) = d(c) c(h, w) / (c(h) + RESERVE) where training has the n-gram, else
a(h) P_{k-1}(w | h') with h' one word shorter, down to P_1(w), which is d(c) c(w) / N or what that
leaves for all unseen words together. The discounts d are Good-Turing's, of each order. The weights
a(h) share exactly what the seen n-grams leave among the unseen words, so that the probabilities
after every h add up to one; after an h that training doesn't have, the weight is 1.

Texts are gathered into blocks of about a million tokens. Order by order, a block asks for the counts
of its distinct n-grams, packed by ranges of their hashes; a range is counted by one task, which
writes its part of the n-gram table and answers the blocks. With the counts, blocks send what their
n-grams take from each context, to ranges of contexts, whose weights are stored and sent back in the
same way. As blocks ask once for an n-gram, however often it occurs, no range is larger for a
frequent one; only cells that aren't empty are sent, so messages never outnumber the n-grams.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_words, mix, runs, small_batches, stored, table, valid, words_of
from .ppm import crc_mod

#: Words of the longest n-grams.
ORDER = 3
#: Tokens of a block, and n-grams asked for in a range, about.
BLOCK = 1_000_000
#: Parts in which n-grams are exchanged and blocks are scored, one after another, so that a part's shuffle is gone before the next.
PARTS = 2
#: Tasks of an exchange, at most; beyond that a task counts several ranges, one after another.
TASKS = 50_000
#: Counts up to this are discounted.
K = 5
#: Part of an event that every context keeps for unseen words, so that its discount is never nothing.
RESERVE = 0.1
_END = np.uint64(0x5851F42D4C957F2D)
_BEGIN = np.uint64(0x14057B7EF767814F)
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)

_BLOCKS = (
    "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary, n_words long, n_tokens long"
)
_ASKED = "bucket int, block long, keys binary, counts binary, flags binary"
_ANSWERED = _ASKED + ", of_counts array<long>, total long, distinct long"
_STATES = (
    "part int, block long, bucket int, doc_ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>,"
    " base array<double>, score array<double>, keys binary, counts binary, shorter binary, mass binary, lower binary,"
    " flags binary, docs binary, places binary"
)
_WEIGHTS = "part int, block long, bucket int, keys binary, weights binary"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_TYPES = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()),
    "array<double>": pa.list_(pa.float64()),
}


def batch_of(schema: str, rows: list[dict]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in zip(names, kinds, strict=True)], names)


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all lowest ones first: the high ones of small numbers become runs of zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack(values: np.ndarray) -> bytes:
    """Numbers most of which are small, or of few different values."""
    return zlib.compress(planes(values), 1)


def unpack(raw: bytes, dtype) -> np.ndarray:
    return from_planes(zlib.decompress(raw), dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted hashes, as differences; only their high bytes could be compressed, which Spark does."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, np.uint64), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which of so many equal ranges of 64-bit numbers keys are in."""
    return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def cells(keys: np.ndarray, buckets: int):
    """Of sorted keys, each of so many equal ranges of 64-bit numbers that has any: its number, and a slice."""
    if len(keys):
        bucket = bucket_of(keys, buckets)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(bucket[begin]), slice(begin, end)


def _blocks(batches):
    ids, held, sizes, hashes, n, seq = [], [], [], [], 0, 0

    def block():
        words, tokens, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        return batch_of(_BLOCKS, [{
            "block": TaskContext.get().partitionId() << 32 | seq, "doc_ids": ids, "held": held, "sizes": sizes,
            "words": words[order].tobytes(), "tokens": pack(number[tokens]), "n_words": len(words), "n_tokens": len(tokens),
        }])

    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        for doc_id, text, out in rows:
            h = np.append(hash_words(words_of(text)), _END)
            ids.append(doc_id), held.append(out), sizes.append(len(h)), hashes.append(h)
            n += len(h)
            if n >= BLOCK:
                yield block()
                ids, held, sizes, hashes, n, seq = [], [], [], [], 0, seq + 1
    if n:
        yield block()


class Block:
    """Tokens of some documents, and the hashes of the n-grams that end with them."""

    def __init__(self, row: dict):
        self.number, self.ids, self.held = row["block"], row["doc_ids"], row["held"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)[unpack(row["tokens"], np.int32)]
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.train = ~np.array(self.held, bool)[self.doc]
        self.first = np.cumsum(self.sizes) - self.sizes

    def orders(self, order: int):
        """For each order: hashes of the tokens' contexts (None for words) and of their n-grams."""
        grams = self.words
        yield None, grams
        for _ in range(1, order):
            contexts = np.concatenate([grams[:1], grams[:-1]])
            contexts[self.first] = _BEGIN
            grams = mix(contexts * _MULTIPLIER ^ self.words)
            yield contexts, grams

    def questions(self, k: int, buckets: int, part: int, parts: int):
        """What the block asks for in a part: its distinct n-grams of order k, with their counts in training."""
        grams = list(self.orders(k))[-1][1]
        chosen = slice(None) if parts == 1 else bucket_of(grams, buckets) % np.uint64(parts) == part
        train = self.train[chosen]
        follow = np.ones(len(grams), bool)
        follow[np.cumsum(self.sizes) - 1] = False
        keys, at = np.unique(grams[chosen], return_inverse=True)
        counts = np.bincount(at[train], minlength=len(keys)).astype(np.uint32)
        wanted = np.zeros(len(keys), np.uint8)  # as a context of a held-out token
        wanted[at[follow[chosen] & ~train]] = 1
        for bucket, p in cells(keys, buckets):
            yield {"bucket": bucket, "block": self.number, "keys": pack_sorted(keys[p]), "counts": pack(counts[p]),
                   "flags": pack(wanted[p])}


def _ask(k: int, buckets: int, part: int, parts: int):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                rows = list(Block(batch.slice(at, 1).to_pylist()[0]).questions(k, buckets, part, parts))
                for begin in range(0, len(rows), 64):
                    yield batch_of(_ASKED, rows[begin : begin + 64])

    return run


#: Bits of an answer's flags: this block is the first of those that have the n-gram in training; some block wants it as a context.
FIRST, WANTED = 1, 2


def _answer(batches):
    """Counts a range of n-grams: a row of the n-gram table (block null), and an answer to each block."""
    for group in runs(batches, ["bucket"]):
        rows = group.to_pylist()
        asked = [unpack_sorted(r["keys"]) for r in rows]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        own = np.concatenate([unpack(r["counts"], np.uint32) for r in rows])
        total = np.bincount(at, own, len(keys)).astype(np.int64)
        wanted = np.bincount(at, np.concatenate([unpack(r["flags"], np.uint8) for r in rows]), len(keys)) > 0
        flags = np.where(wanted[at], WANTED, 0).astype(np.uint8)
        seen = np.flatnonzero(own)
        flags[seen[np.unique(at[seen], return_index=True)[1]]] |= FIRST
        known = total > 0
        yield batch_of(_ANSWERED, [{
            "bucket": rows[0]["bucket"], "keys": pack_sorted(keys[known]), "counts": pack(total[known]),
            "of_counts": np.bincount(total[total <= K + 1], minlength=K + 2).tolist(), "total": int(total.sum()),
            "distinct": int(known.sum()),
        }])
        begin = 0
        for r, k in zip(rows, asked, strict=True):
            part = slice(begin, begin + len(k))
            yield batch_of(_ANSWERED, [{"bucket": r["bucket"], "block": r["block"], "counts": pack(total[at[part]]), "flags": pack(flags[part])}])
            begin += len(k)


def discounts(of_counts: list[int], k: int = K) -> np.ndarray:
    """d(0), ..., d(k + 1) by Good-Turing; d(k + 1), of all larger counts, is 1.

    Where the counts of counts don't give discounts between 0 and 1, as with little text, half an
    event is taken off each count.
    """
    n = np.array(of_counts, float)
    out = np.ones(k + 2)
    r = np.arange(1, k + 1)
    if (n[1 : k + 2] > 0).all():
        rest = (k + 1) * n[k + 1] / n[1]
        good = (r + 1) * n[2 : k + 2] / (r * n[1 : k + 1])
        if rest < 1:
            d = (good - rest) / (1 - rest)
            if (d > 0).all() and (d < 1).all():
                out[1 : k + 1] = d
                return out
    out[1 : k + 1] = 1 - 0.5 / r
    return out


class Model:
    """Of the whole of training: tokens, distinct words, texts, discounts of each order, what is left for unseen words."""

    def __init__(self, total: int, distinct: int, texts: int, of_counts: list[list[int]]):
        self.total, self.distinct, self.texts = total, distinct, texts
        self.d = [discounts(n) for n in of_counts]
        r = np.arange(K + 2)
        self.unseen = float((np.array(of_counts[0]) * r * (1 - self.d[0]))[: K + 1].sum()) / total if total else 1.0

    def kept(self, k: int, c: np.ndarray) -> np.ndarray:
        """The discounted counts of n-grams of order k."""
        return self.d[k - 1][np.minimum(c, K + 1)] * c

    def seen(self, k: int, c: np.ndarray, of_context) -> np.ndarray:
        """P of n-grams of order k that training has, by their counts and those of their contexts."""
        return self.kept(k, c) / (of_context + RESERVE if k > 1 else max(1, self.total))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def weight(self, k: int, mass: np.ndarray, lower: np.ndarray, count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """a(h) of contexts of order k, from what is taken off their n-grams, and what the shorter ones of these keep.

        count and shorter are the counts of h and of h without its first word.
        """
        whole = shorter + RESERVE if k > 2 else float(max(1, self.total))
        return (RESERVE + mass) / (count + RESERVE) * (whole / np.maximum(whole - lower, 1e-300))


def _states(model: Model, order: int, buckets: int):
    """Part 0 of a block's result: its documents, scored but for the weights, and in parts 2, 3, ... what these orders need.

    Part k has, for ranges of contexts of order k, the keys of those that held-out tokens want:
    mass and lower are what the block's n-grams (those it is the first to have) add to what is taken
    off the context's n-grams and to what the shorter ones of these keep; counts and shorter are those
    of the context and of the shorter one; flags say which contexts the block's own tokens back off
    from. Parts order + 2, order + 3, ...: which document does, and at which of the flagged keys.
    """

    def run(batches):
        for group in runs(batches, ["block"]):
            rows = group.to_pylist()
            b = Block(next(r for r in rows if r["part"] == 0))
            n = len(b.ids)
            todo = np.ones(len(b.words), bool)  # tokens whose n-grams of higher orders weren't seen
            out, steps = [], list(b.orders(order))
            below, places = None, {}
            counts: list[np.ndarray] = []
            wanted: list[np.ndarray] = []
            firsts: list[np.ndarray] = []
            for k in range(1, order + 1):
                keys, at = np.unique(steps[k - 1][1], return_inverse=True)
                own = sorted((r for r in rows if r["part"] == k), key=lambda r: r["bucket"])
                c = np.concatenate([unpack(r["counts"], np.int64) for r in own])
                flags = np.concatenate([unpack(r["flags"], np.uint8) for r in own])
                counts.append(c[at])
                wanted.append(flags[at] & WANTED > 0)
                one = np.zeros(len(keys), np.int64)
                one[at[::-1]] = np.arange(len(at))[::-1]  # the first token of each n-gram
                firsts.append(one[flags & FIRST > 0])
            del rows, group

            def before(values, at_begin):
                moved = np.concatenate([values[:1], values[:-1]])
                moved[b.first] = at_begin
                return moved

            log = np.zeros(len(b.words))
            for k in range(order, 0, -1):
                c = counts[k - 1]
                of_context = before(counts[k - 2], model.texts) if k > 1 else None
                hit = todo & (c > 0)
                log[hit] = np.log10(model.seen(k, c[hit], of_context[hit] if k > 1 else None))
                todo &= c == 0
                if k == 1:
                    log[todo] = np.log10(model.unseen)
                    break
                contexts = steps[k - 1][0]
                back = np.flatnonzero(todo & (of_context > 0))
                one = firsts[k - 1]
                one = one[before(wanted[k - 2], True)[one]]
                keys, at = np.unique(np.concatenate([contexts[one], contexts[back]]), return_inverse=True)
                taken, of_back = at[: len(one)], at[len(one) :]
                mass = np.bincount(taken, c[one] - model.kept(k, c[one]), len(keys))
                lower = np.bincount(taken, model.kept(k - 1, counts[k - 2][one]), len(keys))
                count, shorter = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                count[taken], count[of_back] = of_context[one], of_context[back]
                if k > 2:
                    of_shorter = before(counts[k - 3], model.texts)
                    shorter[taken], shorter[of_back] = of_shorter[one], of_shorter[back]
                mine = np.zeros(len(keys), np.uint8)
                mine[of_back] = 1
                place = np.cumsum(mine) - 1
                yield batch_of(_STATES, [{"part": k + order, "block": b.number, "docs": pack(b.doc[back]),
                                          "places": pack(place[of_back].astype(np.int32))}])
                rows = [
                    {"part": k, "block": b.number, "bucket": bucket, "keys": pack_sorted(keys[p]), "counts": pack(count[p]),
                     "shorter": pack(shorter[p]), "mass": pack(mass[p]), "lower": pack(lower[p]), "flags": pack(mine[p])}
                    for bucket, p in cells(keys, buckets)
                ]
                for begin in range(0, len(rows), 64):
                    yield batch_of(_STATES, rows[begin : begin + 64])
            yield batch_of(_STATES, [{
                "part": 0, "block": b.number, "doc_ids": b.ids, "held": b.held, "n_tokens": b.sizes.tolist(),
                "n_known": np.bincount(b.doc, counts[0] > 0, n).astype(np.int64).tolist(),
                "base": np.bincount(b.doc, model.base(counts[0]), n).tolist(), "score": np.bincount(b.doc, log, n).tolist(),
            }])

    return run


def _weigh(model: Model):
    """The weights of a range of contexts: a row of their table (block null), and those each block asked for."""

    def run(batches):
        for group in runs(batches, ["part", "bucket"]):
            rows = group.to_pylist()
            asked = [unpack_sorted(r["keys"]) for r in rows]
            keys, at = np.unique(np.concatenate(asked), return_inverse=True)
            mass, lower = (np.bincount(at, np.concatenate([unpack(r[c], np.float64) for r in rows]), len(keys)) for c in ("mass", "lower"))
            count, shorter = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            count[at] = np.concatenate([unpack(r["counts"], np.int64) for r in rows])
            shorter[at] = np.concatenate([unpack(r["shorter"], np.int64) for r in rows])
            part, bucket = rows[0]["part"], rows[0]["bucket"]
            weights = model.weight(part, mass, lower, count, shorter)
            yield batch_of(_WEIGHTS, [{"part": part, "bucket": bucket, "keys": pack_sorted(keys), "weights": pack(weights)}])
            begin = 0
            for r, k in zip(rows, asked, strict=True):
                own = weights[at[begin : begin + len(k)]][unpack(r["flags"], np.uint8) > 0]
                begin += len(k)
                if len(own):
                    yield batch_of(_WEIGHTS, [{"part": part, "bucket": bucket, "block": r["block"], "weights": pack(own)}])

    return run


def _finish(order: int):
    """Adds the weights to the scores of a block's documents."""
    fields = [c.split() for c in _SCORED.split(", ")]

    def run(batches):
        for group in runs(batches, ["block"]):
            rows = group.to_pylist()
            docs = next(r for r in rows if r["part"] == 0)
            score = np.array(docs["score"])
            for k in range(2, order + 1):
                back = next(r for r in rows if r["part"] == k + order)
                own = sorted((r for r in rows if r["part"] == k), key=lambda r: r["bucket"])
                if own:
                    logs = np.log10(np.concatenate([unpack(r["weights"], np.float64) for r in own]))
                    score += np.bincount(unpack(back["docs"], np.int32), logs[unpack(back["places"], np.int32)], len(score))
            columns = docs["doc_ids"], docs["held"], docs["n_tokens"], docs["n_known"], docs["base"], score
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields]
            )

    return run


def score_documents(docs: DataFrame, held_out, order: int = ORDER, model_path: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of docs (``doc_id, text``).

    The model, of n-grams of up to order words, learns from the rows for which held_out is false and
    scores all. A null or empty text is one token, the end. Words that training doesn't have share one
    probability. Without training rows every token has probability 1. Repeated rows count and are
    scored each time; a null doc_id is kept; other columns are ignored. The tables of the n-grams
    (``ngrams-1``, ..., packed by ranges of their hashes) and of the weights stay in the folder
    model_path if there is one, else they go with the rest.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text"), held_out.alias("held"))
    half = F.pmod(F.xxhash64("block"), F.lit(PARTS)).alias("half")
    with Scratch(spark) as scratch:
        blocks = scratch.store(docs.mapInArrow(_blocks, _BLOCKS).select("*", half), "katz-blocks", "half")
        size = blocks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
        buckets = [1 + int((n or 0) // BLOCK) for n in (size[0], *[size[1]] * (order - 1))]
        answers, of_counts, totals = [], [], []
        for k in range(1, order + 1):
            parts = min(PARTS, buckets[k - 1]) if k > 1 else 1
            stats = []
            for part in range(parts):
                asked = blocks.mapInArrow(_ask(k, buckets[k - 1], part, parts), _ASKED)
                asked = asked.repartition(min(-(-buckets[k - 1] // parts), TASKS), "bucket").sortWithinPartitions("bucket", "block")
                answered = asked.mapInArrow(_answer, _ANSWERED).select("*", half, F.when(F.col("block").isNull(), "table").otherwise("answers").alias("of"))
                name = f"katz-ngrams-{k}-{part}"
                answered = scratch.store(answered, name, ["of", "half"])
                n_grams = answered.where("of = 'table'")
                sums = [F.sum(F.col("of_counts")[r]) for r in range(K + 2)]
                stats.append([x or 0 for x in n_grams.agg(F.sum("total"), F.sum("distinct"), *sums).first()])
                if model_path:
                    n_grams.select("bucket", "keys", "counts").write.mode("append").parquet(f"{model_path}/ngrams-{k}")
                scratch.drop(name, part="of=table")  # each block has its answers
                answers.append((name, answered.where("of = 'answers'").select(F.lit(k).alias("part"), "block", "bucket", "counts", "flags", "half")))
            total, distinct, *n = (sum(x) for x in zip(*stats, strict=True))
            totals.append((total, distinct)), of_counts.append(n)
        texts = docs.where(~F.col("held")).count()
        model = Model(*totals[0], texts, of_counts)

        states = []
        for part in range(PARTS):
            both = blocks.withColumn("part", F.lit(0))
            for _, own in answers:
                both = both.unionByName(own, allowMissingColumns=True)
            both = both.where(F.col("half") == part).drop("half").repartition("block").sortWithinPartitions("block", "part", "bucket")
            states.append(scratch.store(both.mapInArrow(_states(model, order, buckets[-1]), _STATES), f"katz-states-{part}"))
            scratch.drop("katz-blocks", part=f"half={part}")
            for name, _ in answers:
                scratch.drop(name, part=f"of=answers/half={part}")
        states = reduce(DataFrame.union, states)

        of_contexts = F.col("part").between(2, order)
        asked = states.where(of_contexts).select("part", "bucket", "block", "keys", "counts", "shorter", "mass", "lower", "flags")
        asked = asked.repartition(min(buckets[-1] * max(1, order - 1), TASKS), "part", "bucket")
        asked = asked.sortWithinPartitions("part", "bucket", "block")
        weights = scratch.store(asked.mapInArrow(_weigh(model), _WEIGHTS), "katz-weights")
        if model_path:
            weights.where(F.col("block").isNull()).drop("block").write.parquet(f"{model_path}/weights")
        own = weights.where(F.col("block").isNotNull()).select("part", "block", "bucket", "weights")
        rest = states.where(~of_contexts).select("part", "block", "doc_ids", "held", "n_tokens", "n_known", "base", "score", "docs", "places")
        rest = rest.unionByName(own, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "part", "bucket")
        scored = stored(rest.mapInArrow(_finish(order), _SCORED), "katz-scores")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals[0][0]).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score_documents(table(spark, sf_dir, "documents"), crc_mod(10) == 0)
