"""How far the sources of a language are from one another in their use of terms.

Terms are counted under fixed-width digests, so that no string takes part in the counting shuffles.
The smallest and the largest string of a digest tell whether it stands for one term or several;
those of several are split by their strings. Strings are joined back to the terms that are returned.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, resident, small_batches, stored, table

#: A-Z lower-cased, a-z and what isn't ASCII kept, all else a space: terms are what is between spaces.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split at once.
SLICE = 1 << 20
#: Entries of a task's counts before it gives them out.
HELD = 1 << 20
#: Rows of kept digests (8 bytes each) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Scale of probabilities.
UNIT = 1_000_000_000


def terms_of(text: str):
    """Lists of the terms of a text, as UTF-8, a slice at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERMS)
    begin = 0
    while begin < len(data):
        end = len(data) if len(data) - begin <= SLICE else data.find(b" ", begin + SLICE)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def _given_out(held: dict, bits: int, flush: int) -> pa.RecordBatch:
    """Rows of a task's counts, sorted by digest; the string stands in the first row of a digest, or in all if there are several."""
    words = [w for n, _ in held.values() for w in n]
    digest = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - bits)
    order = np.argsort(digest, kind="stable")
    digest = digest[order]
    words = pa.array(words, pa.binary()).take(pa.array(order))
    first = np.ones(len(order), bool)
    first[1:] = digest[1:] != digest[:-1]
    code = words.dictionary_encode().indices.to_numpy()
    begins = np.flatnonzero(first)
    mixed = np.minimum.reduceat(code, begins) != np.maximum.reduceat(code, begins)
    shown = first | np.repeat(mixed, np.diff(np.append(begins, len(order))))
    sizes = [len(n) for n, _ in held.values()]
    columns = [np.repeat(np.arange(len(sizes)), sizes)[order]]
    names = [pa.array([key[k] for key in held], pa.string()) for k in (0, 1)]
    n = np.fromiter((x for c, _ in held.values() for x in c.values()), np.int64, len(order))[order]
    d = np.fromiter((c[w] for m, c in held.values() for w in m), np.int64, len(order))[order]
    text = pa.compute.if_else(pa.array(shown), words, pa.scalar(None, pa.binary())).cast(pa.string())
    out = [*(x.take(pa.array(columns[0])) for x in names), pa.array(digest.view(np.int64)), text, pa.array(n), pa.array(d), pa.array(np.full(len(order), flush))]
    return pa.RecordBatch.from_arrays(out, ["lang", "source", "digest", "term", "n", "d", "flush"])


def _counted(bits: int):
    def run(batches):
        resident("divergence", lambda: None)
        held, size, flush = {}, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in terms_of(text):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
                size += len(n) - before
                if size >= HELD:
                    yield _given_out(held, bits, flush)
                    held, size, flush = {}, 0, flush + 1
        if size:
            yield _given_out(held, bits, flush)

    return run


def _share(count: str, total: str, n_terms: str) -> F.Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * n_terms)), exact beyond 64 bits."""
    wide = f"cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(19,0))"
    return F.expr(f"1 + ({wide}) div cast({total} + 2 * {n_terms} as decimal(19,0))")


def _gap(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _np_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


#: Rows that are held together, and pairs that are added up at once, where sources meet over a term.
ROWS, PAIRS = 1 << 17, 1 << 21


def _summed(keys: list[np.ndarray], values: list[np.ndarray], groups: np.ndarray) -> pa.RecordBatch:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, np.concatenate(values))
    a, b = np.divmod(key, len(groups))
    return pa.RecordBatch.from_arrays([pa.array(groups[a]), pa.array(groups[b]), pa.array(total)], ["a", "b", "both"])


def _met(rows: pa.Table):
    """For the pairs of sources that share terms: what these add beyond what each adds where the other has none."""
    lid, digest, part, gid, p, p0 = (rows.column(k).to_numpy() for k in ("lid", "digest", "part", "gid", "p", "p0"))
    new = np.ones(len(gid), bool)
    new[1:] = (lid[1:] != lid[:-1]) | (digest[1:] != digest[:-1]) | (part[1:] != part[:-1])
    term = np.cumsum(new)
    groups, code = np.unique(gid, return_inverse=True)
    keys, values, size = [], [], 0
    for k in range(1, len(term)):
        i = np.flatnonzero(term[k:] == term[:-k])
        if not len(i):
            break
        for at in np.array_split(i, -(-len(i) // PAIRS)):
            to = at + k
            swap = code[at] > code[to]
            x, y = np.where(swap, to, at), np.where(swap, at, to)
            keys.append(code[x] * len(groups) + code[y])
            values.append(_np_gap(p[x], p[y]) - _np_gap(p[x], p0[y]) - _np_gap(p0[x], p[y]) + _np_gap(p0[x], p0[y]))
            size += len(at)
            if size >= PAIRS:
                yield _summed(keys, values, groups)
                keys, values, size = [], [], 0
    if keys:
        yield _summed(keys, values, groups)


def _meet(batches):
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = [rows.column(k).to_numpy() for k in ("lid", "digest", "part")]
        same = np.logical_and.reduce([x == x[-1] for x in key])  # the last term, which may go on
        cut = int(np.argmax(same))
        if cut:
            yield from _met(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            size = len(rows) - cut
    if size:
        yield from _met(pa.Table.from_batches(held))


def source_divergence(docs: DataFrame, top: int = 10, least_documents: int = 10, bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank`` of docs (``text, lang, source``).

    A language keeps the terms in at least least_documents of its rows. With p and q the smoothed
    shares of a term, in UNITs, in two groups, the gap is floor((p - q)**2 / (p + q)).

    * Part ``pair``: for each source of a language, every other one with the sum of the gaps of all
      kept terms, 0 if the language keeps none.
    * Part ``term``: the top terms that a source uses more than its language, by their gaps.
    * Null text, lang and source count as empty. Groups without terms have the smoothed shares; a
      language's only source has no pairs. Rows that repeat count each.
    * Ties go by the item's UTF-8 order. An empty table gives an empty result; other columns of docs
      are ignored. bits is the width of digests; narrower ones collide and are split, with equal results.
    """
    text, lang, source = (F.coalesce(F.make_valid_utf8(F.col(c).cast("string")), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    docs = docs.select(lang, source, text)
    with Scratch(docs.sparkSession) as scratch:
        schema = "lang string, source string, digest long, term string, n long, d long, flush long"
        terms = scratch.store(docs.mapInArrow(_counted(bits), schema), "divergence-terms")
        groups, seed = None, 0
        while groups is None:  # until the digests of groups, too, are of one each
            lid, gid = F.xxhash64(F.lit(seed), "lang"), F.xxhash64(F.lit(seed), "lang", "source")
            named = scratch.store(docs.select("lang", "source").distinct().select(lid.alias("lid"), gid.alias("gid"), "lang", "source"), f"divergence-groups-{seed}")
            n = named.agg(F.count_distinct("gid"), F.count("*"), F.count_distinct("lid"), F.count_distinct("lang")).first()
            groups, seed = (named, seed) if n[0] == n[1] and n[2] == n[3] else (None, seed + 1)
        terms = terms.withColumns({"lid": lid, "gid": gid})

        term = Window.partitionBy("lid", "digest", "part")
        frequent = F.sum("d").over(term) >= least_documents
        counts = terms.groupBy("lid", "gid", "digest").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        counts = counts.withColumn("part", F.lit(0)).withColumns({"ok": frequent, "all_n": F.sum("n").over(term)}).where("ok")
        counts = scratch.store(counts.drop("ok"), "divergence-counts")

        digests = scratch.store(counts.select("digest").distinct(), "divergence-digests")
        shown = terms.where(F.col("term").isNotNull()).select("digest", "term")
        if digests.count() <= BROADCAST_ROWS:  # else both sides are shuffled
            digests = F.broadcast(digests)
        strings = shown.join(digests, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
        strings = scratch.store(strings, "divergence-strings")
        mixed = strings.where(F.col("low") != F.col("high")).select("digest")
        strings = strings.where(F.col("low") == F.col("high")).select("digest", F.lit(0).alias("part"), F.col("low").alias("term"))
        if not mixed.isEmpty():
            same = Window.partitionBy("flush", "digest")
            split = terms.join(mixed, "digest", "left_semi").withColumn("term", F.coalesce("term", F.max("term").over(same)))
            split = split.groupBy("lid", "gid", "digest", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
            split = split.withColumn("part", F.dense_rank().over(Window.partitionBy("digest").orderBy("term")))
            split = scratch.store(split.withColumns({"ok": frequent, "all_n": F.sum("n").over(term)}).where("ok").drop("ok"), "divergence-split")
            counts = counts.join(mixed, "digest", "left_anti").unionByName(split.drop("term"))
            strings = strings.unionByName(split.select("digest", "part", "term").distinct())

        per_group = counts.groupBy("gid").agg(F.sum("n").alias("total"))
        per_lang = counts.select("lid", "digest", "part", "all_n").distinct().groupBy("lid").agg(F.sum("all_n").alias("lang_total"), F.count("*").alias("n_terms"))
        stats = groups.join(per_group, "gid", "left").join(per_lang, "lid", "left").na.fill(0, ["total", "lang_total", "n_terms"])
        p0 = F.when(F.col("n_terms") > 0, _share("0", "total", "n_terms"))
        stats = scratch.store(stats.withColumn("p0", p0), "divergence-stats")
        shares = counts.drop("d").join(stats.drop("lid", "lang", "source"), "gid").withColumn("p", _share("n", "total", "n_terms"))
        shares = scratch.store(shares.withColumn("q", _share("all_n", "lang_total", "n_terms")), "divergence-shares")
        scratch.drop("divergence-counts")

        best = Window.partitionBy("gid").orderBy(F.desc("value"))
        marked = shares.where(F.col("p") > F.col("q")).select("gid", "digest", "part", _gap("p", "q").alias("value"))
        marked = marked.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top)
        marked = marked.join(strings, ["digest", "part"]).withColumn("rank", F.row_number().over(best.orderBy(F.desc("value"), "term")))
        marked = marked.where(F.col("rank") <= top).join(stats, "gid")
        marked = marked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

        met = shares.select("lid", "digest", "part", "gid", "p", "p0").repartition("lid", "digest", "part")
        met = met.sortWithinPartitions("lid", "digest", "part").mapInArrow(_meet, "a long, b long, both long")
        met = met.groupBy("a", "b").agg(F.sum("both").alias("both"))
        others = stats.select("lid", F.col("gid").alias("other"), F.col("source").alias("item"), F.col("p0").alias("q0"))
        alone = shares.groupBy("lid", "gid", "p", "p0").agg(F.count("*").alias("m")).join(others, "lid").where(F.col("gid") != F.col("other"))
        alone = alone.groupBy("gid", "other").agg(F.sum(F.col("m") * (_gap("p", "q0") - _gap("p0", "q0"))).alias("own"))
        alone = scratch.store(alone, "divergence-alone")
        theirs = alone.select(F.col("gid").alias("other"), F.col("other").alias("gid"), F.col("own").alias("theirs"))
        pairs = stats.join(others, "lid").where(F.col("gid") != F.col("other"))
        pairs = pairs.withColumns({"a": F.least("gid", "other"), "b": F.greatest("gid", "other")})
        pairs = pairs.join(alone, ["gid", "other"], "left").join(theirs, ["gid", "other"], "left").join(met, ["a", "b"], "left")
        none = F.lit(0).cast("long")
        value = F.coalesce(F.col("n_terms") * _gap("p0", "q0"), none) + sum((F.coalesce(F.col(c), none) for c in ("own", "theirs", "both")), none)
        pairs = pairs.withColumn("value", value)
        pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item")))
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
        return stored(pairs.unionByName(marked), "divergence-result")


def op11_source_divergence(spark, sf_dir) -> DataFrame:
    small_batches(spark)
    return source_divergence(table(spark, sf_dir, "documents"))


#: Lower-casing of A-Z alone.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs
), occurrences AS (SELECT row_id, lang, source, unnest(words) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS all_n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10
), counts AS (
  SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL
), per_lang AS (SELECT lang, count(*) AS v, sum(all_n) AS total FROM kept GROUP BY lang
), per_group AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.all_n + 2)) // (l.total + 2 * l.v)::HUGEINT AS q
  FROM per_group g JOIN per_lang l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
), marked AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marked)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
