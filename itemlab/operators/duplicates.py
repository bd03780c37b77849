"""Questions that resemble others or rejected ones."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..coefficients import DEFAULT, Coefficients
from ..functions.stats import rounded
from ..functions.text import STOP_WORDS, preview, similar_among, tfidf, tokens
from ..functions.vectors import cosine
from .store import settled


def _given_back(rows: DataFrame) -> DataFrame:
    """The rows as settled writes them; the shuffles that led to them don't stay on disk."""
    conf, key = rows.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return settled(rows)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _removed(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more."""
    for rows in tables:
        spark = rows.sparkSession
        for folder in {f.rpartition("/")[0] for f in rows.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _listed(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each begins, with the end of the last."""
    lists = lists.combine_chunks()
    begins = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), begins.astype(np.int64)


def _counted(lists: pa.Array) -> pa.Array:
    """Each list of tokens as ``token, tf``, two lists with every token once."""
    begins = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    found = [np.unique(values[a:b], return_counts=True) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    ends = np.cumsum([0, *(len(t) for t, _ in found)])
    token, tf = (np.concatenate([np.empty(0, kind), *(f[k].astype(kind) for f in found)]) for k, kind in enumerate((np.int64, np.int32)))
    return pa.StructArray.from_arrays([_listed(ends, token), _listed(ends, tf)], ["token", "tf"])


def _worded(texts: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``id, words`` of ``id, text``, with the columns of also."""
    return texts.select("id", "text", *also).repartition(F.xxhash64("id")).select("id", tokens(F.col("text"), 2, STOP_WORDS).alias("words"), *also)


def _key() -> F.Column:
    """Of words in any order, by 256 bits."""
    return F.sha2(F.array_join(F.sort_array("words"), " "), 256)


def _keyed(texts: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``id, terms, key`` of ``id, text``, with the columns of also, made once by all tasks: a file's one row group would be one task's work.

    terms are a list of the distinct tokens and one of their counts. Tokens are told apart by 64 bits, keys by 256.
    """
    rows = _worded(texts, also)
    terms = F.arrow_udf(_counted, "struct<token: array<bigint>, tf: array<int>>")(F.transform("words", lambda w: F.xxhash64(w)))
    return _given_back(rows.select("id", terms.alias("terms"), _key().alias("key"), *also))


#: Rows that ask for the frequencies of their tokens together.
ASKING = 4096


def _ranked(df: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Numbers by which tokens have one order for all, the rarest first: 23 bits of the frequency, 40 of the token."""
    return np.minimum(df, (1 << 23) - 1).astype(np.int64) << 40 | token & ((1 << 40) - 1)


def _weights(vectors: pa.Table) -> np.ndarray:
    """The weights of all vectors ``tf, df, n, norm``, one after the other; a norm of 1 gives those before they are made unit ones."""
    tf, begins = _flat(vectors.column("tf"))
    df, _ = _flat(vectors.column("df"))
    n, norm = (np.repeat(vectors.column(c).to_numpy(), np.diff(begins)) for c in ("n", "norm"))
    return tf * (np.log((1 + n) / (1 + df)) + 1) / norm


def _vectors(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """``id, token, tf, df, n, norm``: the tf-idf vector of each row ``id, terms``, the rarest token first.

    copies is the column with the number of texts that a row stands for, one if None. Rows ask for the frequencies of their
    distinct tokens ASKING at a time, so that a token isn't sent for each row that has it.
    """
    own = F.col(copies) if copies else F.lit(1)
    n, texts = rows.agg(F.coalesce(F.sum(own), F.lit(0)), F.count("*")).first()
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(texts // ASKING + 1)).cast("int"))
    asked = rows.select(F.col("part").alias("to"), F.explode("terms.token").alias("token"), own.alias("texts")).groupBy("to", "token").agg(F.sum("texts").alias("texts"))
    answers = _given_back(asked.select("to", "token", F.sum("texts").over(Window.partitionBy("token")).cast("int").alias("df")))

    def answered(x: pa.Table, y: pa.Table) -> pa.Table:
        token, begins = _flat(x.column("token"))
        tf, _ = _flat(x.column("tf"))
        asked = y.column("token").to_numpy()
        order = np.argsort(asked)
        df = y.column("df").to_numpy()[order][np.searchsorted(asked[order], token)] if len(token) else np.empty(0, np.int32)
        order = np.lexsort((_ranked(df, token), np.repeat(np.arange(len(begins) - 1), np.diff(begins))))
        lists = {"token": token[order], "tf": tf[order], "df": df[order]}
        one = np.ones(len(begins) - 1)
        out = pa.table({"id": x.column("id"), **{c: _listed(begins, v) for c, v in lists.items()}, "n": pa.array(np.full(len(one), n, np.int64)), "norm": pa.array(one)})
        square = np.concatenate([[0.0], np.cumsum(_weights(out) ** 2)])
        return out.set_column(5, "norm", pa.array(np.sqrt(np.maximum(square[begins[1:]] - square[begins[:-1]], 0.0))))

    met = rows.select("part", "id", "terms.token", "terms.tf").where(F.size("token") > 0).groupBy("part").cogroup(answers.groupBy("to"))
    kind = rows.schema["id"].dataType.simpleString()
    out = _given_back(met.applyInArrow(answered, f"id {kind}, token array<bigint>, tf array<int>, df array<int>, n bigint, norm double"))
    _removed(answers)
    return out


def _classes(rows: DataFrame) -> DataFrame:
    least = rows.groupBy("key").agg(F.min("id").alias("class_id"))
    rows = rows.select("id", "key").join(least, "key")
    empty = F.col("key") == F.sha2(F.lit(""), 256)
    return rows.select("id", F.when(empty, F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def text_classes(texts: DataFrame) -> DataFrame:
    """``id, class_id`` of ``id, text``: texts with the same tokens are of one class, named by its least id."""
    return _classes(settled(_worded(texts).select("id", _key().alias("key"))))


#: What two prefixes must have in common of a cosine above the threshold; their rests give less than what is missing.
GAIN = 0.05
#: Meetings of two postings that are added up at once.
POSTINGS = 1 << 20
#: Prefixes of a block, and the least number of blocks; sums of pairs that are held at once.
PREFIXES, BLOCKS, SUMS = 16_384, 5, 1 << 20
#: Blocks that meet all others before what was sent for it is given back: more texts are more rounds, and not more disk a text.
ROUND = 2


def similar_texts(texts: DataFrame, threshold: float = DEFAULT.duplicate) -> tuple[DataFrame, DataFrame]:
    """Pairs ``id_a, id_b, similarity`` of classes with a tf-idf cosine above threshold, and ``id, class_id``."""
    rows = _keyed(texts)
    classes = settled(_classes(rows))
    heads = classes.where(F.col("id") == F.col("class_id")).select("id")
    own = _given_back(rows.join(heads, "id", "left_semi").select("id", "terms"))
    _removed(rows)
    vectors = _vectors(own)
    _removed(own)
    prefix = _given_back(_prefixes(vectors, threshold))
    pairs = _candidates(prefix, prefix, threshold)
    _removed(prefix)
    found = _given_back(_cosines(pairs, vectors).where(F.col("s") > threshold))
    _removed(vectors)
    return found.select("id_a", "id_b", rounded(F.col("s"), 3).alias("similarity")), classes


def _prefixes(vectors: DataFrame, threshold: float) -> DataFrame:
    """``id, rest, rank, weight``: the rarest tokens of each vector, down to a rest of threshold - GAIN, by their rank.

    With tokens in one order for all, no token behind the end of the shorter of two prefixes adds to
    the dot product more than that rest's length; so the prefixes themselves must give GAIN at least. Tokens that
    no other text has are left out; rest is the squared length of the vector without them.
    """
    least = max(0.0, threshold - GAIN) - 1e-9

    def cut(batches):
        for x in batches:
            x = pa.Table.from_batches([x])
            token, begins = _flat(x.column("token"))
            df, _ = _flat(x.column("df"))
            square = np.concatenate([[0.0], np.cumsum(_weights(x) ** 2)])
            owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            rest = square[begins[1:]][owner] - square[:-1]
            kept = (df > 1) & (rest >= least * least - 1e-9)
            first = begins[:-1] + np.bincount(owner[df == 1], minlength=len(begins) - 1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(begins) - 1))])
            weight = (np.sqrt(np.diff(square)) if len(token) else np.empty(0)).astype(np.float32)
            left = square[begins[1:]] - square[np.minimum(first, begins[1:])]
            yield pa.table({"id": x.column("id"), "rest": pa.array(left), "rank": _listed(ends, _ranked(df, token)[kept]), "weight": _listed(ends, weight[kept])}).to_batches()[0]

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(cut, f"id {kind}, rest double, rank array<bigint>, weight array<float>").where(F.size("rank") > 0)


class _Block:
    """Prefixes one after the other, with what of each is left behind a rank."""

    def __init__(self, rows: pa.Table):
        self.id, self.rest = rows.column("id").to_numpy(), rows.column("rest").to_numpy()
        self.rank, self.begins = _flat(rows.column("rank"))
        self.weight = _flat(rows.column("weight"))[0].astype(np.float64)
        self.owner = np.repeat(np.arange(len(self.id)), np.diff(self.begins))
        self.square = np.concatenate([[0.0], np.cumsum(self.weight**2)])

    def number(self, ranks: np.ndarray) -> None:
        """Ranks by their place among ranks, so that an owner and a rank make one number."""
        self.rank, self.ranks = np.searchsorted(ranks, self.rank), len(ranks)
        self.end = self.rank[self.begins[1:] - 1]
        self.places = self.owner * self.ranks + self.rank

    def left(self, k: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The squared lengths of what is behind the ranks in the k-th vectors."""
        at = np.searchsorted(self.places, k * self.ranks + rank, side="right")
        return np.maximum(self.rest[k] - (self.square[at] - self.square[self.begins[k]]), 0.0)


def _near(x: _Block, y: _Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of vectors whose prefixes allow a cosine of the threshold.

    All that two vectors share up to the end of the shorter prefix is in both prefixes; behind it they give no more than the product
    of the lengths of what is left there.
    """
    ranks = np.unique(np.concatenate([x.rank, y.rank]))
    x.number(ranks)
    y.number(ranks)
    order = np.argsort(y.rank, kind="stable")
    owner, weight = y.owner[order], y.weight[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(y.rank, minlength=len(ranks)))])
    begin, meets = starts[x.rank], np.diff(starts)[x.rank]
    least = threshold - max(0.0, threshold - GAIN) - 1e-5
    wide, per = len(y.id), max(1, SUMS // max(1, len(y.id)))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for a in range(0, len(x.id), per):
        z = min(a + per, len(x.id))
        sums = np.zeros((z - a) * wide)
        so_far = np.cumsum(meets[x.begins[a] : x.begins[z]])
        cuts = x.begins[a] + np.unique([0, *np.searchsorted(so_far, np.arange(POSTINGS, so_far[-1], POSTINGS)), len(so_far)])
        for p, q in zip(cuts[:-1], cuts[1:], strict=True):
            n = meets[p:q]
            at = np.repeat(begin[p:q] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs = np.repeat((x.owner[p:q] - a) * wide, n) + owner[at]
            sums += np.bincount(pairs, np.repeat(x.weight[p:q], n) * weight[at], len(sums))
        pairs = np.flatnonzero(sums >= least)
        i, j = pairs // wide + a, pairs % wide
        end = np.minimum(x.end[i], y.end[j])
        good = sums[pairs] + np.sqrt(x.left(i, end) * y.left(j, end)) >= threshold - 1e-5
        found.append((i[good], j[good]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``id_a, id_b`` of the vectors whose prefixes allow a cosine of the threshold.

    Any two prefixes meet in one task, a block of the one side and one of the other, and what a task gives are candidates only: pairs that share a
    token and are apart are never sent. A prefix is sent 2 * ROUND times in a round at most, and rounds give their shuffles back.
    """
    same = left is right
    kind = left.schema["id"].dataType.simpleString()
    blocks = lambda rows: max(BLOCKS, -(-rows.count() // PREFIXES))
    n_i = blocks(left)
    n_j = n_i if same else blocks(right)
    dealt = lambda rows, n, name: rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    left, right = dealt(left, n_i, "i"), dealt(right, n_j, "j")

    def meet(cell: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(x) and len(y):
            x, y = _Block(x), _Block(y)
            i, j = _near(x, y, threshold)
            a, b = x.id[i], y.id[j]
        if same:
            once = a < b if cell[0].as_py() == cell[1].as_py() else np.ones(len(a), bool)  # a block meets itself once
            a, b = np.minimum(a, b)[once], np.maximum(a, b)[once]
        else:
            a, b = a[a != b], b[a != b]
        return pa.table({"id_a": a, "id_b": b})

    found = []
    for first in range(0, n_i, ROUND):
        last = min(first + ROUND, n_i) - 1
        own = left.where(F.col("i").between(first, last)).withColumn("j", F.explode(F.sequence(F.col("i") if same else F.lit(0), F.lit(n_j - 1))))
        others = right.where(F.col("j") >= first) if same else right
        others = others.withColumn("i", F.explode(F.sequence(F.lit(first), F.least(F.col("j"), F.lit(last)) if same else F.lit(last))))
        found.append(_given_back(own.groupBy("i", "j").cogroup(others.groupBy("i", "j")).applyInArrow(meet, f"id_a {kind}, id_b {kind}")))
    return reduce(DataFrame.unionAll, found)


#: Vectors of one group that meet as many others in a task; vectors that a task is sent, or so.
GROUP, SENT = 2048, 1024


def _cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``id_a, id_b, s``: the dot products of these pairs of vectors.

    Pairs go where their first vector's least neighbour is, so that of vectors that are all near each other each is sent once, and not
    with every pair. Those of a large group meet block against block.
    """
    ids = F.explode(F.array("id_a", "id_b")).alias("id")
    labels = pairs.select(ids, F.least("id_a", "id_b").alias("least")).groupBy("id").agg(F.min("least").alias("label"))
    placed = _given_back(pairs.join(labels.select(F.col("id").alias("id_a"), "label"), "id_a"))
    sizes = _given_back(placed.select("label", ids).distinct().groupBy("label").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"), F.count("*").alias("n")))
    tasks = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("parts")), F.lit(0))).first()[0] // SENT + 1
    of = lambda c: F.pmod(F.xxhash64(c), "parts")
    placed = placed.join(sizes, "label").select("id_a", "id_b", F.pmod(F.xxhash64("label", of("id_a"), of("id_b")), F.lit(tasks)).cast("int").alias("task"))
    placed = _given_back(placed)
    sent = _given_back(placed.select(F.col("task").alias("to"), ids).distinct()).join(vectors, "id")

    def dots(x: pa.Table, y: pa.Table) -> pa.Table:
        names, (token, begins), w = y.column("id").to_numpy(), _flat(y.column("token")), _weights(y)
        order = np.argsort(names)
        a, b = (order[np.searchsorted(names[order], x.column(c).to_numpy())] for c in ("id_a", "id_b"))
        out = np.zeros(len(a))
        for k, (p, q) in enumerate(zip(a, b, strict=True)):
            p, q = slice(begins[p], begins[p + 1]), slice(begins[q], begins[q + 1])
            _, i, j = np.intersect1d(token[p], token[q], assume_unique=True, return_indices=True)
            out[k] = w[p][i] @ w[q][j]
        return pa.table({"id_a": x.column("id_a"), "id_b": x.column("id_b"), "s": out})

    kind = pairs.schema["id_a"].dataType.simpleString()
    met = placed.groupBy("task").cogroup(sent.groupBy("to"))
    return met.applyInArrow(dots, f"id_a {kind}, id_b {kind}, s double")


def rejected_before(questions: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """Questions that resemble rejected ones by tf-idf (``question_id, question_text, is_rejected, rejection_reason``).

    Rejected questions of the same words are a class, and so are current ones, named by the least id. Part pair has the
    ``rejected_class, current_class, similarity`` of similar ones: each question of the one resembles each of the other. Part
    member has the class of each question with a text. A text without words is a class by itself. Weights are those of all texts.
    """
    side = F.when(F.col("is_rejected"), "rejected").when(~F.col("is_rejected"), "current")
    docs = questions.where(F.col("question_text").isNotNull()).select(F.col("question_id").alias("id"), F.col("question_text").alias("text"), side.alias("side"), "rejection_reason")
    empty = F.col("key") == F.sha2(F.lit(""), 256)
    rows = _keyed(docs, ("side", "rejection_reason")).withColumn("key", F.when(empty, F.concat(F.lit("="), F.col("id").cast("string"))).otherwise(F.col("key")))
    heads = settled(rows.groupBy("key", "side").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("terms").alias("terms")))
    vectors = _vectors(heads, "copies")
    prefix = _given_back(_prefixes(vectors, c.rejected_duplicate).join(heads.select("id", "side"), "id"))
    pairs = _candidates(*(prefix.where(F.col("side") == name).drop("side") for name in ("rejected", "current")), c.rejected_duplicate)
    found = _cosines(pairs, vectors).where(F.col("s") > c.rejected_duplicate)
    found = found.select(F.lit("pair").alias("part"), F.col("id_a").alias("rejected_class"), F.col("id_b").alias("current_class"), rounded(F.col("s"), 3).alias("similarity"))
    members = rows.select("key", "side", F.col("id").alias("question_id"), "rejection_reason").join(heads.select("key", "side", "id"), ["key", "side"])
    of = lambda name: F.when(F.col("side") == name, F.col("id")).alias(f"{name}_class")
    reason = F.when(F.col("side") == "rejected", F.col("rejection_reason")).alias("rejected_reason")
    members = members.select(F.lit("member").alias("part"), of("rejected"), of("current"), "question_id", reason)
    return found.unionByName(members, allowMissingColumns=True)


#: Texts of either side that meet in one task.
TEXTS = 512


def _banded(texts: DataFrame, ratio: float, also_near: bool) -> DataFrame:
    """``text, band, block``: bands of lengths, whose bounds grow by ratio; also_near: in the bands beside the own one, too."""
    size = F.octet_length(F.encode("text", "UTF-8"))
    band = F.floor(F.log(F.greatest(size, F.lit(1))) / math.log(ratio)).cast("int")
    return texts.withColumn("band", F.explode(F.array(*(band + k for k in ((-1, 0, 1) if also_near else (0,))))))


def _dealt(texts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The texts of each band in blocks of TEXTS or so."""
    sizes = texts.groupBy("band").agg(F.ceil(F.count("*") / TEXTS).cast("int").alias(f"n_{name}"))
    return texts.join(sizes, "band").withColumn(name, F.pmod(F.xxhash64("text"), f"n_{name}").cast("int")), sizes


def similar_by_bytes(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``left_text, right_text, similarity`` of the texts (``text``, distinct, not null) at least so similar in percent.

    No more can match than the shorter text has, so lengths of a pair differ by a bounded ratio: texts meet those of their own and
    the neighbouring bands of lengths, a block of one side and a block of the other in a task, and nothing passes through the driver.
    """
    # 200 * shorter / (shorter + longer) >= least, with room for rounding and for letters whose cases differ in length
    ratio = (200 - (least - 1)) / (least - 1)
    plain = lambda t: t.select("text", F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " "))).alias("plain")).withColumnsRenamed({"text": "own", "plain": "text"})
    a, n_a = _dealt(_banded(plain(left), ratio, False), "i")
    b, n_b = _dealt(_banded(plain(right), ratio, True), "j")
    a = a.join(n_b, "band").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)))
    b = b.join(n_a, "band").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.column("own").to_pylist(), y.column("own").to_pylist()
        found = list(similar_among(x, y, least))
        columns = [[x[k] for k, _, _ in found], [y[m] for _, m, _ in found], [s for _, _, s in found]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["left_text", "right_text", "similarity"])

    keys = ["band", "i", "j"]
    met = a.select(*keys, "own").groupBy(*keys).cogroup(b.select(*keys, "own").groupBy(*keys))
    return met.applyInArrow(compare, "left_text string, right_text string, similarity double")


def rejected_similarity(questions: DataFrame, rejected: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """Questions that resemble rejected ones, by matching bytes in percent."""
    distinct = lambda rows, name: rows.where(F.col(name).isNotNull()).select(F.col(name).alias("text")).distinct()
    pairs = similar_by_bytes(distinct(questions, "question_text"), distinct(rejected, "rejected_text"), c.similar_row)
    pairs = pairs.withColumnsRenamed({"left_text": "question_text", "right_text": "rejected_text"})
    pairs = pairs.join(questions.select("question_id", "question_text"), "question_text")
    pairs = pairs.join(rejected.select("rejected_id", "rejected_text"), "rejected_text")
    alert = F.when(F.col("similarity") >= c.similar_alert, "high").otherwise("medium")
    return pairs.select("question_id", "rejected_id", "similarity", alert.alias("alert"))


def compare_two(texts: DataFrame, a: int, b: int, threshold: float = DEFAULT.duplicate) -> DataFrame:
    """Similarity of two texts under the weights of all; no row if one of them doesn't exist."""
    docs = texts.select("id", tokens(F.col("text"), 2, STOP_WORDS).alias("tokens"))
    weights = tfidf(docs)
    x, y = (weights.where(F.col("id") == v).select("token", F.col("weight").alias(n)) for v, n in ((a, "wa"), (b, "wb")))
    dot = x.join(y, "token").agg(F.coalesce(F.sum(F.col("wa") * F.col("wb")), F.lit(0.0)).alias("s"))
    there = texts.where(F.col("id").isin(a, b)).agg(F.countDistinct("id").alias("n"))
    out = dot.crossJoin(there).where(F.col("n") == len({a, b}))  # one row each
    return out.select(rounded(F.col("s"), 3).alias("similarity"), (F.col("s") > threshold).alias("is_potential_duplicate"))


def text_pair_similarity(pairs: DataFrame, threshold: float = DEFAULT.duplicate) -> DataFrame:
    """Cosine of the vectors of two texts (``text1, text2, v1, v2``); 0 if either text is blank."""
    blank = (F.trim(F.coalesce("text1", F.lit(""))) == "") | (F.trim(F.coalesce("text2", F.lit(""))) == "")
    value = F.when(blank, 0.0).otherwise(F.coalesce(cosine(F.col("v1"), F.col("v2")), F.lit(0.0)))
    return pairs.withColumn("similarity", value).withColumn("is_duplicate", F.col("similarity") > threshold)


def with_previews(pairs: DataFrame, texts: DataFrame, n: int = 100) -> DataFrame:
    short = texts.select("id", preview(F.col("text"), n).alias("p"))
    out = pairs.join(short.select(F.col("id").alias("id_a"), F.col("p").alias("text_a")), "id_a", "left")
    return out.join(short.select(F.col("id").alias("id_b"), F.col("p").alias("text_b")), "id_b", "left")
