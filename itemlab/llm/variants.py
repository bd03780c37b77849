"""Spelling variants: words that differ by one character, found by walking tries that are tables.

Two words that differ by one insertion, deletion or replacement share the first half of the longer
one, or its second half. So there are two tries, of the words and of the reversed words, whose roots are
halves: only what follows the half is walked, with one edit left. A trie's edges are a table, chains
without branches being one edge; states (word, position, node, edits) are joined with it level by
level. A state that ends where a word ends, with one edit, has found a neighbour.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, resident, small_batches, stored, table

#: Letters A-Z lower-cased, a-z and U+00C0 to U+00FF kept, all else a space, over Latin-1: words are what is between spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: One occurrence in so many, by a hash, has a letter deleted.
DELETED = 31
#: Code points of a text that are split at once, and different words of a task before it gives them out.
SLICE, HELD = 1 << 20, 1 << 20
#: A word's form is so many times as frequent as the word.
RATIO = 10


def words_of(text: str):
    """Lists of the lower-cased words of a text, in Latin-1, a slice at a time."""
    begin = 0
    rest = b""
    while begin < len(text):
        data = rest + text[begin : begin + SLICE].encode("latin-1", "replace").translate(_LETTERS)
        begin += SLICE
        cut = len(data) if begin >= len(text) else data.rfind(b" ") + 1
        rest = data[cut:]
        yield data[:cut].split()


def with_deletion(word: bytes, key: int) -> bytes:
    """The word, without one of its letters where its hash says so; key is the CRC of what precedes it in the hash."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), key)
    if h % DELETED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(batches):
    resident("variants", lambda: None)
    held: Counter = Counter()

    def given():
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        out = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
            key = zlib.crc32(b":", key)
            found: Counter = Counter()
            for words in words_of(text or ""):
                found.update(words)
            for word, n in found.items():
                held[with_deletion(word, key)] += n
            if len(held) >= HELD:
                yield given()
    if held:
        yield given()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words of docs (``doc_id, text``), deletions made."""
    text = F.make_valid_utf8(F.col("text").cast("string")).alias("text")
    counts = docs.select("doc_id", text).mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def shared_length(a: str, b: str) -> int:
    """Characters that a and b begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def trie_edges(rows):
    """``root, piece, s, a, b, ends`` of the tries over rows ``root, half, s``, which are sorted and distinct.

    An edge leads from the node of s[:a] to that of s[:b]; ends tells that the latter is one of the strings.
    Chains without branches are one edge. A root's rows in one partition are a piece with nodes of its own, named by its
    first string; the edge from None to half leads into it. Only the path to the last string is held.
    """
    path, last, root, piece, half = [], "", None, "", 0

    def closed(keep: int):
        while path[-1][0] > keep:
            low, ends = path.pop()
            if path[-1][0] < keep:
                path.append((keep, False))
            yield root, piece, last, path[-1][0], low, ends

    for row_root, row_half, s in rows:
        if row_root == root:
            yield from closed(shared_length(last, s))
        else:
            if root is not None:
                yield from closed(half)
            root, half, piece = row_root, row_half, s
            yield root, piece, s, None, half, False
            path = [(half, False)]
        path.append((len(s), True))
        last = s
    if root is not None:
        yield from closed(half)


def _ids(strings: list) -> pa.Array:
    """Spark's xxhash64 of strings, null for None."""
    ids = np.fromiter((xxhash.xxh64_intdigest(s or "", 42) for s in strings), np.uint64, len(strings)).view(np.int64)
    return pa.array(ids, mask=np.array([s is None for s in strings], bool))


def _edges(batches):
    def given(nodes, labels, ends, words):
        columns = [_ids(nodes), pa.array(labels, pa.string()), _ids(ends), pa.array(words, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["node", "label", "to", "word"])

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    out = ([], [], [], [])
    for root, piece, s, a, b, ends in trie_edges(rows):
        way = f"{root} {piece} "
        out[0].append(root if a is None else way + s[:a])
        out[1].append("" if a is None else s[a:b])
        out[2].append(None if ends and b == len(s) else way + s[:b])  # nothing is below a leaf
        out[3].append(s[:b] if ends else None)
        if len(out[0]) >= 10_000:
            yield given(*out)
            out = ([], [], [], [])
    if out[0]:
        yield given(*out)


#: Ways to read a word, and how many of a word's characters a root has: of the word's first half, or of its last from the end.
_WAYS = {"f": 0, "r": 1}


def _ways(words: DataFrame) -> DataFrame:
    """``word, way, s``: the word forwards and backwards."""
    ways = F.array(*(F.struct(F.lit(w).alias("way"), (F.reverse("word") if w == "r" else F.col("word")).alias("s")) for w in _WAYS))
    return words.select("word", F.inline(ways))


def _half(length) -> F.Column:
    return F.floor((length + F.when(F.col("way") == "r", _WAYS["r"]).otherwise(_WAYS["f"])) / 2).cast("int")


def _root(half) -> F.Column:
    return F.concat("way", half.cast("string"), F.lit(":"), F.substring(F.col("s"), F.lit(1), half))


def trie(words: DataFrame) -> DataFrame:
    """``node, children`` of the tries of words (``word``, distinct): their edges ``label, to, word``.

    A word is below the roots of words as long as it, and of those longer by one. Words are dealt by range, so a
    root of very many of them is several pieces.
    """
    n = F.length("s")
    halves = F.array_distinct(F.array(_half(n), _half(n + 1)))
    rows = _ways(words).withColumn("half", F.explode(halves)).select(_root(F.col("half")).alias("root"), "half", "s")
    rows = rows.repartitionByRange("root", "s").sortWithinPartitions("root", "s")
    edges = rows.mapInArrow(_edges, "node long, label string, to long, word string")
    return edges.groupBy("node").agg(F.collect_list(F.struct("label", "to", "word")).alias("children"))


def _step(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """States ``word, s, way, pos, node, edits`` one edge on; node is null at leaves, found is the string that ends there with one edit."""
    moved = states.join(nodes, "node").select("s", "way", "pos", "edits", F.inline("children"))
    m, pos = F.length("label"), F.col("pos")
    near = lambda n: (F.length(F.substring(F.col("s"), pos + 1, n)) == n) & (F.levenshtein(F.substring(F.col("s"), pos + 1, n), "label", 1) == 1)
    exact = F.substring(F.col("s"), pos + 1, m) == F.col("label")
    to = lambda n, edits: F.struct((pos + n).alias("pos"), edits.cast("int").alias("edits"))
    # replaced: as many characters of the word as of the label; deleted: one more
    edited = F.filter(F.array(F.when(near(m), to(m, F.lit(1))), F.when(near(m + 1), to(m + 1, F.lit(1)))), lambda x: x.isNotNull())
    after = F.when(exact, F.array(to(m, F.col("edits")))).when(F.col("edits") == 0, edited)
    moved = moved.select("s", "way", F.col("to").alias("node"), F.col("word").alias("end"), F.inline(after))
    left = F.length("s") - F.col("pos")
    found = F.when(F.col("end").isNotNull() & (left == 1 - F.col("edits")), F.col("end"))
    return moved.select("s", "way", "pos", "node", "edits", found.alias("found")).where((F.col("node").isNotNull() & (left >= 0)) | F.col("found").isNotNull())


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, near`` for the pairs of words (``word``, distinct, two characters or more) that differ by one character.

    A word looks for those as long as it and those shorter by one; longer ones are pairs seen from the other side.
    """
    nodes = scratch.store(trie(words), "variants-trie")
    half = _half(F.length("s"))
    states = _ways(words).select("s", "way", half.alias("pos"), F.xxhash64(_root(half)).alias("node"), F.lit(0).alias("edits"))
    pairs, level = None, 0
    while True:
        now = scratch.store(_step(states, nodes), f"variants-level-{level}")
        hits = now.where(F.col("found").isNotNull()).select("way", "s", "found")
        pairs = hits if pairs is None else pairs.unionByName(hits)
        states = now.where(F.col("node").isNotNull()).drop("found")
        if states.isEmpty():
            break
        level += 1
    word = lambda c: F.when(F.col("way") == "r", F.reverse(c)).otherwise(F.col(c))
    pairs = pairs.select(word("s").alias("word"), word("found").alias("near"))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of docs (``doc_id, text``).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least least_length
    characters and least_count occurrences; one occurrence in DELETED, by a hash of doc_id and word, has a letter
    deleted. Near words differ by one character. A word's form is its most frequent near word (of several
    the first in code-point order), if that is ratio times as frequent; its root is where forms lead to in the end.

    * Null and empty texts have no words; a null doc_id counts as empty. Rows that repeat count each.
    * Words without near words have n_near 0, form and form_n null, and are their own root.
    * Other columns are ignored; an empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        words = word_counts(docs).where((F.length("word") >= least_length) & (F.col("n") >= least_count))
        words = scratch.store(words, "variants-words")
        pairs = near_words(words.select("word"), scratch)
        pairs = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best")
        near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
        out = words.join(near, "word", "left")
        is_form = -F.col("best.n") >= ratio * F.col("n")
        out = out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
        out = scratch.store(out, "variants-forms")
        # forms are ten times as frequent, so chains are short, and each round doubles what a step spans
        roots, turn = scratch.store(out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "variants-roots-0"), 0
        while True:
            on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            further = scratch.store(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"variants-roots-{turn + 1}")
            roots, turn = further.drop("moved"), turn + 1
            if further.where("moved").isEmpty():
                break
        out = out.join(roots, "word", "left")
        return stored(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants-result")


def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    small_batches(spark)
    return spelling_variants(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS crcs FROM range(256) t(i)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL
), counted AS (SELECT doc, run, hex(encode(doc || ':' || run)) AS bytes, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(length(bytes) // 2), lambda k: ('0x' || substr(bytes, 2 * k + 1, 2))::BIGINT),
    lambda c, b: xor(c // 256, crcs[(xor(c, b) % 256) + 1]))) AS h FROM counted, crc
), changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM changed GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2
), cut AS (SELECT word, n, k, left(word, k - 1) AS before, substr(word, k + 1) AS after FROM words, range(1, 100) t(k) WHERE k <= length(word)
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.k = b.k AND a.before = b.before AND a.after = b.after AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.before || c.after
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.before || c.after
), best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), steps AS (
  SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN roots r ON f.word = r.word
"""
