"""Quality rules with a suffix array of words: repetition inside a text.

The suffixes of the texts of a chunk are sorted by prefix doubling; only those whose first words
still have an equal are sorted on, so ordinary prose is done after a few rounds. The intervals of
the longest-common-prefix array are the repeated substrings of a text; those that can't be extended
to either side are maximal. The union of their spans gives the covered fraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_words, mix, small_batches, table, valid

#: Words of the shortest repeat that counts.
WINDOW = 8
#: A text is kept if repeats cover at most so many percent of its words' characters ...
MAX_COVERED = 25
#: ... and none is longer than so many words.
MAX_REPEAT = 50
#: Words that are sorted at once; a longer text is sorted alone.
CHUNK = 400_000

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_maximal_repeats long, covered_chars long, longest_repeat long"
)


def suffix_levels(key: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, and the suffix array.

    Equal ranks mean equal beginnings; keys of different texts must differ.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    active, rank = order, np.zeros(n + 1, np.int64)
    rank[n] = -1
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, length = [rank.astype(np.int32)], 1
    while True:
        sizes = np.bincount(rank[active], minlength=n)
        active = active[sizes[rank[active]] > 1]
        if not len(active):
            break
        first = rank[active]
        follow = rank[np.minimum(active + length, n)] + 1
        order = np.lexsort((follow, first))
        active, first, follow = active[order], first[order], follow[order]
        at = np.arange(len(active))
        group = np.ones(len(active), bool)
        group[1:] = first[1:] != first[:-1]
        new = group.copy()
        new[1:] |= follow[1:] != follow[:-1]
        begin = np.maximum.accumulate(np.where(group, at, 0))
        rank[active] = first + np.maximum.accumulate(np.where(new, at, 0)) - begin
        length *= 2
        levels.append(rank.astype(np.int32))
    array = np.empty(n, np.int64)
    array[rank[:n]] = np.arange(n)
    return levels, array


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b begin with in common."""
    n = len(levels[0]) - 1
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + out, n)] == levels[k][np.minimum(b + out, n)]
        out += same.astype(np.int64) << k
    return out


def lcp_intervals(lcp: list[int], left: list[int]):
    """Intervals (first, last, length, maximal) of the suffix array whose suffixes share length words, and not more.

    lcp[k] belongs to suffixes k and k + 1, left[k] is the word before suffix k; only intervals of
    positive length are given. maximal: the words before the suffixes differ, so that their common
    words can't be extended to the left either. Takes linear time, as an interval's words to the left
    are merged from those of its parts.
    """
    stack: list[list] = []  # length, first, the one word to the left or None
    for k, value in enumerate([*lcp, 0]):
        first, word = k, left[k]
        while stack and stack[-1][0] > value:
            length, first, own = stack.pop()
            word = own if own == word else None
            yield first, k, length, word is None
        if stack and stack[-1][0] == value:
            stack[-1][2] = word if word == stack[-1][2] else None
        elif value:
            stack.append([value, first, word])


def repeats(key: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that begin with a repeat of window words or more, its greatest length, and one place of each maximal repeat."""
    none = np.empty(0, np.int64)
    if len(key) < 2:
        return none, none, none
    levels, array = suffix_levels(key)
    # Neighbours that share their first words up to the greatest power of two within the window come into question.
    level = levels[min(window.bit_length() - 1, len(levels) - 1)]
    near = np.flatnonzero(level[array[1:]] == level[array[:-1]])
    lcp = np.zeros(len(key) - 1, np.int64)
    lcp[near] = common_prefixes(levels, array[near], array[near + 1])
    lcp[lcp < window] = 0
    hot = np.flatnonzero(lcp)
    if not len(hot):
        return none, none, none
    longest = np.maximum(np.append(lcp, 0), np.insert(lcp, 0, 0))
    begins = np.flatnonzero(longest)
    before = np.insert(key, 0, 0)  # the word before each suffix
    places = []
    for part in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
        run = array[part[0] : part[-1] + 2]
        found = lcp_intervals(lcp[part].tolist(), before[run].tolist())
        places += [run[first] for first, _, _, maximal in found if maximal]
    return array[begins], longest[begins], np.array(places, np.int64)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each of n words whether one of the spans covers it."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def _surface(text: str) -> tuple[list[bytes], int, int, int]:
    """Words, code points in them, symbols, and lines equal to an earlier one."""
    raw = text.encode("utf-8", "surrogatepass")
    blanks = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return raw.split(), len(text) - blanks, symbols, len(lines) - len(set(lines))


def measure(texts: list[str | None]) -> np.ndarray:
    """(texts, 8): the columns of SCHEMA after doc_id."""
    out = np.zeros((len(texts), 8), np.int64)
    begin = 0
    while begin < len(texts):
        words, n, end = [], 0, begin
        while end < len(texts) and (end == begin or n < CHUNK):
            own, *rest = _surface(texts[end] or "")
            out[end, :4] = len(own), *rest
            words += own
            n += len(own)
            end += 1
        sizes = out[begin:end, 0]
        doc = np.repeat(np.arange(begin, end), sizes)
        key = mix(hash_words(words) + mix(doc.astype(np.uint64)))
        starts, lengths, places = repeats(key)
        if len(starts):
            at = covered(n, starts, lengths)
            # Windows found twice or more lie in a repeat, and a repeat consists of such windows.
            out[begin:end, 4] = np.bincount(doc[at] - begin, minlength=end - begin)
            np.add.at(out[:, 5], doc[places], 1)
            chars = [len(words[k].decode("utf-8", "surrogatepass")) for k in np.flatnonzero(at)]
            out[begin:end, 6] = np.bincount(doc[at] - begin, chars, end - begin).astype(np.int64)
            np.maximum.at(out[:, 7], doc[starts], lengths)
        begin = end
    return out


def quality_rules(docs: DataFrame, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The columns of SCHEMA with ``base_failed`` and ``kept`` for each row of docs (``doc_id, text``).

    base_failed: under 20 words, or over 30 percent of them in windows of WINDOW words found twice or
    more. kept: not base_failed, at most max_covered percent of the words' characters in maximal repeats
    (the union of their spans), none of which is longer than max_repeat words. A null or empty text has no words and fails. Repeated rows
    and null doc_ids are measured like any other; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = measure(batch.column(1).to_pylist())
            arrays = [batch.column(0), *(pa.array(c) for c in rows.T)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(",")])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text"))
    out = docs.mapInArrow(run, SCHEMA)
    words = F.col("n_words")
    failed = (words < 20) | (100 * F.col("n_repeat_words") > 30 * words)
    fine = (100 * F.col("covered_chars") <= max_covered * F.col("word_chars")) & (F.col("longest_repeat") <= max_repeat)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules(table(spark, sf_dir, "documents"))
