import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from itemlab.llm import variants
from itemlab.llm.common import Scratch

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def pairs_of(spark, words):
    with Scratch(spark) as scratch:
        return sorted(tuple(r) for r in variants.near_words(spark.createDataFrame([(w,) for w in words], "word string").repartition(3), scratch).collect())


@pytest.mark.parametrize("alphabet,lengths,n", [("ab", (7, 11), 250), ("aà÷ÿ", (7, 9), 300), ("a", (7, 40), 30), ("abcdefg", (7, 8), 400)])
def test_pairs_against_all_pairs(spark, alphabet, lengths, n):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths))) for _ in range(n)}
    words |= {w + w[-1] for w in list(words)[:20]} | {w[1:] for w in list(words)[:20] if len(w) > 7} | {w[:3] + w[4:] for w in list(words)[20:40] if len(w) > 7}
    assert pairs_of(spark, words) == sorted((a, b) for a in words for b in words if near(a, b))


def test_very_long_words(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abc") for _ in range(20_000))
    words = [long, long[:9_000] + long[9_001:], long + "a", long[:5] + "z" + long[6:], long[:100] + "zz" + long[102:]]
    assert pairs_of(spark, words) == sorted((a, b) for a in words for b in words if near(a, b))


def test_tries_of_ranges_are_pieces(spark):
    """A root whose words are in many partitions gives the pairs of one in a single partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        words = ["aaa" + "".join(x) for x in __import__("itertools").product("abc", repeat=4)]
        assert pairs_of(spark, words) == sorted((a, b) for a in words for b in words if near(a, b))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_deletions():
    def plain(doc, word):
        h = zlib.crc32(f"{doc}:{word}".encode())
        return word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word

    for doc in (0, 17, 123456789):
        key = zlib.crc32(b":", zlib.crc32(str(doc).encode()))
        for word in [f"wört{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]:
            assert variants.with_deletion(word.encode("latin-1"), key).decode("latin-1") == plain(doc, word)


def test_words_across_slices(monkeypatch):
    text = "Ab cdé÷fg 日本 x_y ÀÿZ" * 5
    want = [w for ws in variants.words_of(text) for w in ws]
    monkeypatch.setattr(variants, "SLICE", 3)
    assert [w for ws in variants.words_of(text) for w in ws] == want and "cdé÷fg".encode("latin-1") in want and b"y" in want


def test_forms_roots_and_edges(spark):
    counts = {"printing": 300, "printin": 25, "prinin": 2, "printinn": 2, "prantin": 2, "alonealone": 3, "shorty": 90, "oncehere": 1}
    rows = [(3, f"{w} " * n, "mine", 1) for w, n in counts.items()]
    rows += [(4, None, "mine", 1), (5, "", "mine", 1), (None, "12 _ 日本", "mine", 1), (6, "x" * 300_000 + " " + "x" * 300_000, "mine", 1)]
    kept = [r for r in rows if r[1]]  # no deletion hits these words
    assert all(zlib.crc32(f"3:{w}".encode()) % 31 for w in counts)
    got = {r.word: r for r in variants.spelling_variants(spark.createDataFrame(kept + rows[8:10], SCHEMA)).collect()}
    assert set(got) == {"printing", "printin", "printinn", "prantin", "alonealone", "x" * 300_000}
    assert (got["printin"].form, got["printin"].form_n, got["printin"].n_near, got["printin"].root) == ("printing", 300, 3, "printing")
    assert (got["prantin"].form, got["prantin"].root) == ("printin", "printing")  # over two steps
    assert got["printinn"].form == "printing" and got["printing"].form is None and got["printing"].root == "printing"
    assert (got["alonealone"].n_near, got["alonealone"].form, got["alonealone"].form_n) == (0, None, None)


def test_ties_and_repeated_rows(spark):
    rows = [(1, "aaaaaaab " * 20 + "aaaaaaac " * 20 + "aaaaaaa " * 2, "m", 1)]
    out = variants.spelling_variants(spark.createDataFrame(rows, SCHEMA)).where(F.length("word") == 7).first()
    assert out is None or out.form == "aaaaaaab"
    twice = {r.word: r.n for r in variants.spelling_variants(spark.createDataFrame([(1, "printing", "m", 1)] * 2, SCHEMA)).collect()}
    assert sum(twice.values()) == 2


def test_empty_table(spark):
    assert variants.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, "a b c", "m", 1)], SCHEMA)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    key = lambda r: r[0]
    got = sorted((tuple(r) for r in variants.op12_spelling_variants(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=key)
    assert got == sorted(db.execute(variants.OP12_SQL).fetchall(), key=key)
