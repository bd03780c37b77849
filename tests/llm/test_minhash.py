import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemlab.llm import components, minhash
from itemlab.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, n_shingles string"


def brute(rows, percent):
    sets = {d: set(minhash.shingles(t).tolist()) for d, t in rows}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edited(rng, words, edits):
    words = list(words)
    for k in rng.choice(len(words), edits, replace=False):
        words[k] = f"w{rng.integers(1e9)}"
    return " ".join(words)


def corpus():
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in rng.integers(0, 400, 150)]
    rows = [(k, edited(rng, base, int(rng.integers(0, 6)))) for k in range(120)]
    rows += [(k, " ".join(f"x{v}" for v in rng.integers(0, 300, 60))) for k in range(120, 160)]
    rows += [(k, rows[125][1].upper()) for k in range(160, 170)]
    return rows


def test_against_all_pairs(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en", "clash") for d, t in rows], SCHEMA)
    for percent in (80, 85):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, percent).collect()}
        assert got == brute(rows, percent)


def test_blocks_meet_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en", "clash") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 85).collect()}
    assert got == brute(rows, 85)


def test_edges_of_input(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "word " * 50_000),
            (7, "word " * 50_000), (None, "a b"), (8, "\xa0 a b")]
    df = spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)
    got = sorted((tuple(r)[:4] for r in minhash.near_duplicates(df, 85).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
         (7, 1, 7, True), (7, 1, 7, True), (None, 1, None, True), (8, 1, 8, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    a, b = minhash.permutations(2000)
    x, y = np.arange(1000), np.arange(200, 1200)
    x, y = (minhash.mix(v.astype(np.uint64)) for v in (x, y))
    agree = minhash.min_max_signature(x, a, b) == minhash.min_max_signature(y, a, b)
    assert np.abs(agree.mean(0) - 800 / 1200).max() < 0.05


@pytest.mark.parametrize("heavy", [100, 1])
def test_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(components, "HEAVY", heavy)
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (5, 5), (None, 3)]
    hub = [(500, k) for k in range(600, 800)] + [(900, k) for k in range(601, 800, 2)]
    with Scratch(spark) as scratch:
        edges = spark.createDataFrame(chain + hub, "u long, v long")
        got = dict(components.connected_components(edges, scratch).collect())
        assert components.connected_components(edges.limit(0), scratch, "none").count() == 0
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 103: 100} | {k: 500 for k in [500, 900, *range(600, 800)]}


def test_whole_table(spark):
    """All pairs of the distinct texts that share a shingle, by sets of words themselves rather than of hashes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    sets, holders = {}, {}
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[r.doc_id]:
            holders.setdefault(s, []).append(r.doc_id)
    pairs = {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op1_minhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def test_two_texts_of_one_doc_id(spark):
    """A text keeps its links though another text has its doc_id, in any order of rows; so do copies of that."""
    words = [f"w{k}" for k in range(200)]
    a, b = " ".join(words), " ".join(f"v{k}" for k in range(200))
    rows = [(1, a), (2, b), (2, a + " more"), (3, b + " more"), (4, "short text"), (4, a + " other"), (2, b)]
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), percent=85)
        hashes = {r.h: r.text for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
        found = sorted((r.doc_id, hashes[r.text_hash], r.component_id, r.kept) for r in got.collect())
        assert found == sorted([(1, a, 1, True), (2, a + " more", 1, False), (4, a + " other", 1, False), (2, b, 2, True), (2, b, 2, True), (3, b + " more", 2, False), (4, "short text", 4, True)])


def test_large_keys_are_broadcast(spark, monkeypatch):
    """With hardly any key small enough to be joined by shuffle the links are the same."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k:]])) for k in range(60)] + [(100 + k, " ".join(rng.choices(base, k=80))) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    for name, value in (("BLOCK", 8), ("LARGE_KEYS", 10**9)):
        monkeypatch.setattr(minhash, name, value)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == plain
    assert {r[2] for r in plain if r[0] < 60} == {0}
