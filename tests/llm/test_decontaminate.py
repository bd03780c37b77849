import random

import numpy as np
import pytest

from itemlab.llm import decontaminate as dc


def brute_align(a, b):
    h = np.zeros((len(b) + 1, len(a) + 1), int)
    for i, x in enumerate(b, 1):
        for j, y in enumerate(a, 1):
            d = h[i - 1, j - 1] + (dc.MATCH if x == y else dc.MISMATCH)
            h[i, j] = max(0, d, h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(1, 12))
        score, first, last = dc.align(a, b)
        assert score == brute_align(a, b)
        if score:
            assert brute_align(a[first : last + 1], b) == score


def words(rng, n, tag=""):
    return [f"{tag}{rng.randint(0, 5000)}" for _ in range(n)]


def planted():
    rng = random.Random(3)
    items = [(k, " ".join(words(rng, 30, "q"))) for k in range(10)] + [(10, None), (11, ""), (12, "the of")]
    docs, want = [], set()
    for k in range(120):
        text = [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"d{rng.randint(0, 3000)}" for _ in range(200)]
        if k % 3 == 0:
            item = k % 7
            copy = items[item][1].split()
            for edit in rng.sample(range(30), rng.choice([0, 3, 5])):
                copy[edit] = "changed"
            if k % 2:
                del copy[12]
            text[100:100] = copy
            want.add((k, item))
        docs.append((k, " ".join(text).title() + ".", "clash"))
    docs += [(500, None, ""), (501, "", ""), (502, "word " * 100_000, ""), (None, items[1][1], ""), (503, items[9][1], ""),
             (503, items[9][1], "")]
    return items, docs, want | {(None, 1), (503, 9)}


@pytest.mark.parametrize("block", [100, 20_000_000])
def test_planted_copies(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_CHARS", block)
    items, docs, want = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    got = dc.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(got) == len(want) + 1  # the repeated row
    exact = next(r for r in got if r.doc_id == 503)
    assert (exact.score, exact.first_word, exact.last_word) == (1.0, 0, 29)


def test_seeds_and_all_pairs_agree(spark):
    """Every pair that aligns well anywhere is found by its seeds."""
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in dc.op7_decontamination(spark, sf).collect()}
    want = set()
    for d in docs:
        a = dc.tokens(d.text)
        if len(a) > 1500:
            continue
        for item in items:
            b = dc.tokens(item.text)
            if dc.align(a, b)[0] >= dc.THRESHOLD * dc.MATCH * len(b):
                want.add((d.doc_id, item.item_id))
    small = {d.doc_id for d in docs if len(dc.tokens(d.text)) <= 1500}
    assert {p for p in got if p[0] in small} == want


def test_empty_tables(spark):
    items, docs, _ = planted()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.contaminated(df.limit(0), bench).count() == 0
    assert dc.contaminated(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [21, 3000])
@pytest.mark.parametrize("intact", [0, 100])
def test_shared_edited_copies(spark, copies, intact):
    """One edited copy that many documents share: fewer than half of its item's seeds are left, all of them frequent."""
    rng = random.Random(5)
    item = words(rng, 50, "q")
    edited = [f"e{k}" if k % 5 == 4 else w for k, w in enumerate(item)]
    around = lambda k: " ".join(words(rng, 8, f"d{k}x"))
    docs = [(k, f"{around(k)} {' '.join(edited if k < copies else item)} {around(k)}") for k in range(copies + intact)]
    docs += [(9000 + k, around(k)) for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dc.contaminated(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(copies + intact))


def test_items_of_few_words():
    """Items that repeat their words: digit strings, tables, refrains."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("0123456789") for _ in range(100)), "la la la di da " * 12, "yes no " * 20, " ".join(words(rng, 30))]
    items = dc.Items(list(range(4)), texts)
    for k, text in enumerate(texts):
        match = next(m for m in items.matches(f"before this {text} and after", 0.5) if m["item_id"] == k)
        n = len(dc.tokens(text))
        assert (match["score"], match["first_word"], match["last_word"]) == (1.0, 2, n + 1)


def test_bound_holds():
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 9, rng.integers(3, 25)))) for _ in range(50)]
    items = dc.Items(list(range(50)), texts)
    for _ in range(20):
        a = dc.tokens(" ".join(map(str, rng.integers(0, 12, 15))))
        most = items.in_common(a, np.arange(50))
        assert most.tolist() == [int(np.isin(b, a).sum()) for b in items.words]
        assert all(dc.align(a, b)[0] <= dc.MATCH * m for b, m in zip(items.words, most, strict=True))


def test_items_of_repeated_words():
    items = dc.Items([1, 2], ["ha " * 10, "a b c " * 8])
    for k, text in ((1, "ha " * 10), (2, "a b c " * 8)):
        found = items.matches(f"x y z {text} q", 0.5)
        assert [(m["item_id"], m["score"], m["first_word"]) for m in found] == [(k, 1.0, 3)]
    assert not items.matches("ha ha ha b", 0.5)


def test_scripts_without_spaces():
    item = "富士山は日本で一番高い山であり、多くの人が毎年登ります"
    items = dc.Items([7], [item])
    assert len(items.words[0]) > 20
    edited = item.replace("毎年", "夏に")
    assert [m["item_id"] for m in items.matches(f"前書き。{edited}。後書き", 0.5)] == [7]
    assert not items.matches("まったく別の文章がここにあります", 0.5)


def test_many_items():
    """Tens of thousands of items, of which one is copied with edits."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 20_000, (30_000, 30))
    items = dc.Items(list(range(30_000)), [" ".join(f"w{x}" for x in row) for row in words])
    copy = [f"w{x}" for x in words[12_345]]
    copy[7], copy[20] = "other", "words"
    noise = [f"w{x}" for x in rng.integers(0, 20_000, 2000)]
    assert [m["item_id"] for m in items.matches(" ".join(noise + copy + noise), 0.5)] == [12_345]
