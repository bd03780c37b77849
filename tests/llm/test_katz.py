import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemlab.llm import katz


def brute(rows, held, order):
    """Scores by the definition, with dictionaries; also P(w | h) as a function."""
    split = [(d, [*(t or "").encode().lower().split(), 0]) for d, t in rows]
    train = [w for (d, w), out in zip(split, held, strict=True) if not out]
    grams = [Counter() for _ in range(order + 1)]
    for w in train:
        padded = [1] * (order - 1) + w
        for i in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                grams[k][tuple(padded[i - k + 1 : i + 1])] += 1
    d = [None] + [katz.discounts([sum(v == r for v in c.values()) for r in range(katz.K + 2)]) for c in grams[1:]]
    total, distinct = sum(grams[1].values()), len(grams[1])
    first = {g[0]: d[1][min(c, katz.K + 1)] * c / total for g, c in grams[1].items()}
    unseen = 1 - sum(first.values())
    after = [None, None] + [defaultdict(dict) for _ in range(2, order + 1)]
    for k in range(2, order + 1):
        context = Counter()
        for g, c in grams[k].items():
            context[g[:-1]] += c
        for g, c in grams[k].items():
            after[k][g[:-1]][g[-1]] = d[k][min(c, katz.K + 1)] * c / (context[g[:-1]] + katz.RESERVE)
    weight = {}

    def p(w, h):
        if not h:
            return first.get(w, unseen)
        seen = after[len(h) + 1].get(h)
        if seen is None:
            return p(w, h[1:])
        if w in seen:
            return seen[w]
        if h not in weight:
            weight[h] = (1 - sum(seen.values())) / (1 - sum(p(x, h[1:]) for x in seen))
        return weight[h] * p(w, h[1:])

    out = []
    for (i, w), h in zip(split, held, strict=True):
        base = sum(math.log10((grams[1][x,] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        padded = [1] * (order - 1) + w
        score = sum(math.log10(p(padded[j], tuple(padded[j - order + 1 : j]))) for j in range(order - 1, len(padded)))
        out.append((i, h, len(w), sum((x,) in grams[1] for x in w), total, base, score))
    return out, p, [g[0] for g in grams[1]], after


def corpus(n=120):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(460)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for k in range(n)]
    return rows + [(900, None), (901, ""), (None, "W0 w1"), (5, "w0 new words here"), (5, "w0 new words here")]


def held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0


@pytest.mark.parametrize("block, order", [(50, 2), (50, 3), (2_000_000, 1), (2_000_000, 4)])
def test_against_dictionaries(spark, monkeypatch, block, order):
    monkeypatch.setattr(katz, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = katz.score_documents(df, katz.crc_mod(10) == 0, order).collect()
    want = brute(rows, [held_out(d) for d, _ in rows], order)[0]
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[2], r[6])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def hashes(words):
    """Of an n-gram with marks of the beginning (1) and the end (0): its hash and its context's."""
    own = [katz._BEGIN if w == 1 else katz._END if w == 0 else katz.hash_words([w])[0] for w in words]
    context, gram = None, own[0]
    for w in own[1:]:
        context = gram
        gram = context if gram == katz._BEGIN == w else katz.mix(context * katz._MULTIPLIER ^ w)
    return context, gram


@pytest.mark.filterwarnings("ignore:overflow")
def test_stored_probabilities_add_up(spark, tmp_path):
    """P(w | h) from the operator's own tables, over all words and the unseen ones together."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = [held_out(d) for d, _ in rows]
    katz.score_documents(df, katz.crc_mod(10) == 0, 3, str(tmp_path))
    counts, weights = [], {}
    for k in (1, 2, 3):
        counts.append({})
        for r in spark.read.parquet(f"{tmp_path}/ngrams-{k}").collect():
            counts[-1].update(zip(katz.unpack_sorted(r["keys"]).tolist(), katz.unpack(r["counts"], np.int64).tolist(), strict=True))
    for r in spark.read.parquet(f"{tmp_path}/weights").collect():
        own = zip(katz.unpack_sorted(r["keys"]).tolist(), katz.unpack(r["weights"], np.float64).tolist(), strict=True)
        weights.update(((r.part, key), w) for key, w in own)
    _, _, words, after = brute(rows, held, 3)
    of_counts = [[sum(v == r for v in c.values()) for r in range(katz.K + 2)] for c in counts]
    texts = held.count(False)
    model = katz.Model(sum(counts[0].values()), len(counts[0]), texts, of_counts)
    assert {len(c) for c in counts} == {len(words), sum(map(len, after[2].values())), sum(map(len, after[3].values()))}

    def p(h, w):
        if not h:
            c = counts[0].get(int(hashes([w])[1]), 0)
            return float(model.seen(1, np.array(c), None)) if c else model.unseen
        context, gram = (int(x) for x in hashes([*h, w]))
        of_context = texts if context == int(katz._BEGIN) else counts[len(h) - 1].get(context, 0)
        c = counts[len(h)].get(gram, 0)
        if c:
            return float(model.seen(len(h) + 1, np.array(c), of_context))
        return (weights[len(h) + 1, context] if of_context else 1) * p(h[1:], w)

    wanted = [h for h in after[3] if 1 not in h]
    known = {key for _, key in weights}
    wanted = [h for h in wanted if int(hashes(h)[1]) in known and int(hashes(h[1:])[1]) in known]
    assert len(wanted) > 20
    for h in [*wanted[:40], (b"never", b"seen"), (b"never", b"w0")]:
        assert sum(p(h, w) for w in words) + p(h, b"unseen word") == pytest.approx(1, abs=1e-9)


def test_discounts():
    d = katz.discounts([0, 1000, 400, 230, 150, 110, 80])
    assert ((0 < d[1:6]) & (d[1:6] < 1)).all() and d[6] == 1
    assert katz.discounts([0] * 7)[1:6].tolist() == [1 - 0.5 / r for r in range(1, 6)]


def test_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (katz.unpack_sorted(katz.pack_sorted(keys)) == keys).all()
    cells = list(katz.cells(keys, 7))
    assert [k for k, _ in cells] == list(range(7)) and (np.concatenate([keys[p] for _, p in cells]) == keys).all()
    assert len(list(katz.cells(keys, 2**31))) <= len(keys) and not list(katz.cells(keys[:0], 7))


def test_nothing_to_learn_or_score(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert katz.score_documents(df.limit(0), F.lit(False)).count() == 0
    got = katz.score_documents(df, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


def test_many_partitions(spark):
    """Numbers of blocks hold for thousands of input partitions."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b a").alias("text"))
    rdd = df.repartition(2500, "doc_id")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(katz, "BLOCK", 1000)
        got = katz.score_documents(rdd, F.col("doc_id") % 10 == 0).agg(F.count("*"), F.countDistinct("doc_id"), F.min("score"), F.max("score")).first()
    assert got[:2] == (3000, 3000) and got[2] == pytest.approx(got[3])


def test_longer_contexts_are_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = {}
    for order in (1, 2, 3):
        held = katz.score_documents(docs, katz.crc_mod(10) == 0, order).where("held_out")
        base, sums[order] = held.agg(F.sum("base_score"), F.sum("score")).first()
    assert sums[3] > sums[2] > max(sums[1], base)
