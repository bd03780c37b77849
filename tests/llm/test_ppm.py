import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from itemlab.llm import ppm

TEXTS = {"aa": ["the cat and the hat", "a cat"], "bb": ["la casa y el gato", "él come"], "cc": ["der hut ist da"]}


def brute_bits(text, training, order, symbols):
    """Code length by walking down the contexts of one language."""
    tree = defaultdict(Counter)
    for t in training:
        b = bytes(order) + t.encode()
        for i in range(order, len(b)):
            for m in range(order + 1):
                tree[b[i - m : i]][b[i]] += 1
    bits, b = 0.0, bytes(order) + text.encode()
    for i in range(order, len(b)):
        for m in range(order, -1, -1):
            seen = tree.get(b[i - m : i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if b[i] in seen:
                bits += math.log2((total + kinds) / seen[b[i]])
                break
            bits += math.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths():
    counts = [ppm.ngram_counts([t.encode() for t in x]) for x in TEXTS.values()]
    model = ppm.Model(list(TEXTS), counts)
    texts = ["the gato", "él", "", "a hat is da", "x" * 300, "the cat and the hat"]
    got = model.code_lengths([t.encode() for t in texts])
    want = [[brute_bits(t, x, 3, None) for x in TEXTS.values()] for t in texts]
    np.testing.assert_allclose(got, want, rtol=1e-5)


def test_probabilities_leave_no_excess():
    model = ppm.Model(["aa"], [ppm.ngram_counts([t.encode() for t in TEXTS["aa"]])])
    rows = model.bits.reshape(-1, model.classes).astype(float)
    unseen = 256 - (model.classes - 1)
    total = (2.0 ** -rows[:, 1:]).sum(1) + unseen * 2.0 ** -rows[:, 0]
    assert (total <= 1 + 1e-6).all()


def test_edges(spark):
    rows = [(i, t, lang, "x") for i, (lang, ts) in enumerate(TEXTS.items()) for t in ts * 3]
    rows += [(100, None, "aa", "x"), (101, "", "aa", "x"), (102, "12 34 !!", "aa", "x"), (None, "el gato", None, "x"),
             (103, "the cat " * 50_000, None, "x"), (103, "the cat " * 50_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = ppm.identify_languages(df, F.lit(False)).collect()
    by = {(r.doc_id, r.text[:5] if r.text else r.text): r for r in got}
    assert len(got) == len(rows)
    for key in ((100, None), (101, ""), (102, "12 34")):
        assert (by[key].lang_pred, by[key].score) == ("und", 0.0)
    assert by[(103, "the c")].lang_pred == "aa" and by[(None, "el ga")].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    assert ppm.identify_languages(df.limit(0), F.lit(False)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in ppm.identify_languages(unlabelled, F.lit(False)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ppm.op6_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.98
