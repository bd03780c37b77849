import random

import numpy as np

import corpus_pipeline
from itemlab.llm import decontaminate, minhash
from itemlab.llm.bpe import WordBpe, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "lang_pred", "entity_types", "matches", "n_entities"]


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n, tag: " ".join(f"{tag}{rng.randint(0, 900)}" for _ in range(n))
    item = prose(30, "quiz")
    near = prose(100, "near")
    rows = [(k, prose(80, "word"), "en", "s", 1) for k in range(20)]
    rows += [(30, near, "en", "s", 1), (31, near + " more", "en", "s", 1), (32, near, "en", "s", 1), (32, near, "en", "s", 1)]
    rows += [(40, prose(50, "word") + " " + item + " " + prose(50, "word"), "en", "s", 1)]
    rows += [(50, prose(50, "word") + " write to a.b@mail.example.com now", "en", "s", 1)]
    rows += [(60, None, "en", "s", 1), (61, "", None, None, None), (62, "12 34 !!", "en", "s", 1), (None, prose(60, "word"), "en", "s", 1)]
    rows += [(70, prose(90, "word"), "en", "s", 1)] * 2
    rows += [(80, near, "en", "s", 1), (80, prose(70, "word"), "en", "s", 1)]  # one doc_id, one text of it a copy
    clash = (0.5, "mine", {"a": 1}, [7], 3)
    extra = ", score double, lang_pred string, entity_types map<string, int>, matches array<int>, n_entities int"
    schema = "doc_id long, text string, lang string, source string, n_chars long" + extra
    spark.createDataFrame([(*r, *clash) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS
        assert all(tuple(r)[5:] == clash for r in docs.collect())
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    clean = [*range(20), 50, 80, None]
    assert kept["language_id"] == sorted([*clean, 30, 31, 32, 32, 40, 70, 70, 80], key=str)
    assert kept["near_dedup"] == sorted([*clean, 30, 40, 70], key=str)
    assert kept["decontamination"] == kept["pii"] == sorted([*clean, 30, 70], key=str)
    text = {r.doc_id: r for r in docs.collect()}
    assert "a.b@mail.example.com" not in text[50].text and text[50].n_chars == len(text[50].text)
    encoder = WordBpe(open(tokenizer_path("word_bpe_49k.json")).read())
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {d: len(encoder.encode([r.text])[0][0]) // 4 for d, r in text.items()}


def test_whole_table(spark):
    """Every document that goes has a reason, and every one that stays has none."""
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    kept = sorted(d for d, t in rows.items() if t and any(map(str.isalpha, t)))
    sets = {d: set(minhash.shingles(rows[d]).tolist()) for d in kept}
    holders = {}
    for d in kept:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    first = {d: d for d in kept}  # of its group

    def root(d):
        while first[d] != d:
            d = first[d]
        return d

    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                if root(a) != root(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    first[y] = x
    for d in kept:
        leak = False
        if root(d) == d:
            words = decontaminate.tokens(rows[d])
            leak = any(len(b) and 2 * len(b) and decontaminate.align(words, b)[0] >= decontaminate.THRESHOLD * 2 * len(b)
                       for b in items if np.isin(b, words).mean() >= decontaminate.THRESHOLD)
        assert (d in out) == (root(d) == d and not leak), d
