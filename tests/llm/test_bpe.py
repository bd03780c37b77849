import hashlib
import random

import numpy as np
import pytest

from itemlab.llm import bpe

PATH = bpe.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    with open(PATH, encoding="utf-8") as f:
        return bpe.WordBpe(f.read()), tokenizers.Tokenizer.from_file(PATH)


def same(both, text):
    ours, theirs = both
    [(ids, decoded)] = ours.encode([text])
    want = theirs.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want, text
    assert decoded == theirs.decode(want, skip_special_tokens=False), text


def test_random_texts(both):
    rng = random.Random(3)
    letters = "abcdeinorst'<>/w€éß😀中Σ́ñ²½1９İ՘ \t\x1c\x85\xa0_!"
    for k in range(4000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        same(both, text + "<|endoftext|>x" * (k % 50 == 0))


def test_many_texts_at_once(both, monkeypatch):
    rng = random.Random(4)
    texts = ["", None, *[" ".join("".join(rng.choices("abcdehinort", k=rng.randint(1, 9))) for _ in range(60)) for _ in range(90)]]
    texts += [t + " <|endoftext|>" + t for t in texts[2:9]]
    apart = [both[0].encode([t])[0] for t in texts]
    for text, (ids, _) in zip(texts, apart, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == both[1].encode(text or "", add_special_tokens=False).ids
    with open(PATH, encoding="utf-8") as f:
        forgetful = bpe.WordBpe(f.read(), 100)
    assert forgetful.encode(texts) == apart
    monkeypatch.setattr(bpe, "GROUP", 700)
    monkeypatch.setattr(bpe, "PIECE", 50)
    assert forgetful.encode(texts) == apart


def test_tokens_are_found_again(both):
    for token in list(both[1].get_vocab())[::7]:
        same(both, token.replace("</w>", ""))


def test_long_words(both):
    same(both, "a" * 5000 + " " + "thatth" * 900 + "!" * 3000)


def test_edges(spark, both):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "Hello's WORLD"), (4, "Hello's WORLD"), (None, "x"), (5, "w ö " * 60_000)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in texts], "doc_id long, text string, ids string")
    got = sorted((tuple(r) for r in bpe.digests(bpe.encode_documents(df, PATH)).collect()), key=str)
    want = []
    for d, t in texts:
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        decoded = both[1].decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


def test_whole_table(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in bpe.op8_bpe(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = both[1].encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = both[1].decode(ids, skip_special_tokens=False)
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
