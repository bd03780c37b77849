
import numpy as np
import pytest

from itemlab.llm import token_counts as tc

PATH = tc.tokenizer_path("byte_bpe_50k.tiktoken")
ROWS = [
    (1, "src", "first line\nsecond  line\n\n\nlast é中😀", "x"),
    (2, None, "one", "x"),
    (3, "", "", "x"),
    (4, None, None, "x"),
    (None, "s", "\n\n  \n", "x"),
    (5, "a b", "word " * 20_000 + "\nend", "x"),
    (5, "a b", "word " * 20_000 + "\nend", "x"),
]


@pytest.fixture(scope="module")
def encoder():
    return tc.load(open(PATH, "rb").read())[0]


def whole(text):
    return tc.encode(text, *tc.load(open(PATH, "rb").read())[:2])


def brute(encoder, fields, rule):
    """Tokens of each section, byte by byte."""
    present = [(k, v) for k, v in enumerate(fields) if v is not None]
    owner, sections = [], []
    for n, (k, v) in enumerate(present):
        lines = v.split("\n") if k == 1 else [v]
        for i, line in enumerate(lines):
            last = n == len(present) - 1 and i == len(lines) - 1
            owner += [len(sections)] * (len(line.encode()) + (not last))
            sections.append((k, i))
    counts = [0.0] * len(sections)
    at = 0
    for token in encoder.encode_ordinary("\n".join(v for _, v in present)):
        size = len(encoder.decode_single_token_bytes(token))
        mine = owner[at : at + size]
        at += size
        if rule == "split":
            for o in mine:
                counts[o] += 1 / size
        else:
            o = mine[0] if rule == "start" else mine[-1] if rule == "end" else max(sorted(set(mine)), key=mine.count)
            counts[o] += 1
    assert at == len(owner)
    return dict(zip(sections, counts, strict=True))


@pytest.mark.parametrize("rule", tc.RULES)
def test_against_bytes(spark, encoder, rule):
    df = spark.createDataFrame(ROWS, "doc_id long, a string, b string, section string")
    got = tc.count_tokens(df, ["a", "b"], ["b"], PATH, rule).collect()
    for doc, a, b, _ in ROWS:
        want = brute(encoder, [a, b], rule)
        times = sum(r[0] == doc for r in ROWS)
        mine = [r for r in got if r.doc_id == doc]
        assert len(mine) == times * len(want)
        whole = "\n".join(v for v in (a, b) if v is not None)
        for r in mine:
            assert r.n_tokens == pytest.approx(want["ab".index(r.field), r.section])
            value = (b.split("\n")[r.section] if r.field == "b" else a) if r.char_begin < r.char_end else ""
            assert whole[r.char_begin : r.char_end].removesuffix("\n") == value


def test_allocate_long_token():
    begins, ends, sections = np.array([0, 2]), np.array([2, 9]), np.array([0, 3, 5])
    got = {rule: tc.allocate(begins, ends, sections, rule).tolist() for rule in tc.RULES}
    assert got["start"] == [2, 0, 0] and got["end"] == [1, 0, 1] and got["majority"] == [1, 0, 1]
    assert got["split"] == pytest.approx([1 + 1 / 7, 2 / 7, 4 / 7])


def test_empty_and_wrong_rule(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, a string, b string, section string")
    assert tc.count_tokens(df.limit(0), ["a", "b"], ["b"], PATH).count() == 0
    with pytest.raises(ValueError):
        tc.count_tokens(df, ["a"], [], PATH, "other")


def test_whole_table(spark, encoder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = tc.op3_token_counts(spark, "/root/testdata/sf0.001").groupBy("doc_id").sum("n_tokens").collect()
    assert dict(map(tuple, got)) == {d.doc_id: len(encoder.encode_ordinary(f"{d.source}\n{d.lang}\n{d.text}")) for d in docs}


@pytest.mark.parametrize("run", [" ", "\n", "\u3000", " \t", "\r\n", " \xa0"])
def test_long_runs_are_encoded_as_a_whole(encoder, monkeypatch, run):
    """Cut at runs that the encoder itself can still take."""
    monkeypatch.setattr(tc, "LONG_RUN", 5)
    monkeypatch.setattr(tc, "_RUN", tc.re.compile(f"[{tc.WHITE}]{{5,}}"))
    for text in (run * 9, f"a{run * 9}", f"{run * 9}b", f"it's{run * 9}we'll{run * 8}12 {run * 7}- end{run}", f"a{run * 40} {run * 9}!"):
        assert whole(text) == encoder.encode_ordinary(text)


def test_very_long_texts(spark):
    texts = [" " * 2_000_000, "\n" * 2_000_000, "x" + " " * 2_000_000 + "y", "w" * 1_000_000, "7" * 1_000_000, "=" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tc.count_tokens(df, ["text"], [], PATH).collect()
    assert sorted(r.doc_id for r in got) == list(range(6)) and all(r.n_tokens > 1000 for r in got)


def test_invalid_bytes(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert tc.count_tokens(df, ["text"], [], PATH).first().n_tokens == len(whole("a\ufffdb"))
