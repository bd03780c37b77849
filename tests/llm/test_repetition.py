import random
import re
from collections import Counter

import numpy as np
import pytest

from itemlab.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, window=8):
    """Base columns, and covered characters, longest repeat and number of maximal repeats by trying all substrings."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    counts = Counter(tuple(words[i : i + window]) for i in range(n - window + 1))
    at = {k for i in range(n - window + 1) if counts[tuple(words[i : i + window])] > 1 for k in range(i, i + window)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    longest, maximal = 0, 0
    for size in range(window, n):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        for found in (p for p in places.values() if len(p) > 1):
            longest = size
            left = {words[i - 1] if i else None for i in found}
            right = {words[i + size] if i + size < n else None for i in found}
            maximal += (len(left) > 1) and (len(right) > 1)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return [n, sum(map(len, words)), symbols, dup, len(at), maximal, sum(len(words[k]) for k in at), longest]


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\x0b", "one", "a " * 40, "ab " * 9, "é#€ x\xa0y\n\né#€ x\xa0y\n \n \n", "a b " * 20 + "c"]
    for _ in range(40):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]
        part = words[5:30]
        for _ in range(rng.randint(0, 3)):
            words[rng.randint(0, len(words)):0] = part
        out.append(rng.choice([" ", "\n"]).join(words))
    return out


@pytest.mark.parametrize("chunk", [1, 100, 400_000])
def test_against_all_substrings(monkeypatch, chunk):
    monkeypatch.setattr(repetition, "CHUNK", chunk)
    given = texts()
    for text, got in zip(given, repetition.measure(given).tolist(), strict=True):
        assert got == brute(text), text


def test_long_repetitive_text():
    got = repetition.measure(["word " * 100_000, "a b c d e f g h i j " * 10_000])
    assert got[:, 7].tolist() == [99_999, 99_990] and got[:, 4].tolist() == [100_000, 100_000]


def test_suffix_array():
    key = np.array(list(b"mississippi\x00"), np.uint64)
    levels, array = repetition.suffix_levels(key)
    assert array.tolist() == sorted(range(12), key=lambda i: key[i:].tolist())


def test_rows(spark):
    given = texts()
    rows = [(i, t, "clash") for i, t in enumerate(given)] + [(0, None, "x"), (None, "w " * 30, "x")]
    rows.append((99, " ".join(f"w{k}" for k in range(300)), "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = repetition.quality_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(next(t for d, t, _ in rows if d == r.doc_id)) if r.doc_id != 99 else [300]
        assert r.n_words == want[0]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert next(r for r in got if r.doc_id == 99).kept
    assert repetition.quality_rules(df.limit(0)).count() == 0


def test_limits_decide(spark):
    """Few words that are long, within the base's limit of words, and one long repeat."""
    plain = [f"p{k}" for k in range(100)]
    long = [f"{'long' * 9}{k}" for k in range(12)]
    rows = [
        (1, " ".join(plain + long + plain[:1] + long)),  # 24 of 125 words, most of the characters
        (2, " ".join([f"q{k}" for k in range(300)] + plain[:51] + ["x"] + plain[:51])),
        (3, " ".join([f"q{k}" for k in range(300)] + plain[:50] + ["x"] + plain[:50])),
    ]
    got = {r.doc_id: r for r in repetition.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].base_failed for k in (1, 2, 3)] == [False] * 3
    assert [got[k].kept for k in (1, 2, 3)] == [False, False, True]
    assert [got[k].longest_repeat for k in (1, 2, 3)] == [12, 51, 50]
