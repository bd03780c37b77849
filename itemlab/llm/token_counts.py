"""Tokens of a document's fields and sections.

A document is its fields joined by line feeds and is encoded once, whole: no section is encoded on
its own, where other tokens would come out at its ends. The tokens' spans follow from their lengths
and are joined with the sections' spans; a token that crosses a boundary goes where a rule says.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import resident, small_batches, table, valid

#: How byte-level BPE of this vocabulary cuts a text before merging (a fixed value of the tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the tokenizer has it (fixed values), and from how many of it on a run is encoded by itself.
WHITE, LONG_RUN = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 10_000
_RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
#: Where a token that crosses boundaries goes: to the section of its first or last byte, to that with
#: most of its bytes (the first of several), or to all by their shares of its bytes.
RULES = ("start", "end", "majority", "split")

SCHEMA = "doc_id long, field string, section int, char_begin long, char_end long, n_tokens double"


def allocate(begins: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, from the tokens' spans and where sections begin; the last is open to the right.

    Both lists are sorted and without gaps, so each token's first and last section are found by
    bisection, and those between are a range.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    n = len(sections)
    first = np.searchsorted(sections, begins, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float)
    whole = first == last
    out = np.bincount(first[whole], minlength=n).astype(float)
    cross = np.flatnonzero(~whole)
    if len(cross):
        parts = last[cross] - first[cross] + 1
        token = np.repeat(cross, parts)
        section = np.repeat(first[cross] - np.concatenate([[0], np.cumsum(parts)[:-1]]), parts) + np.arange(parts.sum())
        stop = np.append(sections[1:], np.iinfo(np.int64).max)[section]
        shared = np.minimum(ends[token], stop) - np.maximum(begins[token], sections[section])
        if rule == "split":
            np.add.at(out, section, shared / (ends - begins)[token])
        else:
            order = np.lexsort((section, -shared, token))
            best = order[np.unique(token[order], return_index=True)[1]]
            np.add.at(out, section[best], 1)
    return out


def layout(values: list[str | None], split: list[bool]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The whole document, the (field, section) of each section, and its first character.

    Null fields aren't there. A line feed belongs to the section before it. A field that is split has
    a section for each line.
    """
    parts, names, begins, at = [], [], [], 0
    present = [k for k, v in enumerate(values) if v is not None]
    for k in present:
        value = values[k] + ("\n" if k != present[-1] else "")
        lines = values[k].split("\n") if split[k] else [values[k]]
        for number, line in enumerate(lines):
            names.append((k, number)), begins.append(at)
            at += len(line) + 1
        parts.append(value)
        at = begins[-1] + len(lines[-1]) + (k != present[-1])
    return "".join(parts), names, begins


def load(source: bytes):
    """Encoder, encoder of white space, and the length of each token in bytes, from a file of base64 tokens and ranks."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines()) if a}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    encoders = [tiktoken.Encoding("file", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, r"\s+")]
    return encoders[0], encoders[1], sizes


def encode(text: str, encoder, blanks) -> list[int]:
    """The tokens of a text; its very long runs of white space go to an encoder that needs no look ahead.

    PATTERN takes a run as one piece, but for its last character if something follows: that begins
    the next piece. So a text can be cut there, and the encoder's stack, which looking ahead in a run
    takes up, can't run out.
    """
    if len(text) < LONG_RUN:
        return encoder.encode_ordinary(text)
    out, begin = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encoder.encode_ordinary(text[begin : run.start()])
        out += blanks.encode_ordinary(text[run.start() : end])
        begin = end
    return out + encoder.encode_ordinary(text[begin:])


def count_tokens(docs: DataFrame, fields: list[str], sectioned: list[str], path: str, rule: str = "start") -> DataFrame:
    """The columns of SCHEMA: a row for each section of each field of each row of docs (``doc_id`` and the fields).

    fields are joined in this order; those in sectioned have a section for each line, others one.
    Spans are of characters of the whole document, begin included, end not. The n_tokens of a document
    add up to its tokens. What isn't UTF-8 counts as replacement characters. A null field has no rows, an empty one a section without tokens. Repeated
    rows and null doc_ids are counted like any other; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, about a MB
    split = [f in sectioned for f in fields]

    def run(batches):
        encoder, blanks, sizes = resident(f"tokens {path}", lambda: load(shipped.value))
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                columns = [c.to_pylist() for c in batch.columns]
                out = []
                for doc_id, *values in zip(*columns, strict=True):
                    text, names, begins = layout(values, split)
                    if not names:
                        continue
                    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
                    at_char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    ends = np.cumsum(sizes[encode(text, encoder, blanks)])
                    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    chars = np.array(begins, np.int64)
                    counts = allocate(starts, ends, at_char[chars], rule)
                    out.append((doc_id, names, chars, np.append(chars[1:], len(text)), counts))
                n = [len(x[1]) for x in out]
                ids = [x[0] for x, m in zip(out, n, strict=True) for _ in range(m)]
                flat = [y for x in out for y in x[1]]
                join = lambda i: np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([fields[f] for f, _ in flat], pa.string()),
                     pa.array([s for _, s in flat], pa.int32()), pa.array(join(2), pa.int64()),
                     pa.array(join(3), pa.int64()), pa.array(join(4), pa.float64())],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *map(valid, fields)]
    return docs.select(*columns).mapInArrow(run, SCHEMA)


def op3_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    small_batches(spark)
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    out = count_tokens(table(spark, sf_dir, "documents"), ["source", "lang", "text"], ["text"], path)
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
