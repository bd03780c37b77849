"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

A word's encoding ends, for each of its prefixes, in one token that no other encoding of that prefix
has: the token that matches the prefix's end and is compatible with the last token of what is left
before it. A suffix automaton of the vocabulary gives the tokens that end at a position; a pair is
compatible if merging the two tokens' text gives just these two. Following the last tokens back
from the end of the word gives its ids, without a merge loop.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import resident, small_batches, table, valid

#: Words of which a Python worker remembers the encoding, twice: beyond that it forgets the older half, between two groups.
REMEMBERED = 70_000
#: Pairs of tokens of which a Python worker remembers whether they are compatible.
PAIRS = 200_000
#: Characters that are split into words at once; longer texts are cut before a blank.
PIECE = 1 << 15
#: Characters whose words are encoded together.
GROUP = 1 << 20
_END = 256  # added to the last byte of a word
#: Characters on which this Python's tables and the tokenizer's agree; texts with others are split by it.
_COMMON = regex.compile("[\x00-՗ -⁰]*+")


def tokenizer_path(name: str) -> str:
    """Where the package of public tokenizers has a file; operators take any path."""
    return str(public_tokenizers.path(name))


def pieces(text: str):
    """The text in pieces of about PIECE characters, each but the first beginning with a blank.

    No word spans a blank, and no character composes with one, so pieces are split as the whole is.
    """
    begin = 0
    while len(text) - begin > PIECE:
        end = text.find(" ", begin + PIECE)
        if end < 0:
            break
        yield text[begin:end]
        begin = end
    yield text[begin:] if begin else text


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class SuffixAutomaton:
    """States of all substrings of a set of strings; ``ends`` tells which strings end at a state.

    A string of the set is the longest of its state, as nothing longer ends where it ends alone.
    """

    def __init__(self, strings: dict[tuple[int, ...], int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        token_of: dict[int, int] = {}
        for string, token in strings.items():
            last = 0
            for symbol in string:
                last = self._extend(last, symbol)
        for string, token in strings.items():
            state = 0
            for symbol in string:
                state = self.next[state][symbol]
            token_of[state] = token
        # For each state the nearest state on the way over its links, itself included, that is a token.
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.token = [-1] * len(self.link)
        for state, token in token_of.items():
            self.token[state] = token
        self.ends = [0] * len(self.link)
        for state in order[1:]:
            self.ends[state] = state if self.token[state] >= 0 else self.ends[self.link[state]]

    def _state(self, length: int, transitions: dict[int, int], link: int) -> int:
        self.next.append(transitions), self.length.append(length), self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """The state of the strings of q that end after p's longest; q itself if that is all of them."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, self.next[last][symbol], symbol)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][symbol], symbol)
        return new


class WordBpe:
    """Encoder of one tokenizer file (``BPE`` with an end-of-word suffix over byte-level letters)."""

    def __init__(self, source: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        spec = json.loads(source)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._source, self._splitter = source, None
        letters = byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = {vocab[c]: (b,) for b, c in letters.items()}
        symbols |= {vocab[c + suffix]: (b + _END,) for b, c in letters.items()}
        self.merged: dict[int, tuple[int, int]] = {}  # by pair of ids, as one number: rank and id
        self.rank, self.parts = dict.fromkeys(symbols, -1), {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            self.merged[left << 20 | right] = rank
            if new not in symbols:
                symbols[new] = symbols[left] + symbols[right]
                self.rank[new], self.parts[new] = rank, (left, right)
        self.automaton = SuffixAutomaton({s: t for t, s in symbols.items()})
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.ids: dict[str, bytes] = {}  # of the recent words
        self.decoded: dict[str, str] = {}
        self.older: tuple[dict[str, bytes], dict[str, str]] = {}, {}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pattern = regex.compile(pattern)
        # The same of ASCII texts, for which the standard library is faster; its own blanks are others.
        plain = pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t-\r")
        self._ascii = self._pattern if "\\p" in plain else re.compile(plain)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens gives just these two.

        Goes back in time: the merge of the highest rank, of equal ones the right one, came last.
        Before it, its part at the border lay beside the other token's; had that pair a merge that
        goes first, the border would be gone.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, parts, merged = self.rank, self.parts, self.merged
        a, b, limit = left, right, 1 << 40
        while True:
            across = merged.get(a << 20 | b)
            if across is not None and across < limit:
                result = False
                break
            of_a, of_b = rank[a], rank[b]
            if of_a < 0 and of_b < 0:
                result = True
                break
            if of_a > of_b:
                a, limit = parts[a][1], of_a
            else:  # a pair of the same rank further left goes first, too
                b, limit = parts[b][0], of_b + 1
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[key] = result
        return result

    def stands_alone(self, token: int) -> bool:
        """Whether the token's own text is encoded as this token."""
        known = self.alone.get(token)
        if known is None:
            known = token not in self.parts or (
                all(map(self.stands_alone, self.parts[token])) and self._last_merge(token)
            )
            self.alone[token] = known
        return known

    def _last_merge(self, token: int) -> bool:
        """Whether the parts stay whole until they merge: no pair across their border goes before that."""
        a, b = self.parts[token]
        own, rank, parts, merged = self.rank[token], self.rank, self.parts, self.merged
        while rank[a] >= 0 or rank[b] >= 0:
            if rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            else:
                limit, b = rank[b] + 1, parts[b][0]
            across = merged.get(a << 20 | b)
            if across is not None and across < min(limit, own):
                return False
        return True

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of these words' bytes; what a word begins with like the one before is taken over from that."""
        follow, link, token = self.automaton.next, self.automaton.link, self.automaton.token
        ends, length, compatible = self.automaton.ends, self.automaton.length, self.compatible
        known = self.pairs.get
        # Of each prefix: the last token and its length, the automaton's state and the length of the text that it stands for.
        last, lengths, states, matches = [-1], [0], [0], [0]
        found, before_it = [], b""
        for raw in words:
            n = len(raw)
            i = 0  # the last byte is another symbol, so it is never shared
            for a, b in zip(before_it[:-1], raw[:-1], strict=False):
                if a != b:
                    break
                i += 1
            before_it = raw
            del last[i + 1 :], lengths[i + 1 :], states[i + 1 :], matches[i + 1 :]
            state, matched = states[i], matches[i]
            for symbol in raw[i:]:
                i += 1
                if i == n:
                    symbol += _END
                to = follow[state].get(symbol)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = follow[state].get(symbol)
                if to is not None:
                    state = to
                    matched += 1
                at = ends[state] if matched == length[state] else ends[link[state]]
                end, size = -1, 0
                while at:
                    size, t = length[at], token[at]
                    if size == i:
                        fits = self.stands_alone(t)
                    elif (before := last[i - size]) >= 0:
                        fits = known(before << 20 | t)
                        if fits is None:
                            fits = compatible(before, t)
                    else:
                        fits = False
                    if fits:
                        end = t
                        break
                    at = ends[link[at]]
                last.append(end), lengths.append(size), states.append(state), matches.append(matched)
            out = []
            while n > 0:
                out.append(last[n])
                n -= lengths[n]
            found.append(out[::-1])
        return found

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text the ids as little-endian 32-bit numbers, and the decoded text: the tokens' own texts with blanks between."""
        found: list[tuple[list[bytes], list[str]]] = [([], []) for _ in texts]
        group, size = [], 0
        for own, text in zip(found, texts, strict=True):
            for k, part in enumerate(self._specials.split(text) if text and "<|" in text else [text or ""]):
                for piece in [part] if k % 2 else pieces(part):
                    group.append((own, [part] if k % 2 else self._split(piece)))
                    size += len(piece)
                    if size > GROUP:
                        self._finish(group)
                        group, size = [], 0
        self._finish(group)
        return [(b"".join(ids), " ".join(decoded)) for ids, decoded in found]

    def _finish(self, group) -> None:
        """Adds the encodings of a group's lists of words to their texts."""
        distinct: set[str] = set()
        for _, words in group:
            distinct.update(words)
        self._learn(distinct)
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        for own, words in group:
            if words:
                own[0].append(b"".join(map(ids, words)))
                own[1].append(" ".join(map(decoded, words)))

    def _split(self, text: str) -> list[str]:
        """Normalised words: canonical composition, lower case letter by letter, no white space."""
        if text.isascii():
            return self._ascii.findall(text.lower())
        if _COMMON.fullmatch(text):
            return self._pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_str(self._source)
        whole = self._splitter.normalizer.normalize_str(text)
        words = [w for w, _ in self._splitter.pre_tokenizer.pre_tokenize_str(whole)]
        return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8", "surrogateescape") for w in words]

    def _learn(self, words: set[str]) -> None:
        """Puts these words among the recent ones; those that are no older ones either are encoded in order."""
        if len(self.ids) >= self.remembered:
            self.older, self.ids, self.decoded = (self.ids, self.decoded), {}, {}
        new = words - self.ids.keys()
        for source, target in zip(self.older, (self.ids, self.decoded), strict=True):
            again = new & source.keys()
            target.update(zip(again, map(source.__getitem__, again), strict=True))
        new -= self.ids.keys()
        for special in new & self.special.keys():
            new.remove(special)
            self.ids[special], self.decoded[special] = struct.pack("<I", self.special[special]), special
        ordered = sorted(new)  # of code points, as their bytes are
        encoded = self.encode_words([word.encode("utf-8", "surrogateescape") for word in ordered])
        text_of = self.text_of.__getitem__
        for word, found in zip(ordered, encoded, strict=True):
            self.ids[word] = struct.pack(f"<{len(found)}I", *found)
            self.decoded[word] = " ".join(map(text_of, found))


def encode_documents(docs: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, ids, decoded`` of each row's whole text with the tokenizer file at path.

    ids holds the token ids as little-endian unsigned 32-bit integers, decoded the tokens' texts with
    a blank between any two. A null text counts as empty: no ids, decoded "". Strings of special
    tokens in a text become these tokens. Repeated rows and null doc_ids are encoded like any other;
    other columns are ignored.
    """
    with open(path, encoding="utf-8") as f:
        source = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(source)  # one vocabulary file, a few MB

    def run(batches):
        encoder = resident(f"bpe {path} {remembered}", lambda: WordBpe(shipped.value, remembered))
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                out = encoder.encode(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    small_batches(spark)
    path = path or tokenizer_path("word_bpe_49k.json")
    return digests(encode_documents(table(spark, sf_dir, "documents"), path, 2 * REMEMBERED))  # alone in its workers
