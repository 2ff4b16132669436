"""Token counts of texts under a byte-level BPE vocabulary, by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a group of texts lie one after another in one numpy array of symbol ids. In each
round every pre-token finds its pair of lowest rank and merges all its places at once; pre-tokens without
a mergeable pair leave. The count of a pre-token is what is left of its symbols.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a special token's string inside a text counts
as that one token, as the tokenizers library has it by default; equal rows give equal rows; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: How byte-level vocabularies split a text (public GPT-2 pattern); \s as Unicode's White_Space.
SPACES = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Stands for characters newer than the vocabularies' tables while a text is split: no letter, number or space.
STAND_IN = "\ue000"
#: The lowest character that a table newer than Unicode 15.1 adds as a letter or number.
FIRST_NEWER = "\u0558"
LIMIT = 512
_NEVER = np.int32(2**31 - 1)


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


@functools.cache
def newer() -> dict[int, str]:
    """Characters that the regex module has as letters or numbers and Unicode 15.1, which vocabularies go by, doesn't know, with their stand-in."""
    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    return dict.fromkeys(map(ord, regex.findall(r"[\p{L}\p{N}]", unknown)), STAND_IN)


def split_text(split: regex.Pattern, text: str, hidden: dict[int, str] | None = None) -> list[str]:
    """What a pattern finds in a text, with the characters of hidden (newer() unless given) as no letters or numbers."""
    hidden = newer() if hidden is None else hidden
    if not text or max(text) < FIRST_NEWER or hidden.keys().isdisjoint(map(ord, text)):
        return split.findall(text)
    return [text[m.start() : m.end()] for m in split.finditer(text.translate(hidden))]


class RankMerger:
    """Counts the tokens of pre-tokens. Merges must be ordered so that a token is made before it is used."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError("a merge uses a token that a later merge makes")
            if made.setdefault(a + b, rank) != rank:
                raise ValueError("two merges make one token")
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.ranks = self.order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def counts(self, words: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        ranks = np.full(len(symbols), _NEVER)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            spans = np.diff(np.r_[starts, len(owner)])
            low = np.minimum.reduceat(ranks, starts)
            out[owner[starts]] = spans
            going = np.repeat(low < _NEVER, spans)
            low = np.repeat(low, spans)[going]
            symbols, owner, ranks = symbols[going], owner[going], ranks[going]
            if not len(symbols):
                break
            hit = ranks == low
            # In a run such as aaaa, every other place from the left is merged.
            place = np.arange(len(hit))
            fresh = hit & ~(np.r_[False, hit[:-1]] & (np.r_[-1, owner[:-1]] == owner))
            run = np.maximum.accumulate(np.where(fresh, place, 0))
            at = np.flatnonzero(hit & ((place - run) % 2 == 0))
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new_at = np.cumsum(keep)[at] - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            ranks[new_at] = _NEVER
            for i in (new_at[new_at + 1 < len(owner)], (new_at - 1)[new_at > 0]):
                same = owner[i] == owner[i + 1]
                ranks[i[~same]] = _NEVER
                i = i[same]
                ranks[i] = self.rank(symbols[i], symbols[i + 1])
        return out


class Counter:
    """A vocabulary file with the counts of the pre-tokens seen lately."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.merger = RankMerger(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]])
        self.split = regex.compile(PATTERN)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        parts: list[tuple[list[str], int]] = []
        for text in texts:
            n = 0
            pieces = [text]
            if self.special and self.special.search(text):
                pieces = self.special.split(text)
                n = len(pieces) - 1
            tokens = split_text(self.split, pieces[0])
            for piece in pieces[1:]:
                tokens += split_text(self.split, piece)
            parts.append((tokens, n))
        new = set().union(*(p[0] for p in parts)).difference(self.known) if parts else set()
        if new and len(self.known) + len(new) > common.CACHE_WORDS:
            self.known.clear()
            new = set().union(*(p[0] for p in parts))
        if new:
            fresh = list(new)
            self.known.update(zip(fresh, self.merger.counts([w.encode() for w in fresh]).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, tokens), n) for tokens, n in parts]


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; vocabulary: a tokenizers .json file present on every executor."""
    common.bounded_batches(docs.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches):
            texts = [t or "" for t in group.column(1).to_pylist()]
            n = counter(vocabulary).count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    group.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
