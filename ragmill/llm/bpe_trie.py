"""BPE encoding and decoding with shared prefixes: distinct words as a trie, walked depth first.

Sorted, the distinct words of a group of texts are the preorder of their trie: a word keeps as many states
of the one before as their common prefix has symbols. The state of a trie node is the last token of its
prefix's encoding. That token is the one suffix that is a token and that stands stably after the state of
the node where it begins, so a node needs its ancestors' states only, and a word's encoding is read off
backwards from its last node. Prefixes are so encoded once, however many words share them. A word's last
symbol carries the end mark and makes a node of its own.

Defined cases: null is taken as an empty text, which has no tokens and decodes to an empty text; strings of
special tokens inside a text become those tokens; equal rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common
from .token_counts import FIRST_NEWER, SPACES, byte_symbols, newer, split_text

END = "</w>"
#: How the vocabulary splits a normalised text into words.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+"
# Fixed values of Unicode: letters and numbers that version 16.0 added, as ranges, which the vocabulary's pattern
# knows (but no later ones), and the small letters of capitals that versions 16.0 and 17.0 added.
UNICODE_16 = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d40-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 "
    "113d1-113d1 113d3-113d3 116d0-116e3 11bc0-11be0 11bf0-11bf9 13460-143fa 16100-1611d 16130-16139 16d40-16d6c 16d70-16d79 18cff-18cff "
    "1ccf0-1ccf9 1e5d0-1e5ed 1e5f0-1e5fa"
)
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# Combining marks that versions 10.0 to 15.1 added, as ranges, and the second half of the one composition they added.
MARKS_SINCE_10 = (
    "7fd-7fd 898-89f 8ca-8d3 9fe-9fe c3c-c3c d3b-d3c eba-eba 1715-1715 1abf-1ace 1df6-1dfa a82c-a82c 10d24-10d27 10eab-10eac 10efd-10eff "
    "10f46-10f50 10f82-10f85 11070-11070 1133b-1133b 1145e-1145e 11839-1183a 11930-11930 1193d-1193e 11943-11943 119e0-119e0 11a34-11a34 "
    "11a47-11a47 11a99-11a99 11d42-11d42 11d44-11d45 11d97-11d97 11f41-11f42 16ff0-16ff1 1e08f-1e08f 1e130-1e136 1e2ae-1e2ae 1e2ec-1e2ef "
    "1e4ec-1e4ef"
)
# End of the fixed values.
#: The lowest of MARKS_SINCE_10.
FIRST_MARK = "\u07fd"
#: Token pairs, and words, that a worker keeps.
_PAIRS = 200_000
KNOWN = 400_000


def ranges(text: str) -> list[range]:
    """Ranges of code points from their fixed values."""
    return [range(int(a, 16), int(b, 16) + 1) for a, _, b in (r.partition("-") for r in text.split())]


@functools.cache
def hidden() -> dict[int, str]:
    """Characters that the regex module has as letters or numbers and the vocabulary's pattern doesn't, with their stand-in."""
    known = {c for r in ranges(UNICODE_16) for c in r}
    return {c: x for c, x in newer().items() if c not in known}


@functools.cache
def unknown_marks() -> regex.Pattern:
    return regex.compile("([" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in ranges(MARKS_SINCE_10)) + "])")


def composed(text: str) -> str:
    """Canonical composition by the vocabulary's tables, which end with Unicode 9: a later mark neither moves nor joins.

    So it parts the text: no mark is carried past it, and what follows it composes with nothing before it.
    """
    if max(text) < FIRST_MARK:
        return unicodedata.normalize("NFC", text)
    return "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(unknown_marks().split(text)))


class TrieEncoder:
    """Encodes words for a vocabulary whose words end in END."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.vocab = vocab
        self.names = {i: t for t, i in vocab.items()}
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.longest = max(len(t.removesuffix(END)) for t in vocab)
        self.stable: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token.removesuffix(END)
            return [*body[:-1], body[-1] + END]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short run of symbols; settles which tokens can stand side by side."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), len(self.ranks)), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == len(self.ranks):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are side by side; left is empty at the start of a word."""
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) >= _PAIRS:
                self.stable.clear()
            parts = self.symbols(left) + self.symbols(right) if left else self.symbols(right)
            known = self.stable[left, right] = self.merged(parts) == ([left, right] if left else [right])
        return known

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of distinct words, given in byte symbols."""
        vocab, stable, fits, longest = self.vocab, self.stable, self.fits, self.longest
        out: dict[str, list[str]] = {}
        states, last = [""], ""
        for word in sorted(words):
            size = len(word)
            # States of the common prefix stay; a word's last symbol, which carries the end mark, has its own node.
            same = 0
            for a, b in zip(word[: size - 1], last[:-1], strict=False):
                if a != b:
                    break
                same += 1
            del states[same + 1 :]
            for depth in range(same + 1, size + 1):
                end = END if depth == size else ""
                for start in range(depth - longest if depth > longest else 0, depth):
                    token = word[start:depth] + end
                    if token in vocab:
                        left = states[start]
                        known = stable.get((left, token))
                        if known or known is None and fits(left, token):
                            break
                else:
                    raise ValueError("no token of the vocabulary ends this prefix")
                if depth < size:
                    states.append(token)
            tokens, depth = [token], size - len(token) + len(END)
            while depth:
                token = states[depth]
                tokens.append(token)
                depth -= len(token)
            out[word] = tokens[::-1]
            last = word
        return out


class Codec:
    """A vocabulary file with the encodings of the words seen lately."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.encoder = TrieEncoder(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split = regex.compile(PATTERN)
        self.table = byte_symbols()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.names = self.encoder.names | {i: t for t, i in self.special.items()}

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            # Letters are lower-cased one by one, so a final sigma has no form of its own.
            text = composed(text).replace("Σ", "σ")
        # Runs of white space, which the vocabulary makes one space, stand between words and go either way.
        text = text.lower()
        if not text or max(text) < FIRST_NEWER:
            return self.split.findall(text)
        return split_text(self.split, text.translate(SMALL), hidden())

    def learn(self, words: set[str]) -> None:
        spelled = {"".join(map(self.table.__getitem__, w.encode())): w for w in words}
        vocab = self.encoder.vocab
        for spelling, tokens in self.encoder.encode(spelled).items():
            ids = [vocab[t] for t in tokens]
            self.known[spelled[spelling]] = struct.pack(f"<{len(ids)}I", *ids), " ".join(tokens)

    def encode(self, texts: list[str]) -> list[tuple[bytes, list[str]]]:
        """For each text its ids as little-endian 32-bit integers and its words, special tokens among them."""
        split = []
        for text in texts:
            if self.special_split.search(text):
                words = []
                for i, piece in enumerate(self.special_split.split(text)):
                    words += [("", piece)] if i % 2 else self.words(piece)
                split.append(words)
            else:
                split.append(self.words(text))
        new = set().union(*split).difference(self.known) if split else set()
        if new and len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = set().union(*split)
        for x in [x for x in new if isinstance(x, tuple)]:
            self.known[x] = struct.pack("<I", self.special[x[1]]), x[1]
        self.learn({x for x in new if isinstance(x, str)})
        known = self.known
        return [(b"".join([known[w][0] for w in words]), words) for words in split]

    def forget(self) -> None:
        """Leaves only what comes from the file."""
        self.known.clear()
        self.encoder.stable.clear()

    def decode(self, ids: bytes) -> str:
        """Token strings with a space between, as a vocabulary without a decoder is read."""
        return " ".join([self.names[i] for (i,) in struct.iter_unpack("<I", ids)])

    def ids_with_text(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Encodings with their decodings; a word's decoding is kept beside its ids, and decode() gives the same."""
        return [(ids, " ".join([self.known[w][1] for w in words])) for ids, words in self.encode(texts)]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


_KINDS = {"n_tokens": pa.int64(), "ids": pa.binary(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"n_tokens": "long", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, vocabulary: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), forget: bool = False) -> DataFrame:
    """doc_id and the named columns of each row: n_tokens, ids (little-endian 32-bit), decoded, ids_sha256, decoded_sha256.

    forget: workers drop the words they know after each task, for jobs in which they wait beside other steps.
    """
    common.bounded_batches(docs.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = {
            "n_tokens": lambda ids, _: len(ids) // 4,
            "ids": lambda ids, _: ids,
            "decoded": lambda _, text: text,
            "ids_sha256": lambda ids, _: hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": lambda _, text: hashlib.sha256(text.encode()).hexdigest(),
        }
        try:
            for group in common.groups(batches):
                done = codec(vocabulary).ids_with_text([t or "" for t in group.column(1).to_pylist()])
                made = [pa.array([make[c](*x) for x in done], _KINDS[c]) for c in columns]
                yield pa.RecordBatch.from_arrays([group.column(0), *made], names=["doc_id", *columns])
        finally:
            if forget:
                codec(vocabulary).forget()

    return docs.select("doc_id", "text").mapInArrow(of, ", ".join(["doc_id long", *(f"{c} {_SQL[c]}" for c in columns)]))
