"""Toxicity scores from a small convolutional text classifier, trained here in numpy.

A word's embedding is the sum of the embeddings that its hash and the hashes of its first four and five
letters have in one table. Filters of several widths run over the words of a text; each filter's maximum over
all places goes, rectified, into a logistic output. Thresholds on that output are set per language on labelled
rows kept out of the gradient steps, and the score is moved so that 0.5 is the language's threshold. The
language is guessed from a text's own function words; no column other than the text plays a part in a score.

Training takes at most SAMPLE labelled rows (those of lowest hash of their id), whatever the corpus; scoring
reads every whole text once, without a shuffle.

Defined cases: null and empty texts, and texts without letters, get the score of a text without words; a
table without labelled rows of both kinds gives the score 0 everywhere; equal texts get equal scores; of
several labels of one document the highest counts; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that training takes at most.
SAMPLE = 8_000
BUCKETS = 1 << 17
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 5
BATCH = 16
RATE = 0.1
#: Words whose projections a worker keeps.
KNOWN = 300_000
HELD_OUT_OF = 5

#: Frequent function words by language, to guess a text's language.
FUNCTION_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais avec ou son lui nous comme être cette aux ses leur été elle même ces",
}
OTHER = "other"
_WORDS = re.compile(r"[^\W\d_]+")


def _function_words() -> dict[str, dict[str, float]]:
    """What a function word says for each language that has it: less the more languages do."""
    lists = {lang: set(words.split()) for lang, words in FUNCTION_WORDS.items()}
    return {lang: {w: 1 / sum(w in other for other in lists.values()) for w in own} for lang, own in lists.items()}


_BY_LANGUAGE = _function_words()
LANGUAGES = (*sorted(FUNCTION_WORDS), OTHER)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def buckets(words: list[str]) -> np.ndarray:
    """The three embedding rows of each word; a word too short for a prefix has its own row in its place. Row 0 stays zero."""
    of, n = xxhash.xxh3_64_intdigest, BUCKETS - 1
    whole = [1 + of("w" + w) % n if w else 0 for w in words]
    four = [1 + of("4" + w[:4]) % n if len(w) > 4 else x for w, x in zip(words, whole, strict=True)]
    five = [1 + of("5" + w[:5]) % n if len(w) > 5 else x for w, x in zip(words, whole, strict=True)]
    return np.array([whole, four, five], np.int32).T


_VOTES = {w: [_BY_LANGUAGE[lang].get(w, 0.0) for lang in LANGUAGES[:-1]] for own in _BY_LANGUAGE.values() for w in own}


def in_training(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF != 0


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @property
    def projection(self) -> np.ndarray:
        """All filters side by side, so that a word is projected once for all its places in windows."""
        return np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)


class Reader:
    """Turns texts into network outputs; keeps the projections of the words seen lately."""

    def __init__(self, network: Network) -> None:
        self.network = network
        # The whole table, projected once: a word's row is then a sum of three rows, whichever words it comes with.
        self.projected = network.table @ network.projection.astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        width = self.projected.shape[1] + len(LANGUAGES) - 1
        self.rows = np.zeros((1, width), np.float32)
        self.used = 1

    def learn(self, words: list[str]) -> None:
        a, b, c = buckets(words).T
        rows = np.zeros((len(words), self.rows.shape[1]), np.float32)
        rows[:, : self.projected.shape[1]] = self.projected[a] + self.projected[b] + self.projected[c]
        for i, w in enumerate(words):
            if w in _VOTES:
                rows[i, self.projected.shape[1] :] = _VOTES[w]
        need = self.used + len(words)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), rows.shape[1]), np.float32)])
        self.rows[self.used : need] = rows
        self.at.update(zip(words, range(self.used, need), strict=True))
        self.used = need

    def outputs(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """The logit and the guessed language of each text."""
        lists = [words_of(t) for t in texts]
        new = set().union(*lists).difference(self.at) if lists else set()
        if new and self.used + len(new) > KNOWN:
            self.clear()
            new = set().union(*lists)
        if new:
            self.learn(list(new))
        logits, languages = np.empty(len(texts)), []
        n_out = self.projected.shape[1]
        for k, words in enumerate(lists):
            best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
            votes = np.zeros(len(LANGUAGES) - 1)
            ids = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            ids = np.concatenate([ids if len(ids) else np.zeros(1, np.int64), np.zeros(max(WIDTHS) - 1, np.int64)])
            step = 200_000
            for a in range(0, len(ids) - max(WIDTHS) + 1, step):  # long texts in overlapping pieces
                rows = self.rows[ids[a : a + step + max(WIDTHS) - 1]]
                n = len(rows) - max(WIDTHS) + 1
                votes += rows[:n, n_out:].sum(axis=0)
                column = 0
                for f, width in enumerate(WIDTHS):
                    total = rows[:n, column : column + FILTERS]
                    for j in range(1, width):
                        total = total + rows[j : j + n, column + j * FILTERS : column + (j + 1) * FILTERS]
                    column += width * FILTERS
                    part = best[f * FILTERS : (f + 1) * FILTERS]
                    np.maximum(part, total.max(axis=0), out=part)
            hidden = np.maximum(best + self.network.bias, 0)
            logits[k] = hidden @ self.network.out + self.network.base
            languages.append(LANGUAGES[int(votes.argmax())] if votes.max(initial=0) > 0 else OTHER)
        return logits, languages

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits, languages = self.outputs(texts)
        moved = logits - np.array([self.network.thresholds.get(x, 0.0) for x in languages])
        return 1 / (1 + np.exp(-np.clip(moved, -60, 60)))


def train(rows: list[tuple[int, str | None, int]], seed: int = 7) -> Network | None:
    """A network for (doc_id, text, label) rows; None unless both labels occur. A sixth of the rows sets thresholds."""
    if len({y for _, _, y in rows}) < 2:
        return None
    rows = sorted(rows, key=lambda r: xxhash.xxh3_64_intdigest(str(r[0])))
    known: dict[str, tuple[int, int, int]] = {}

    def ids_of(text: str | None) -> np.ndarray:
        words = words_of(text) or [""]
        new = sorted(set(words).difference(known))
        known.update(zip(new, map(tuple, buckets(new).tolist()), strict=True))
        return np.array([known[w] for w in words] + [(0, 0, 0)] * (max(WIDTHS) - 1), np.int32)

    keep_out = max(6, round(len(rows) / 6)) if len(rows) >= 60 else 0
    held, taught = rows[:keep_out], rows[keep_out:]
    if len({y for _, _, y in taught}) < 2:
        held, taught = [], rows
    texts, labels = [ids_of(t) for _, t, _ in taught], np.array([y for _, _, y in taught], float)
    rng = np.random.default_rng(seed)
    # The first component starts from how much likelier toxic texts hold a bucket, the others from noise.
    seen = np.zeros((2, BUCKETS))
    for ids, y in zip(texts, labels, strict=True):
        seen[int(y), np.unique(ids)] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    odds = np.log((seen[1] + 0.3) / (n[1] + 0.6)) - np.log((seen[0] + 0.3 * n[0] / n[1]) / (n[0] + 0.6 * n[0] / n[1]))
    table = rng.normal(0, 0.05, (BUCKETS, SIZE))
    table[:, 0] = np.clip(odds, -3, 3) / 3
    table[0] = 0
    filters = [rng.normal(0, 0.1, (w, SIZE, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] += 0.5
    bias, out, base = np.full(len(WIDTHS) * FILTERS, -0.5), np.full(len(WIDTHS) * FILTERS, 0.1), -1.0
    weight = np.where(labels == 1, len(labels) / (2 * n[1]), len(labels) / (2 * n[0]))
    squares = {"table": np.full((BUCKETS, SIZE), 1e-2), "filters": [np.full(f.shape, 1e-2) for f in filters], "bias": np.full(bias.shape, 1e-2), "out": np.full(out.shape, 1e-2), "base": 1e-2}
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            d_filters, d_bias, d_out, d_base = [np.zeros(f.shape) for f in filters], np.zeros(bias.shape), np.zeros(out.shape), 0.0
            rows_at: list[np.ndarray] = []
            rows_by: list[np.ndarray] = []
            for k in order[start : start + BATCH]:
                ids = texts[k]
                x = table[ids].sum(axis=1)
                m = len(x) - max(WIDTHS) + 1
                tops, places = [], []
                for f in filters:
                    a = sum(x[j : j + m] @ f[j] for j in range(len(f)))
                    at = a.argmax(axis=0)
                    places.append(at)
                    tops.append(a[at, np.arange(FILTERS)])
                raw = np.concatenate(tops) + bias
                hidden = np.maximum(raw, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ out + base, -60, 60)))
                d = (p - labels[k]) * weight[k] / BATCH
                d_out += d * hidden
                d_base += d
                d_raw = d * out * (raw > 0)
                d_bias += d_raw
                for f, (w, at) in enumerate(zip(filters, places, strict=True)):
                    g = d_raw[f * FILTERS : (f + 1) * FILTERS]
                    for j in range(len(w)):
                        d_filters[f][j] += x[at + j].T * g
                        rows_at.append(ids[at + j].ravel())
                        rows_by.append(np.repeat((w[j] * g).T, 3, axis=0))
            at, inverse = np.unique(np.concatenate(rows_at), return_inverse=True)
            d_table = np.zeros((len(at), SIZE))
            np.add.at(d_table, inverse, np.concatenate(rows_by))
            d_table[at == 0] = 0
            squares["table"][at] += d_table**2
            table[at] -= RATE * d_table / np.sqrt(squares["table"][at])
            for f in range(len(filters)):
                squares["filters"][f] += d_filters[f] ** 2
                filters[f] -= RATE * d_filters[f] / np.sqrt(squares["filters"][f])
            squares["bias"] += d_bias**2
            bias -= RATE * d_bias / np.sqrt(squares["bias"])
            squares["out"] += d_out**2
            out -= RATE * d_out / np.sqrt(squares["out"])
            squares["base"] += d_base**2
            base -= RATE * d_base / np.sqrt(squares["base"])
    network = Network(table.astype(np.float32), [f.astype(np.float32) for f in filters], bias.astype(np.float32), out.astype(np.float32), float(base))
    calibrate(network, held or taught)
    return network


#: What an error in another language counts when a language's threshold is set; it steadies those with few rows.
OTHERS = 0.25


def calibrate(network: Network, rows: list[tuple[int, str | None, int]]) -> None:
    """Sets each language's threshold where errors, those of other languages counting OTHERS, are fewest."""
    outputs, languages = [], []
    reader = Reader(network)
    for start in range(0, len(rows), 64):
        x, langs = reader.outputs([t for _, t, _ in rows[start : start + 64]])
        outputs += x.tolist()
        languages += langs
    labels = [y for _, _, y in rows]
    for lang in LANGUAGES:
        network.thresholds[lang] = _threshold(outputs, labels, [1.0 if x == lang else OTHERS for x in languages])


def _threshold(outputs: list[float], labels: list[int], weights: list[float]) -> float:
    """The middle of the widest gap between outputs among those with the least weight of errors; 0 without both labels."""
    rows = sorted(zip(outputs, labels, weights, strict=True))
    if len({y for _, y, _ in rows}) < 2:
        return 0.0
    errors = sum(w for _, y, w in rows if not y)
    best = None
    for (x, y, w), (following, _, _) in zip(rows, rows[1:], strict=False):
        errors += w if y else -w
        rank = round(errors, 6), x - following
        if following > x and (best is None or rank < best[0]):
            best = rank, (x + following) / 2
    return best[1] if best else 0.0


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> list[tuple[int, str | None, int]]:
    """At most `rows` labelled rows, none of them held out, chosen by a hash of the id."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT_OF))
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # The chosen ids are bounded by `rows`, so their side of the join can be broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return sorted(((r["doc_id"], r["text"], int(r["toxic"])) for r in found.toLocalIterator()), key=lambda r: (r[0], r[1] or ""))


_READERS: dict[str, Reader] = {}


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; trained on the labelled rows that aren't held out."""
    spark = docs.sparkSession
    network = train(sample(docs, labels, rows))
    shared = spark.sparkContext.broadcast(network)
    token = common.work_folder(spark)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not None and token not in _READERS:
            _READERS.clear()
            _READERS[token] = Reader(shared.value)
        for group in common.groups(batches):
            ids, texts = group.column(0).to_pylist(), group.column(1).to_pylist()
            scores = _READERS[token].scores(texts) if shared.value is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    group.column(0),
                    pa.array([None if i is None else not in_training(i) for i in ids], pa.bool_()),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= 0.5).astype(np.int32), pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, held_out boolean, score double, predicted int")
