"""Models as plug-ins: embedding, reranking, answering; with deterministic offline stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import context, fusion

NO_ANSWER = "No answer could be made from the documents."
NOTHING_FOUND = "Nothing in the documents matches the question."


class Embedder(Protocol):
    model: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text; raises where the model can't be reached."""

    def one(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    def scores(self, candidates: DataFrame, query: str) -> DataFrame | None:
        """(id, score), or None where no model is there or its output can't be read."""


class Answerer(Protocol):
    def answer(self, prompt: str) -> str: ...


class OfflineEmbedder:
    """Unit vectors from a hash of the text: repeatable, without meaning."""

    model = "offline-sha256"

    def __init__(self, dimension: int = vectors.DIMENSION) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [vectors.embed_offline(t, self.dimension) for t in texts]

    def one(self, text: str) -> list[float]:
        return vectors.embed_offline(text, self.dimension)


class Chain:
    """Embedders of one dimension in order: the next is asked where one fails `tries` times."""

    def __init__(self, embedders: list[Embedder], tries: int = 2) -> None:
        if not embedders or len({e.dimension for e in embedders}) > 1:
            raise ValueError("a chain needs embedders of one dimension")
        self.embedders, self.tries, self.dimension, self.model = embedders, tries, embedders[0].dimension, embedders[0].model

    def named(self, texts: list[str]) -> tuple[str, list[list[float]]]:
        """The model that answered, and its vectors; the last failure where none did."""
        failure: Exception | None = None
        for embedder in self.embedders:
            for _ in range(self.tries):
                try:
                    made = embedder.embed(texts)
                except Exception as error:  # whatever a model's client raises
                    failure = error
                    continue
                if len(made) != len(texts) or any(len(v) != self.dimension for v in made):
                    raise ValueError(f"{embedder.model} gave vectors of another number or length")
                return embedder.model, made
        raise failure

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.named(texts)[1]

    def one(self, text: str) -> list[float]:
        return self.embed([text])[0]


class NoReranker:
    def scores(self, candidates: DataFrame, query: str) -> DataFrame | None:  # noqa: ARG002
        return None


class ModelReranker:
    """Scores by a model that is called with a prompt and gives JSON. A RuntimeError says that there is no model and is passed on; other failures give no scores."""

    def __init__(self, call: Callable[[str], str]) -> None:
        self.call = call

    def scores(self, candidates: DataFrame, query: str) -> DataFrame | None:
        prompt = context.rerank_prompt(candidates, query).first()["prompt"]
        try:
            said = self.call(prompt)
        except RuntimeError:
            raise
        except Exception:  # whatever a model's client raises
            return None
        output = candidates.sparkSession.createDataFrame([(said,)], "said string")
        found = output.select(F.explode(fusion.parse_scores(F.col("said"))).alias("s")).select("s.id", "s.score").collect()
        return candidates.sparkSession.createDataFrame(found, "id long, score double") if found else None


class OfflineAnswerer:
    def answer(self, prompt: str) -> str:  # noqa: ARG002
        return NO_ANSWER


def rerank(candidates: DataFrame, query: str, reranker: Reranker, n: int) -> DataFrame:
    """The first n candidates by the model's scores, or by the weighted sum where it gives none."""
    scores = reranker.scores(candidates, query)
    if scores is not None:  # scores of no candidate are none
        scores = scores.join(candidates.select("id"), "id", "left_semi")
        scores = scores if scores.limit(1).count() else None
    scored = fusion.fallback_scores(candidates) if scores is None else fusion.apply_scores(candidates, scores)
    return fusion.ranked(scored, n)


def providers(environment: Mapping[str, str], makers: Mapping[str, Callable[[Mapping[str, str]], object]]) -> dict[str, object]:
    """The embedder, reranker and answerer that the environment names (EMBEDDER, RERANKER, ANSWERER), made by `makers`.

    What it doesn't name is the offline one; a reranker that has no key (its maker raises KeyError) is none, so scores
    are weighted sums; an embedder or answerer without one is an error, as nothing can take its place unasked.
    """
    offline = {"embedder": OfflineEmbedder, "reranker": NoReranker, "answerer": OfflineAnswerer}
    out: dict[str, object] = {}
    for role, stand_in in offline.items():
        name = environment.get(role.upper())
        if name is None:
            out[role] = stand_in()
            continue
        if name not in makers:
            raise ValueError(f"no provider is called {name}")
        try:
            out[role] = makers[name](environment)
        except KeyError as missing:
            if role != "reranker":
                raise RuntimeError(f"the {role} {name} lacks {missing.args[0]}") from missing
            out[role] = stand_in()
    return out
