"""From a question to a ranked list, its pages and figures, a context and a payload."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stem
from ..operators import context, fusion, search
from ..sources.tables import Settings
from . import embeddings
from .providers import NO_ANSWER, NOTHING_FOUND, Answerer, Embedder, NoReranker, OfflineAnswerer, Reranker, rerank


def hybrid(chunks: DataFrame, vectors: DataFrame, vector: list[float], lexemes: list[str], settings: Settings = Settings()) -> DataFrame:
    """Vector top-k and lexical top-k merged, scored and cut: (id, vector_score, lexical_score, rerank_score, rank).

    chunks(id, content); vectors(id, embedding). One plan: both top-k are taken before the merge.
    """
    near = search.vector_topk(vectors, vector, settings.vector_k).select("id", "vector_score")
    lexical = search.lexical_topk(chunks.select("id", "content"), lexemes, settings.lexical_k)
    return fusion.ranked(fusion.fallback_scores(fusion.combine(near, lexical)), settings.top_k)


@dataclass
class Retriever:
    """The stored tables with the models that read them; english: match stems and skip stop words."""

    chunks: DataFrame
    pages: DataFrame
    figures: DataFrame
    embedder: Embedder
    reranker: Reranker = NoReranker()
    answerer: Answerer = OfflineAnswerer()
    settings: Settings = Settings()
    english: bool = False

    def search(self, question: str) -> DataFrame:
        if not question.strip():
            raise ValueError("the question is blank")
        near = search.vector_topk(self.chunks.select("id", "embedding"), self.embedder.one(question), self.settings.vector_k).select("id", "vector_score")
        lexemes = stem.query_lexemes(question) if self.english else re.findall(r"[^\W_]+", question.lower())
        lexical = search.lexical_topk(self.chunks.select("id", "content"), lexemes, self.settings.lexical_k, stem.english_lexeme if self.english else None)
        found = fusion.combine(near, lexical)
        candidates = found.join(self.chunks.drop("embedding"), "id")
        return rerank(candidates, question, self.reranker, self.settings.top_k)

    def answer(self, question: str) -> DataFrame:
        """One row of JSON. The top chunks, top_k at most, come to the driver once: pages, figures and context all start from them."""
        found = self.search(question)
        top = found.sparkSession.createDataFrame(found.collect(), found.schema)
        pages = context.pages_for_chunks(top, self.pages)
        figures = context.figures_for_chunks(top, self.figures)
        return context.payload(top, pages, figures, answered(context.context(top, self.settings.context_chars), question, self.answerer))


def answered(context_rows: DataFrame, question: str, answerer: Answerer) -> str:
    """The model's answer; a fixed text where the context is empty or the model fails."""
    prompt = context.answer_prompt(context_rows.where("context <> ''"), question).first()
    if prompt is None:
        return NOTHING_FOUND
    try:
        return answerer.answer(prompt["prompt"]).strip()
    except Exception:  # whatever a model's client raises; what was found is still shown
        return NO_ANSWER


def document_context(chunks: DataFrame, documents: DataFrame, vector: list[float], settings: Settings = Settings(), external_id: str | None = None) -> DataFrame:
    """One row: the context of a question from the command line, by L2 distance, of one document only where external_id is given."""
    top = search.document_topk(chunks, documents, vector, settings.top_k, external_id)
    return context.context(top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")) - 1), settings.context_chars, "cli")


def document_answer(
    question: str, chunks: DataFrame, documents: DataFrame, embedder: Embedder, answerer: Answerer = OfflineAnswerer(), settings: Settings = Settings(), external_id: str | None = None
) -> str:
    """The answer to a question from the command line."""
    if not question.strip():
        raise ValueError("the question is blank")
    return answered(document_context(chunks, documents, embedder.one(question), settings, external_id), question, answerer)


def backfill(
    chunks: DataFrame, embedder: Embedder, headers: list[str] = (), footers: list[str] = (), missing_only: bool = True, folder: str | None = None, settings: Settings = Settings()
) -> DataFrame:
    """Chunks cleaned, tracked and embedded: (id, embedding, content, metadata, model). State runs over all chunks of a document.

    folder: where finished vectors are kept (see plans.embeddings); a run after one that failed embeds the rest only.
    """
    from ..operators import cleaning, store, structure

    rows = store.documents_to_update(chunks, missing_only).drop("needs_update", "order_index")
    cleaned = cleaning.clean_chunks(rows, list(headers), list(footers))
    tracked = structure.with_structure(cleaned, missing_only)
    return embeddings.embedded(tracked.select("id", "content", "metadata"), embedder, folder, settings.batch_size).select("id", "embedding", "content", "metadata", "model")
