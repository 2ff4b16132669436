"""Exact vector top-k, lexical match and cover-density rank, by scans; lexicon and vector_lists hold stored indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: Letters and digits in a row.
TOKEN = r"[\p{L}\p{N}]+"


def vector_topk(chunks: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest rows of chunks(id, ..., embedding) with `distance`, and for cosine `vector_score`; ties by id."""
    q = vectors.vector_literal(query)
    rows = chunks.where(F.col("embedding").isNotNull())
    if metric == "l2":
        scored = rows.withColumn("distance", vectors.l2_distance(F.col("embedding"), q))
    else:
        scored = rows.withColumn("vector_score", vectors.cosine_similarity(F.col("embedding"), q)).withColumn("distance", F.lit(1.0) - F.col("vector_score"))
    return scored.drop("embedding").orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)


def document_topk(chunks: DataFrame, documents: DataFrame, query: list[float], k: int, external_id: str | None = None) -> DataFrame:
    """L2 top-k over chunks joined with their documents, of one document only when external_id is given."""
    docs = documents.select(F.col("id").alias("document_id"), "external_id", "title")
    if external_id:
        docs = docs.where(F.col("external_id") == external_id)
    return vector_topk(chunks.join(docs, "document_id"), query, k, "l2")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def postings(chunks: DataFrame, lexeme=None) -> DataFrame:  # noqa: ANN001
    """(lexeme, id, position) of chunks(id, content); lexeme: a function of the token column that gives null for stop words."""
    rows = chunks.select("id", F.posexplode(tokens(F.col("content"))).alias("position", "token"))
    made = lexeme(F.col("token")) if lexeme else F.col("token")
    return rows.select(made.alias("lexeme"), "id", "position").where(F.col("lexeme").isNotNull())


#: What a stretch without foreign words adds to a score (fixed value of cover density ranks).
COVER = 0.1


def cover_score(found: Column, lexemes: list[str]) -> Column:
    """The score of a chunk from its hits: each minimal stretch that holds all lexemes adds COVER / (1 + foreign words inside).

    After Clarke, Cormack and Tudhope (2000). A stretch ends at a hit; it begins at the earliest of the last hits of each
    lexeme up to there, and of stretches with one beginning only the first to end is minimal. The fold keeps the last
    hit of each lexeme, with how many hits came before it, and the beginning of the stretch that was counted last.
    """
    wanted = sorted(set(lexemes))
    hit = "struct<position:int,nth:int>"
    zero = F.struct(
        F.array_repeat(F.struct(F.lit(-1).alias("position"), F.lit(0).alias("nth")), len(wanted)).cast(f"array<{hit}>").alias("lasts"),
        F.lit(-1).alias("counted"), F.lit(0).alias("nth"), F.lit(0.0).alias("sum"),
    )
    numbers = F.create_map(*[c for i, x in enumerate(wanted) for c in (F.lit(x), F.lit(i))])

    def step(s: Column, h: Column) -> Column:
        now = F.struct(h["position"].cast("int").alias("position"), s["nth"].alias("nth"))
        lasts = F.transform(s["lasts"], lambda old, i: F.when(F.element_at(numbers, h["lexeme"]) == i, now).otherwise(old))

        def counted(start: Column) -> Column:
            foreign = (h["position"] - start["position"]) - (s["nth"] - start["nth"])
            new = (start["position"] >= 0) & (start["position"] != s["counted"])
            return F.struct(
                lasts.alias("lasts"), F.when(new, start["position"]).otherwise(s["counted"]).alias("counted"), (s["nth"] + 1).alias("nth"),
                (s["sum"] + F.when(new, F.lit(COVER) / (F.lit(1) + foreign)).otherwise(F.lit(0.0))).alias("sum"),
            )

        return F.element_at(F.transform(F.array(F.array_min(lasts)), counted), 1)

    return F.aggregate(found, zero, step, lambda s: s["sum"])


def lexical_match(chunks: DataFrame, lexemes: list[str], lexeme=None) -> DataFrame:  # noqa: ANN001
    """(id, hits) of chunks(id, content) that hold all lexemes, hits as structs (position, lexeme) in order; none for a query without lexemes.

    Other tokens are dropped where they are made, so only hits are shuffled. Rows are told apart by a number, as ids may repeat.
    """
    wanted = sorted(set(lexemes))
    rows = chunks if wanted else chunks.where(F.lit(False))
    numbered = rows.select("id", "content").withColumn("row", F.monotonically_increasing_id())
    exploded = numbered.select("row", "id", F.posexplode(tokens(F.col("content"))).alias("position", "token"))
    made = lexeme(F.col("token")) if lexeme else F.col("token")
    found = exploded.select("row", "id", "position", made.alias("lexeme")).where(F.col("lexeme").isin(wanted))
    grouped = found.groupBy("row", "id").agg(F.sort_array(F.collect_list(F.struct("position", "lexeme"))).alias("hits"))
    return grouped.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["lexeme"]))) == len(wanted)).select("id", "hits")


def cover_density(matched: DataFrame, lexemes: list[str]) -> DataFrame:
    """(id, lexical_score) of matched chunks."""
    return matched.select("id", cover_score(F.col("hits"), lexemes or [""]).alias("lexical_score"))


def lexical_topk(chunks: DataFrame, query: list[str], k: int, lexeme=None) -> DataFrame:  # noqa: ANN001
    """The k best rows (id, lexical_score) of chunks(id, content) for a query's lexemes; ties by id. One scan; lexicon.Lexicon reads less."""
    ranked = cover_density(lexical_match(chunks, query, lexeme), query)
    return ranked.orderBy(F.col("lexical_score").desc(), "id").limit(k)
