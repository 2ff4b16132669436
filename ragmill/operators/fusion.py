"""Union of vector and lexical hits, scores, model scores, and the final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combine(vector_hits: DataFrame, lexical_hits: DataFrame) -> DataFrame:
    """Full outer merge by id: what both have comes from the vector row, metadata from the other only where it is empty."""
    shared = [c for c in vector_hits.columns if c in lexical_hits.columns and c != "id"]
    left = vector_hits.select("id", *[F.col(c).alias(f"v_{c}") for c in vector_hits.columns if c != "id"])
    right = lexical_hits.select("id", *[F.col(c).alias(f"l_{c}") for c in lexical_hits.columns if c != "id"])
    joined = left.join(right, "id", "full_outer")
    out = []
    for c in dict.fromkeys([*vector_hits.columns, *lexical_hits.columns]):
        if c == "id":
            out.append(F.col("id"))
        elif c == "metadata" and c in shared:
            out.append(F.when(F.size(F.coalesce("v_metadata", F.create_map())) > 0, F.col("v_metadata")).otherwise(F.col("l_metadata")).alias(c))
        elif c in shared:
            out.append(F.coalesce(f"v_{c}", f"l_{c}").alias(c))
        else:
            out.append(F.col(f"v_{c}" if c in vector_hits.columns else f"l_{c}").alias(c))
    return joined.select(*out)


def fallback_scores(candidates: DataFrame, vector_weight: float = 0.6, lexical_weight: float = 0.4) -> DataFrame:
    """rerank_score from both scores, each over its maximum; a missing score is 0 and a maximum of 0 gives no part.

    A negative maximum divides as any other, so it turns the order round; results follow that on purpose.
    """
    top = candidates.agg(
        F.max(F.coalesce("vector_score", F.lit(0.0))).alias("max_v"), F.max(F.coalesce("lexical_score", F.lit(0.0))).alias("max_l")
    )
    part = lambda score, top: F.when(F.col(top) != 0, F.coalesce(score, F.lit(0.0)) / F.col(top)).otherwise(F.lit(0.0))
    score = F.lit(vector_weight) * part("vector_score", "max_v") + F.lit(lexical_weight) * part("lexical_score", "max_l")
    return candidates.join(F.broadcast(top)).withColumn("rerank_score", score).drop("max_v", "max_l")  # one row


def reciprocal_rank_fusion(vector_hits: DataFrame, lexical_hits: DataFrame, constant: int = 60) -> DataFrame:
    """(id, rrf_score): a named extra; hits carry `rank` from 0."""
    both = vector_hits.select("id", "rank").unionByName(lexical_hits.select("id", "rank"))
    return both.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(constant + 1) + F.col("rank"))).alias("rrf_score"))


def apply_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates with rerank_score from scores(id, score); null where the model gave none."""
    return candidates.join(scores.select("id", F.col("score").alias("rerank_score")), "id", "left")


def ranked(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """`rank` from 0: scored rows by score, then unscored ones by the sum of their scores; ties by id; the first n."""
    other = F.coalesce("vector_score", F.lit(0.0)) + F.coalesce("lexical_score", F.lit(0.0))
    order = [F.col("rerank_score").isNull(), F.col("rerank_score").desc(), F.when(F.col("rerank_score").isNull(), other).desc(), F.col("id")]
    # The limit comes first, so that the window sees n rows.
    top = candidates.orderBy(*order).limit(n) if n is not None else candidates
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def parse_scores(output: Column) -> Column:
    """array<struct<id, score>> of a model's JSON: see the cases below; entries that don't fit are left out, the last of an id wins.

    An object with a list under ranking, rankings or scores (the first that isn't empty); an object with id and
    score; an object of id: score; a list. Anything else gives no scores.
    """
    v = F.try_parse_json(output)
    get = lambda path: F.try_variant_get(v, path, "variant")
    is_list = lambda x: F.schema_of_variant(x).startswith("ARRAY")
    truthy = lambda x: F.when(~F.schema_of_variant(x).isin("VOID") & ~F.to_json(x).isin("[]", "{}", '""', "0", "false", "null", "0.0"), x)
    ranking = F.coalesce(truthy(get("$.ranking")), truthy(get("$.rankings")), truthy(get("$.scores")))
    entries = F.try_variant_get(ranking, "$", "array<variant>")
    kind = F.schema_of_variant(v)
    one = F.when(get("$.id").isNotNull() & get("$.score").isNotNull(), F.array(v))
    pairs = F.try_variant_get(v, "$", "map<string,string>")
    mapped = F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].try_cast("bigint").alias("id"), e["value"].try_cast("double").alias("score")))
    of_list = lambda xs: F.transform(
        xs, lambda x: F.struct(F.try_variant_get(x, "$.id", "bigint").alias("id"), F.try_variant_get(x, "$.score", "double").alias("score"))
    )
    nothing = F.array().cast("array<struct<id:bigint,score:double>>")
    found = (
        F.when(is_list(v), of_list(F.try_variant_get(v, "$", "array<variant>")))
        .when(ranking.isNull() & one.isNotNull(), of_list(one))
        .when(is_list(ranking), of_list(entries))
        .when(kind.startswith("OBJECT"), mapped)
        .otherwise(nothing)
    )
    fit = F.filter(F.coalesce(found, nothing), lambda x: x["id"].isNotNull() & x["score"].isNotNull())
    return F.filter(fit, lambda x, i: ~F.exists(F.slice(fit, i + 2, F.greatest(F.size(fit), F.lit(1))), lambda y: y["id"] == x["id"]))
