"""One query per operator, over the whole of its table, with the SQL that checks it where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_trie, contamination, filter_audit, jaccard, licences, lines, lloyd, passages, pii, quality, rule_ensemble, token_counts, toxicity
from .common import read

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The query runs over test tables; real ones take a secret key.
TEST_KEY = b"test key of the registered query"
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_decode(read(spark, sf_dir, "documents"), WORD_VOCABULARY, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), TEST_KEY)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(read(spark, sf_dir, "documents"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(read(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_bpe_trie": op4_bpe_trie,
    "op5_licence_scan": op5_licence_scan,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_passage_dedup": op10_passage_dedup,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_filter_audit": op13_filter_audit,
}


def _lloyd_sql() -> str:
    """The rounds one after the other, each a full assignment."""
    parts = [
        """kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "xs AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept)",
        """c0 AS MATERIALIZED (
            SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p
            FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 40))""",
    ]
    for r in range(6):
        parts.append(
            f"""a{r} AS MATERIALIZED (
            SELECT vec_id, c, d FROM (SELECT vec_id, c, sum((xs.x - m.x) * (xs.x - m.x)) AS d FROM xs JOIN c{r} m USING (p) GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        )
        if r < 5:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
            SELECT c, p, CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x
            FROM c{r} m LEFT JOIN (SELECT c, p, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN xs USING (vec_id) GROUP BY ALL) USING (c, p))"""
            )
    parts.append("digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c5 GROUP BY c)")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               centroid_sha256 FROM a5 JOIN digests USING (c)"""


#: Networks, expectation-maximisation, merges, Dice stretches, permutations and rule ensembles have no SQL; sets, lines, windows, rounds and counts have.
ORACLES: dict[str, str] = {
    "op9_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p
            FROM documents),
        firsts AS (SELECT line, min((doc_id, p)) AS place FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
        lengthy AS (SELECT line, place, length(line) AS n FROM firsts WHERE length(line) >= 40),
        near AS (
            SELECT DISTINCT a.line FROM lengthy a JOIN lengthy b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND b.place < a.place
            WHERE (left(a.line, a.n // 3) = left(b.line, a.n // 3) OR right(a.line, a.n // 3) = right(b.line, a.n // 3)
                   OR contains(b.line, substr(a.line, a.n // 3 + 1, a.n // 3)))
              AND levenshtein(a.line, b.line) <= 2),
        kept AS (
            SELECT l.doc_id, l.p, l.line FROM l LEFT JOIN firsts USING (line) LEFT JOIN near ON near.line = l.line
            WHERE firsts.place IS NULL OR (near.line IS NULL AND firsts.place = (l.doc_id, l.p))),
        joined AS (SELECT doc_id, count(*) AS k, string_agg(line, chr(10) ORDER BY p) AS text FROM kept GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
               CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k, 0) END AS n_removed,
               CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(joined.text, '') END AS text
        FROM documents d LEFT JOIN joined USING (doc_id)
    """,
    "op3_decontamination": r"""
        WITH docs AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        items AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
               FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
        its AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
                FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items)),
        sizes AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item_shingles, count(*)::DOUBLE / any_value(n) AS containment
        FROM ds JOIN its USING (s) JOIN sizes USING (item_id)
        GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n)
    """,
    "op8_jaccard_join": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 75 * (m.n + n.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM t LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
    """,
    "op10_passage_dedup": r"""
        WITH t AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS x
                    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
        again AS (SELECT x FROM windows GROUP BY x HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM windows JOIN again USING (x)),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM t),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS k FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
        counts AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM t LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op12_centroid_clustering": _lloyd_sql(),
    "op13_filter_audit": r"""
        WITH w AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        f AS (
            SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY sha256(t)), false) AS e FROM w),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        cells AS (
            SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
            FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
            WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        steps AS (
            SELECT cells.*, filter_order, step::INT AS step, filter_order[step] AS filter,
                   [a, b, c, d, e] AS fails, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS before
            FROM cells, orders, range(1, 6) s(step)),
        judged AS (
            SELECT *, fails[ascii(filter) - 64] AS failed, len(list_filter(before, lambda i: fails[i])) > 0 AS gone,
                   len(list_filter(fails, lambda z: z)) = 1 AS once FROM steps),
        sums AS (
            SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (NOT gone AND failed), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND failed), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (failed AND once), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (NOT gone AND failed), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (NOT gone AND failed), 0)::BIGINT AS toxic_lost
            FROM judged GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM sums
    """,
}
