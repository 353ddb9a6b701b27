"""Queries p1, p3, p4 and p6 to p10 over the store's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noesis.llm import byte_language, corpus_tokens, eval_leaks, name_variants, near_duplicates, nearest_vectors, personal_data, term_weights
from noesis.sources.tables import load

#: Cells that a query of ``p6_nearest`` asks, and candidates of each that are ranked exactly; measured, see the README.
PROBE, RERANKED = 48, 256


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    pairs = near_duplicates.near_duplicates(load(spark, base, "nodes", "id", "content"), "id", "content", threshold=0.6, width=3)
    return pairs.select(F.col("a").alias("node_a"), F.col("b").alias("node_b")).distinct()


def p1_near_five_words(spark: SparkSession, base: str) -> DataFrame:
    """Near duplicates at the general setting: five words, similarity 0.8."""
    pairs = near_duplicates.near_duplicates(load(spark, base, "nodes", "id", "content"), "id", "content")
    return pairs.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.round("similarity", 6).alias("similarity")).distinct()


def p1_copy_classes(spark: SparkSession, base: str) -> DataFrame:
    """Notes with the same set of five-word sequences as another: their class and its size."""
    return near_duplicates.duplicate_classes(load(spark, base, "nodes", "id", "content"), "id", "content").filter("members > 1")


def p1_note_classes(spark: SparkSession, base: str) -> DataFrame:
    """Every note under the rule of ``p1_found``: its class of equal sets, the members of it, and its number of links."""
    return near_duplicates.linked_classes(load(spark, base, "nodes", "id", "content"), "id", "content", threshold=0.6, width=3)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    notes = term_weights.distinctive_note_terms(load(spark, base, "nodes", "id", "content"))
    summaries = term_weights.distinctive_summary_terms(load(spark, base, "cluster_summaries", "id", "top_terms"))
    row = lambda df, table: df.select(F.lit(table).alias("ref_table"), "record_id", "term")
    return row(notes, "nodes").unionByName(row(summaries, "cluster_summaries"))


def p3_summary_scores(spark: SparkSession, base: str) -> DataFrame:
    """Residual inverse document frequency of every term of every cluster summary."""
    w = term_weights.term_weights(load(spark, base, "cluster_summaries", "id", "top_terms"), "id", "top_terms")
    return w.select("record_id", "term", "tf", "df", "cf", F.round("ridf", 4).alias("ridf"), F.round("score", 4).alias("score"))


def p3_note_scores(spark: SparkSession, base: str) -> DataFrame:
    """Residual inverse document frequency of every term of every note."""
    w = term_weights.term_weights(load(spark, base, "nodes", "id", "content"), "id", "content")
    return w.select("record_id", "term", "tf", "df", "cf", F.round("ridf", 4).alias("ridf"), F.round("score", 4).alias("score"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    out = byte_language.label_repairs(load(spark, base, "nodes", "id", "content"), load(spark, base, "note_langs", "node_id", "lang_label"))
    return out.select("node_id", "segment_no", "lang")


def p4_segments(spark: SparkSession, base: str) -> DataFrame:
    """The stretches of ``p4_found`` with the confidence of their language and what the note's label names."""
    out = byte_language.label_repairs(load(spark, base, "nodes", "id", "content"), load(spark, base, "note_langs", "node_id", "lang_label"))
    return out.select("node_id", "segment_no", "lang", F.round("confidence", 6).alias("confidence"), "given")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    near = nearest_vectors.nearest_vectors(load(spark, base, "nodes", "id", "embedding"), "id", "embedding", k=5, dim=128, least=0.8)
    return near.select(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b")).distinct()


def p6_nearest(spark: SparkSession, base: str) -> DataFrame:
    """The five nearest of every note whose id is divisible by 100, at any cosine, against all notes."""
    near = nearest_vectors.nearest_vectors(load(spark, base, "nodes", "id", "embedding"), "id", "embedding", k=5, dim=128, least=-1.0, asking=F.col("id") % 100 == 0, probe=PROBE, rerank=RERANKED)
    return near.select(F.col("a").alias("node_id"), F.col("b").alias("near_id"), "place", F.round("cosine", 4).alias("cosine"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    pairs = name_variants.name_variants(load(spark, base, "entities", "id", "name", "entity_type"), "id", "name", "entity_type")
    return pairs.select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"))


def p7_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Every entity whose name can be read, and the smallest id of those that mean the same."""
    return name_variants.name_clusters(load(spark, base, "entities", "id", "name", "entity_type"), "id", "name", "entity_type")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return corpus_tokens.encode_corpus(load(spark, base, "documents", "doc_id", "text"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Documents after encoding and decoding: the texts themselves, null as empty."""
    ids = corpus_tokens.encode_corpus(load(spark, base, "documents", "doc_id", "text"), "doc_id", "text")
    return corpus_tokens.decode_corpus(ids, "doc_id", "ids")


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    return eval_leaks.eval_leaks(load(spark, base, "documents", "doc_id", "text"), load(spark, base, "eval_items", "item_id", "text"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return _leaks(spark, base).select("doc_id", "item_id").distinct()


def p9_longest(spark: SparkSession, base: str) -> DataFrame:
    """The longest verbatim passage of each document and item, with its place in both."""
    return _leaks(spark, base)


def p9_clean(spark: SparkSession, base: str) -> DataFrame:
    """Ids of the documents that give no item away."""
    return eval_leaks.without_leaks(load(spark, base, "documents", "doc_id"), _leaks(spark, base))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    found = personal_data.personal_data(load(spark, base, "documents", "doc_id", "text"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "pii_type", "pii_text")


def p10_redacted(spark: SparkSession, base: str) -> DataFrame:
    """Every document with placeholders in place of personal data."""
    clean = personal_data.redact(load(spark, base, "documents", "doc_id", "text"), "doc_id", "text")
    return clean.select(F.col("id").alias("doc_id"), F.col("clean").alias("text"), F.size("found").alias("places"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_near_five_words, p1_copy_classes, p1_note_classes, p3_found, p3_summary_scores, p3_note_scores, p4_found, p4_segments, p6_found, p6_nearest, p7_found, p7_clusters, p8_ids, p8_round_trip, p9_found, p9_longest, p9_clean, p10_found, p10_redacted
    )
}

_SHINGLES = """
    words AS (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM nodes),
    sets AS (SELECT DISTINCT id, array_to_string(w[i:i+{last}], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - {last} + 1)) AS i FROM words WHERE len(w) > {last})),
    sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
    met AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
    sim AS (SELECT a, b, c / (p.n + q.n - c)::DOUBLE AS j FROM met JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b)"""

_TERM_STATS = """
    terms_{t} AS (SELECT id, regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{3,}}') AS w FROM {t}),
    kept_{t} AS (SELECT id, w, len(w) AS length FROM terms_{t} WHERE len(w) > 0),
    per_{t} AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, length, unnest(w) AS term FROM kept_{t}) GROUP BY 1, 2, 3),
    stat_{t} AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM per_{t} GROUP BY 1),
    n_{t} AS (SELECT count(*) AS n FROM kept_{t}),
    w_{t} AS (SELECT id, term, tf, length, df, cf, n, ln((n + 1) / (df + 1)) / ln(n + 1) AS rarity FROM per_{t} JOIN stat_{t} USING (term) CROSS JOIN n_{t})"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_SHINGLES.format(last=2)} SELECT a AS node_a, b AS node_b FROM sim WHERE j >= 0.6",
    "p1_near_five_words": f"WITH {_SHINGLES.format(last=4)} SELECT a AS node_a, b AS node_b, round(j, 6) AS similarity FROM sim WHERE j >= 0.8",
    "p1_copy_classes": f"""WITH {_SHINGLES.format(last=4)}, keyed AS (SELECT id, list_sort(list(s)) AS k FROM sets GROUP BY id), first AS (SELECT k, min(id) AS class_id, count(*) AS members FROM keyed GROUP BY k)
        SELECT id, class_id, members FROM keyed JOIN first USING (k) WHERE members > 1""",
    "p1_note_classes": f"""WITH {_SHINGLES.format(last=2)}, keyed AS (SELECT id, list_sort(list(s)) AS k FROM sets GROUP BY id), first AS (SELECT k, min(id) AS class_id, count(*) AS members FROM keyed GROUP BY k),
        ends AS (SELECT a AS id FROM sim WHERE j >= 0.6 UNION ALL SELECT b FROM sim WHERE j >= 0.6), degree AS (SELECT id, count(*) AS links FROM ends GROUP BY id)
        SELECT id, class_id, members, coalesce(links, 0)::BIGINT AS links FROM keyed JOIN first USING (k) LEFT JOIN degree USING (id)""",
    "p3_found": f"""WITH {_TERM_STATS.format(t="nodes", c="content")}, {_TERM_STATS.format(t="cluster_summaries", c="top_terms")}
        SELECT 'nodes' AS ref_table, id AS record_id, term FROM w_nodes WHERE length >= 20 AND tf / length * rarity >= 0.06
        UNION ALL SELECT 'cluster_summaries', id, term FROM w_cluster_summaries WHERE rarity >= 0.75""",
    "p3_summary_scores": f"""WITH {_TERM_STATS.format(t="cluster_summaries", c="top_terms")}
        SELECT id AS record_id, term, tf, df, cf::BIGINT AS cf, round(log2(n / df) + log2(1 - exp(-cf / n)), 4) AS ridf,
               round((log2(n / df) + log2(1 - exp(-cf / n))) * tf, 4) AS score FROM w_cluster_summaries""",
    "p3_note_scores": f"""WITH {_TERM_STATS.format(t="nodes", c="content")}
        SELECT id AS record_id, term, tf, df, cf::BIGINT AS cf, round(log2(n / df) + log2(1 - exp(-cf / n)), 4) AS ridf,
               round((log2(n / df) + log2(1 - exp(-cf / n))) * tf, 4) AS score FROM w_nodes""",
    "p6_found": """WITH good AS (
          SELECT id, [x::DOUBLE FOR x IN embedding] AS v FROM nodes
          WHERE len(embedding) = 128 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
        unit AS (SELECT id, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v]::DOUBLE[128] AS v FROM good),
        ranked AS (SELECT a.id AS a, b.id AS b, array_inner_product(a.v, b.v) AS c,
                     row_number() OVER (PARTITION BY a.id ORDER BY array_inner_product(a.v, b.v) DESC, b.id) AS r FROM unit a JOIN unit b ON a.id <> b.id)
        SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM ranked WHERE r <= 5 AND c >= 0.8""",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+9], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10)),
        eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM e WHERE len(w) >= 10))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (s)""",
    "p9_clean": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+9], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10)),
        eg AS (SELECT DISTINCT array_to_string(w[i:i+9], ' ') AS s FROM (SELECT w, unnest(range(1, len(w) - 8)) AS i FROM e WHERE len(w) >= 10))
        SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dg JOIN eg USING (s))""",
}
