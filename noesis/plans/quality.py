"""Queries on the quality of the store's tables: orphan references and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noesis.operators import packed, references
from noesis.sources.tables import load


def _sides(spark: SparkSession, base: str):
    """(references, targets, removed ids) of note references and of entity references."""
    nodes = load(spark, base, "nodes", "id", "timestamp")
    entities = load(spark, base, "entities", "id")
    gone = load(spark, base, "removed_records", "table_name", "record_id")
    of = lambda t: gone.filter(F.col("table_name") == t).select(F.col("record_id").alias("ref_id"))
    note_refs = references.edge_references(load(spark, base, "edges", "source_id", "target_id", "edge_type", "created_at")).unionByName(
        references.log_references(load(spark, base, "contradiction_log", "id", "older_node_id", "created_at"))
    )
    links = references.link_references(load(spark, base, "node_entities", "node_id", "entity_id"), nodes)
    yield note_refs, nodes.select("id", F.col("timestamp").alias("at")), of("nodes")
    yield links, entities.select("id", F.lit(None).cast("timestamp").alias("at")), of("entities")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    notes, entities = (references.orphans(*side) for side in _sides(spark, base))
    return notes.unionByName(entities)


def p2_report(spark: SparkSession, base: str) -> DataFrame:
    """Orphan references per table, field, period and reason."""
    notes, entities = (references.orphan_counts(*side) for side in _sides(spark, base))
    return notes.unionByName(entities)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return packed.explode_packed(load(spark, base, "nodes", "id", "tags"), "id", "tags").withColumnRenamed("id", "node_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p5_found)}

_ORPHANS = """
    e AS (SELECT source_id, target_id, edge_type, min(created_at) AS created_at FROM edges GROUP BY ALL),
    r AS (SELECT 'edges' AS ref_table, 'source_id' AS ref_field, concat_ws('|', source_id, target_id, edge_type) AS row_key, source_id AS ref_id, created_at, created_at AS moment, 'nodes' AS t FROM e
          UNION ALL SELECT 'edges', 'target_id', concat_ws('|', source_id, target_id, edge_type), target_id, created_at, created_at, 'nodes' FROM e
          UNION ALL SELECT DISTINCT 'contradiction_log', 'older_node_id', id::VARCHAR, older_node_id, created_at, created_at, 'nodes' FROM contradiction_log
          UNION ALL SELECT 'node_entities', 'entity_id', concat_ws('|', node_id, entity_id), entity_id, NULL, n.timestamp, 'entities'
                    FROM (SELECT DISTINCT node_id, entity_id FROM node_entities) l LEFT JOIN nodes n ON n.id = l.node_id),
    known AS (SELECT 'nodes' AS t, id, timestamp AS since FROM nodes UNION ALL SELECT 'entities', id, NULL FROM entities),
    gone AS (SELECT DISTINCT table_name AS t, record_id FROM removed_records),
    o AS (SELECT ref_table, ref_field, row_key, ref_id, coalesce(strftime(moment, '%Y-%m'), 'none') AS period,
            CASE WHEN k.id IS NULL AND g.record_id IS NOT NULL THEN 'deleted' WHEN k.id IS NULL THEN 'missing' WHEN created_at < k.since THEN 'late' END AS reason
          FROM r LEFT JOIN known k ON k.t = r.t AND k.id = r.ref_id LEFT JOIN gone g ON g.t = r.t AND g.record_id = r.ref_id WHERE ref_id IS NOT NULL)"""

SQL = {
    "p2_found": f"WITH {_ORPHANS} SELECT * FROM o WHERE reason IS NOT NULL",
    "p2_report": f"WITH {_ORPHANS} SELECT ref_table, ref_field, period, reason, count(*) AS orphans FROM o WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": r"""WITH f AS (SELECT id, tags, regexp_matches(regexp_replace(tags, '"(?:[^"]|"")*"', '', 'g'), '[,;|\t\n\r]') AS sep FROM nodes WHERE tags IS NOT NULL),
        l AS (SELECT id, CASE WHEN tags LIKE '[%' THEN from_json(tags, '["VARCHAR"]')
                 WHEN sep THEN regexp_extract_all(tags, '[ ]*"(?:[^"]|"")*"[ ]*|[^,;|\t\n\r]+') ELSE regexp_extract_all(tags, '"(?:[^"]|"")*"|[^ ]+') END AS parts,
                 tags LIKE '[%' AS js FROM f),
        u AS (SELECT id, js, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM l),
        v AS (SELECT id, i, trim(CASE WHEN NOT js AND trim(x) LIKE '"%"' AND length(trim(x)) > 1 THEN replace(trim(x)[2:-2], '""', '"') ELSE x END) AS tag FROM u)
        SELECT id AS node_id, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INTEGER AS pos, tag FROM v WHERE tag <> ''""",
}
