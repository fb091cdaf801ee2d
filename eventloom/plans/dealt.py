"""Queries of the general data-pipeline operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.operators import dedupe, patches
from eventloom.plans.state import items_sql


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of an event in the feed but its first delivery."""
    return dedupe.repeated_deliveries(spark.read.parquet(f"{sf_dir}/session_events.parquet")).select("delivery_seq")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that every store holds at the end of its log."""
    return patches.current_items(spark.read.parquet(f"{sf_dir}/patches.parquet"))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found}
SQL = {
    "p2_found": """
        WITH RECURSIVE keyed AS (
            SELECT delivery_seq AS s, lower(trim(id, ' ' || chr(9) || chr(10) || chr(13))) AS i, session_id AS e,
                   nullif(dedupe_hash, '') AS h
            FROM session_events
        ), firsts AS (
            SELECT s, min(s) OVER (PARTITION BY i) AS a FROM keyed WHERE i IS NOT NULL
            UNION
            SELECT s, min(s) OVER (PARTITION BY e, h) FROM keyed WHERE e IS NOT NULL AND h IS NOT NULL
        ), links AS (
            SELECT s AS a, a AS b FROM firsts WHERE s <> a UNION SELECT a, s FROM firsts WHERE s <> a
        ), reach AS (
            SELECT DISTINCT a AS s, a AS t FROM links
            UNION
            SELECT r.s, l.b FROM reach r JOIN links l ON l.a = r.t
        )
        SELECT s AS delivery_seq FROM reach GROUP BY s HAVING min(t) < s
    """,
    "p4_found": f"WITH RECURSIVE {items_sql()} SELECT * FROM held",
}
