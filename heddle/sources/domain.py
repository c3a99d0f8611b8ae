"""The domain's relations, projected from the driver tables in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RELATIONS = {
    "sellers": """SELECT c_custkey AS id, c_name AS name, lower(c_name) AS normalized_name, n_name AS country, r_name AS province,
        CAST(c_custkey % 101 AS INT) AS confidence, CASE WHEN c_acctbal > 0 THEN concat(lower(c_mktsegment), '.example') END AS domain,
        CASE WHEN c_custkey % 17 = 0 THEN 'merged' WHEN c_custkey % 19 = 0 THEN 'inactive' ELSE 'active' END AS status,
        concat(upper(c_name), ' LTD') AS legal_name, c_mktsegment AS city, CAST(c_custkey % 7 * 15 AS INT) AS manufacturer_score, CAST(c_custkey % 5 * 15 AS INT) AS trader_score,
        DATE '2023-01-01' + CAST(c_custkey % 300 AS INT) AS first_seen_at, DATE '2024-02-01' + CAST(c_custkey % 17 AS INT) AS last_seen_at, DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS updated_at
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "accounts": "SELECT o_orderkey AS id, o_custkey AS seller_id, o_orderpriority AS marketplace, o_orderstatus AS token, o_orderdate AS last_seen, concat('Shop ', CAST(o_custkey % 97 AS STRING)) AS display_name FROM {orders}",
    "aliases": "SELECT c_custkey * 10 AS id, c_custkey AS seller_id, concat('Société ', c_mktsegment, ' ', CAST(c_custkey % 50 AS STRING)) AS alias FROM {customer} WHERE c_custkey % 2 = 0",
    "sources": "SELECT event_id AS id, user_id AS seller_id, CASE event_id % 4 WHEN 0 THEN 'official_site' WHEN 1 THEN 'marketplace' ELSE 'directory' END AS source_type, ts AS first_seen_at FROM {events}",
    "run_sellers": "SELECT event_id % 50 AS run_id, user_id AS seller_id FROM {events}",
    "product_links": "SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS seller_id, l_partkey AS part_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "score_components": "SELECT event_id AS id, user_id AS seller_id, CAST(floor(value) AS INT) AS points FROM {events} WHERE event_type = 'view'",
    "outreach_states": "SELECT event_id AS id, user_id AS seller_id, event_type AS channel FROM {events} WHERE event_type = 'signup'",
    "audit_events": "SELECT event_id AS id, user_id AS seller_id, ts AS created_at FROM {events} WHERE event_type = 'purchase'",
    "field_history": "SELECT event_id AS id, user_id AS seller_id, props AS diff FROM {events} WHERE event_type = 'error'",
    "products": """SELECT o_custkey AS seller_id, p_name AS name, p_brand AS brand, p_type AS category
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "contacts": """SELECT event_id AS id, user_id AS seller_id, event_type AS contact_type, CAST(least(100, floor(value)) AS INT) AS confidence, ts AS last_seen,
        CASE WHEN event_id % 3 = 0 THEN ts END AS verified_at, md5(CAST(CAST(floor(event_id / 8) AS BIGINT) AS STRING)) AS hash,
        CASE WHEN event_id % 11 = 0 THEN 'inactive' ELSE 'active' END AS status, event_id AS source_id FROM {events}""",
    "suppressions": """SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN user_id END AS seller_id, CASE WHEN event_id % 2 = 1 THEN md5(CAST(CAST(floor(event_id / 8) AS BIGINT) AS STRING)) END AS hash,
        CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 7 DAY END AS expires_at FROM {events} WHERE event_type = 'error' AND event_id % 7 = 0""",
    "decisions": """SELECT o_orderkey AS id, o_custkey AS candidate_id, 1 + (o_orderkey * 7) % 1000 AS matched_id, CAST(o_orderkey % 101 AS INT) AS score,
        CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'merged' ELSE 'separate' END AS status, o_orderdate AS created_at FROM {orders} WHERE o_custkey <> 1 + (o_orderkey * 7) % 1000""",
    "identities": """SELECT p_partkey AS id, p_name AS name, p_brand AS domain, p_type AS country, CAST(p_size AS STRING) AS city FROM {part}""",
    "log": "SELECT event_id AS id, user_id AS run_id, event_type AS state, ts AS happened, value, props FROM {events}",
}


def relation(spark: SparkSession, sf_dir: str, name: str, hashed: tuple[str, ...] = ()) -> DataFrame:
    """A relation. A join with a table of hashed hashes that table's side, so the other isn't sorted."""
    sql = RELATIONS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    for t in hashed:
        if f"JOIN {{{t}}}" in sql:
            tables[t] = tables[t].hint("shuffle_hash")
    return spark.sql(sql, **tables)


def oracle(sql: str) -> str:
    """sql over the relations, for DuckDB."""
    used = [r for r in RELATIONS if re.search(rf"\b{r}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{r} AS ({re.sub(r'[{}]', '', RELATIONS[r])})" for r in used)
    head = re.match(r"\s*WITH( RECURSIVE)?\s", sql)
    if head:
        return f"WITH{head[1] or ''} {ctes},\n{sql[head.end():]}"
    return f"WITH {ctes}\n{sql}"
