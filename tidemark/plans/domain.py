"""The given tables seen as the library's domain tables.

Each view is SQL that Spark and DuckDB read alike, so a query and its oracle
start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "messages": "SELECT conv_id AS thread_id, turn AS seq, role, text AS content FROM conversations",
    "threads": """SELECT conv_id AS thread_id, 'chat' || CAST(conv_id % 2 AS STRING) AS source,
  'acc' || CAST(conv_id % 3 AS STRING) || CASE WHEN conv_id % 2 = 0 THEN '-personal' ELSE '-work' END AS account,
  min(substr(text, 1, 60)) AS title,
  make_timestamp(2024, CAST(1 + conv_id % 12 AS INT), CAST(1 + conv_id % 28 AS INT), CAST(conv_id % 24 AS INT), 0, 0) AS updated_at,
  CASE WHEN conv_id % 7 = 0 THEN 'closed' ELSE 'open' END AS status,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'p' || CAST(conv_id % 30 AS STRING) END AS project_link,
  CASE conv_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'manual' WHEN 2 THEN 'exact' WHEN 3 THEN 'evidence' WHEN 4 THEN 'fuzzy' END AS project_confidence,
  conv_id % 11 = 0 AS suggested_close FROM conversations GROUP BY conv_id""",
    "projects": "SELECT 'p' || CAST(n_nationkey AS STRING) AS project_id, n_name AS name, n_regionkey AS program FROM nation",
    "registry": """SELECT 'g' || CAST(r_regionkey AS STRING) AS id, 'program' AS tier, r_name AS canonical_name, CAST(NULL AS STRING) AS program, CAST(NULL AS STRING) AS project FROM region
  UNION ALL SELECT 'p' || CAST(n_nationkey AS STRING), 'project', n_name, 'g' || CAST(n_regionkey AS STRING), CAST(NULL AS STRING) FROM nation
  UNION ALL SELECT 'r' || CAST(s_suppkey AS STRING), 'repo', s_name, 'g' || CAST(n_regionkey AS STRING), 'p' || CAST(n_nationkey AS STRING) FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "files": """SELECT page_id AS file_id, regexp_extract(url, '://([^/]+)', 1) AS project, regexp_extract(url, '://[^/]+/(.*)$', 1) AS path,
  CAST(length(html) AS BIGINT) AS bytes, html AS content,
  CASE page_id % 4 WHEN 0 THEN 'untracked' WHEN 1 THEN 'ignored' ELSE 'tracked' END AS git_status FROM pages""",
    "docs": """SELECT doc_id, source AS project, lang || CASE doc_id % 9 WHEN 0 THEN '/README.md' WHEN 1 THEN '/adr/' || CAST(doc_id AS STRING) || '.md' WHEN 2 THEN '/PLAN_' || CAST(doc_id AS STRING) || '.md'
  WHEN 3 THEN '/_out/REPORT.md' WHEN 4 THEN '/my_knowledge_' || CAST(doc_id AS STRING) || '.md' WHEN 5 THEN '/logs/x.md' WHEN 6 THEN '/Status' || CAST(doc_id AS STRING) || '.md' ELSE '/' || CAST(doc_id AS STRING) || '.md' END AS path,
  text AS content, CAST(length(text) AS BIGINT) AS bytes FROM documents""",
    "commits": """SELECT 'c' || CAST(o_custkey % 40 AS STRING) AS project, substr(md5(CAST(o_orderkey AS STRING)), 1, 12) AS hash, CAST(o_orderdate AS TIMESTAMP) AS ts,
  o_orderpriority AS author, o_orderstatus AS subject FROM orders""",
    "evidence": """SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_orderkey % 500 AS thread_id,
  CASE l_partkey % 4 WHEN 0 THEN 'p' || CAST(l_suppkey % 25 AS STRING) WHEN 1 THEN 'g' || CAST(l_suppkey % 5 AS STRING) ELSE 'r' || CAST(1 + l_suppkey % 10 AS STRING) END AS project,
  CASE l_linenumber % 4 WHEN 0 THEN 'filename_xref' WHEN 1 THEN 'path_mention' WHEN 2 THEN 'name_alias' ELSE 'vocabulary' END AS signal,
  round(l_discount * 9, 4) AS weight, 'o' || CAST(l_partkey % 12 AS STRING) AS origin FROM lineitem""",
    "queue": """SELECT o_orderkey AS item_id, CASE o_orderkey % 3 WHEN 0 THEN 'project_link' WHEN 1 THEN 'link_ambiguous' ELSE 'link_downgrade' END AS type, o_orderkey % 97 AS thread_id,
  round(o_totalprice / 600000, 4) AS confidence, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'confirmed' ELSE 'rejected' END AS status,
  'p' || CAST(o_custkey % 25 AS STRING) AS candidate_project, CASE WHEN o_orderkey % 3 = 1 THEN 'p' || CAST((o_custkey + 7) % 25 AS STRING) END AS rival_project FROM orders""",
    "rulings": "SELECT o_orderkey % 97 AS thread_id, 'p' || CAST(o_custkey % 25 AS STRING) AS candidate_project FROM orders WHERE o_orderkey % 8 = 0",
    "ledger": """SELECT l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS model_id, l_linestatus AS stage, l_linenumber % 2 = 0 AS cool_down, l_extendedprice / l_quantity AS ms,
  CAST(l_shipdate AS TIMESTAMP) AS ts, 'h' || CAST(l_suppkey % 3 AS STRING) AS host FROM lineitem""",
    "activity": "SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value FROM events",
    "sightings": """SELECT user_id AS fingerprint, event_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 3 = 0 THEN 'resolution' WHEN event_id % 3 = 1 THEN 'sighting' ELSE 'ruling' END AS kind FROM events""",
    "map_rows": """SELECT event_id AS pos, 's' || CAST(user_id AS STRING) AS session_id, 'p' || CAST(event_id % 25 AS STRING) AS project_id, CASE WHEN event_type = 'error' OR event_id % 9 = 0 THEN 'revoked' ELSE 'active' END AS status FROM events""",
}


def needed(sql: str) -> list[str]:
    """Views that a statement uses, inner ones first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            out += [x for x in needed(VIEWS[name]) if x not in out]
            if name not in out:
                out.append(name)
    return out


def with_views(sql: str) -> str:
    """The statement with its views as common table expressions."""
    names = needed(sql)
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    text = sql.lstrip()
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {text[15:]}"
    return f"WITH {ctes}, {text[5:]}" if text.startswith("WITH ") else f"WITH {ctes} {text}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over them."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = with_views(f"SELECT * FROM {name}")
    for base in BASE:
        if re.search(rf"\b(?:FROM|JOIN)\s+{base}\b", sql):
            spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    return spark.sql(sql)
