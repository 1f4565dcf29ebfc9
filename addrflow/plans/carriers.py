"""A registry derived from the TPC-H-like tables, in SQL that both engines read.

``{name}`` stands for a table; Spark gets DataFrames for it, the oracle common table expressions of the same name."""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from addrflow.sources.scratch import kept

CARRIERS = {
    "unit": """
SELECT lpad(cast(r_regionkey AS string), 2, '0') || '00000' AS terc, r_name AS name, 1 AS level, cast(NULL AS string) AS parent_terc FROM {region}
UNION ALL
SELECT lpad(cast(n_regionkey AS string), 2, '0') || lpad(cast(n_nationkey AS string), 2, '0') || '000', n_name, 2, lpad(cast(n_regionkey AS string), 2, '0') || '00000' FROM {nation}
UNION ALL
SELECT DISTINCT lpad(cast(n_regionkey AS string), 2, '0') || lpad(cast(n_nationkey AS string), 2, '0') || lpad(cast(c_custkey % 4 AS string), 2, '0') || '1', n_name || ' ' || cast(c_custkey % 4 AS string), 3, lpad(cast(n_regionkey AS string), 2, '0') || lpad(cast(n_nationkey AS string), 2, '0') || '000'
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "locality": """
SELECT lpad(cast(c_custkey AS string), 7, '0') AS simc, c_mktsegment || ' ' || cast(c_custkey % 500 AS string) AS name, lower(c_mktsegment || ' ' || cast(c_custkey % 500 AS string)) AS name_norm,
       cast(c_custkey % 3 AS int) AS kind, lpad(cast(n_regionkey AS string), 2, '0') || lpad(cast(n_nationkey AS string), 2, '0') || lpad(cast(c_custkey % 4 AS string), 2, '0') || '1' AS terc,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE cast(14 + c_custkey % 10 AS double) END AS lon, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE cast(49 + c_custkey % 6 AS double) END AS lat,
       'M-' || cast(c_custkey AS string) AS gml_id, CASE WHEN c_custkey % 50 = 7 THEN timestamp '2024-01-01 00:00:00' END AS withdrawn
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "street": """
SELECT DISTINCT lpad(cast(o_custkey AS string), 7, '0') || '-' || lpad(substring(o_orderpriority, 1, 1), 5, '0') AS street_id, lpad(cast(o_custkey AS string), 7, '0') AS simc, lpad(substring(o_orderpriority, 1, 1), 5, '0') AS sym_ul,
       CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '3', '5') THEN 'ul.' ELSE 'al.' END AS kind, substring(o_orderpriority, 3, 20) AS name, lower(substring(o_orderpriority, 3, 20)) AS name_norm,
       'U-' || cast(o_custkey AS string) || '-' || substring(o_orderpriority, 1, 1) AS gml_id, substring(o_orderpriority, 1, 1) <= '3' AS official, cast(NULL AS timestamp) AS withdrawn
FROM {orders}""",
    "point": """
SELECT 'PA-' || cast(o_orderkey AS string) AS point_id, o_orderkey AS k, l.simc, l.terc, substring(l.terc, 1, 2) AS region, 'primary' AS source,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE l.simc || '-' || lpad(substring(o_orderpriority, 1, 1), 5, '0') END AS street_id,
       cast(o_orderkey % 300 + 1 AS string) || CASE WHEN o_orderkey % 12 = 0 THEN 'A' ELSE '' END || CASE WHEN o_orderkey % 10 = 0 THEN '/' || cast(o_orderkey % 9 + 1 AS string) ELSE '' END AS number,
       cast(o_orderkey % 300 + 1 AS string) || CASE WHEN o_orderkey % 12 = 0 THEN 'a' ELSE '' END || CASE WHEN o_orderkey % 10 = 0 THEN '/' || cast(o_orderkey % 9 + 1 AS string) ELSE '' END AS number_key,
       lpad(cast(o_orderkey % 300 + 1 AS string), 6, '0') || CASE WHEN o_orderkey % 12 = 0 THEN 'a' ELSE '' END || CASE WHEN o_orderkey % 10 = 0 THEN '/' || lpad(cast(o_orderkey % 9 + 1 AS string), 6, '0') ELSE '' END AS number_sort,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE lpad(cast(o_custkey % 90 + 10 AS string), 2, '0') || '-' || lpad(cast(o_orderkey % 7 + 1 AS string), 3, '0') END AS postal_code,
       CASE WHEN o_orderstatus = 'P' THEN 'planowany' ELSE 'istniejacy' END AS status,
       cast(14.2 AS double) + cast(o_orderkey * 7919 % 9800 AS double) / 1000 AS lon, cast(49.1 AS double) + cast(o_orderkey * 104729 % 5600 AS double) / 1000 AS lat,
       cast(NULL AS timestamp) AS withdrawn
FROM {orders} JOIN {locality} l ON lpad(cast(o_custkey AS string), 7, '0') = l.simc""",
    "published": """
SELECT point_id, k, simc, terc, region, source, street_id, number || CASE WHEN k % 13 = 0 THEN 'B' ELSE '' END AS number, number_key || CASE WHEN k % 13 = 0 THEN 'b' ELSE '' END AS number_key, number_sort, postal_code, status, lon, lat,
       CASE WHEN k % 17 = 0 THEN timestamp '2024-01-01 00:00:00' END AS withdrawn, number || CASE WHEN k % 13 = 0 THEN 'B' ELSE '' END || '|' || coalesce(postal_code, '') AS hash
FROM {point} WHERE k % 10 <> 0""",
    "staged": """
SELECT point_id, k, simc, terc, region, source, street_id, number, number_key, number_sort, postal_code, CASE WHEN k % 5 = 0 THEN NULL ELSE status END AS status, CASE WHEN k % 23 = 0 THEN NULL ELSE lon END AS lon, CASE WHEN k % 23 = 0 THEN NULL ELSE lat END AS lat,
       cast(NULL AS timestamp) AS withdrawn, number || '|' || coalesce(postal_code, '') AS hash
FROM {point} WHERE k % 11 <> 0 AND (k % 29 <> 0 OR k % 4 = 0)""",
    "secondary": """
SELECT 'Z-' || cast(k AS string) AS id, CASE WHEN k % 4 = 0 THEN NULL ELSE p.simc END AS simc, l.name_norm AS locality_norm, s.name_norm AS street_norm,
       number_key || CASE WHEN k % 6 = 0 THEN 'x' ELSE '' END AS number_key, CASE WHEN k % 15 = 1 THEN '99-999' ELSE postal_code END AS postal_code
FROM {point} p JOIN {locality} l ON p.simc = l.simc LEFT JOIN {street} s ON p.street_id = s.street_id WHERE k % 2 = 0""",
    "line": """
SELECT query_id, postal AS expected_postal, CASE WHEN box THEN split_part(place, ' ', 1) ELSE place END AS expected_locality, CASE WHEN NOT box THEN kind END AS expected_kind, CASE WHEN NOT box THEN road END AS expected_street,
       CASE WHEN NOT box THEN split_part(number, '/', 1) END AS expected_building, CASE WHEN NOT box AND number LIKE '%/%' THEN split_part(number, '/', 2) END AS expected_flat,
       CASE WHEN NOT box AND number LIKE '%/%' AND number NOT LIKE '%A%' THEN number ELSE '' END AS expected_other, box,
       CASE WHEN box THEN 'skr. poczt. 15, ' || place ELSE coalesce(kind || ' ' || road, place) || ' ' || number || ', ' || coalesce(CASE WHEN k % 8 = 1 THEN replace(postal, '-', '') ELSE postal END || ' ', '') || place END AS line
FROM (SELECT point_id AS query_id, k, k % 43 = 0 AS box, CASE WHEN k % 31 = 0 THEN 'Nigdzie' WHEN k % 41 = 0 THEN replace(l.name, 'U', 'O') ELSE l.name END AS place,
             s.kind, CASE WHEN k % 29 = 0 THEN replace(s.name, 'E', 'F') ELSE s.name END AS road, CASE WHEN k % 37 = 0 THEN '9999' ELSE number END AS number,
             CASE WHEN k % 43 = 0 OR k % 4 = 0 THEN NULL WHEN k % 59 = 2 AND k % 8 <> 1 THEN '00-000' ELSE postal_code END AS postal
      FROM {point} p JOIN {locality} l ON p.simc = l.simc LEFT JOIN {street} s ON p.street_id = s.street_id) x""",
    "leaky": """
SELECT doc_id, text || ' ' || CASE doc_id % 9 WHEN 0 THEN 'key adr_live_Ab1_Ab1_Ab1_Ab1_Ab1_Ab1_Ab1_Ab1__EK-ZSQ end' WHEN 1 THEN 'adr_test_aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa_yrEXdw' WHEN 2 THEN 'adr_live_aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa_AAAAAA' ELSE 'adr_live_short_AAAAAA' END AS text FROM {documents}""",
    "client": """
SELECT c_custkey AS client_id, c_name AS client_name, cast(20 + c_custkey % 60 AS bigint) AS monthly_quota, cast(1 + c_custkey % 3 AS int) AS per_minute, CASE WHEN c_custkey % 40 = 3 THEN timestamp '2024-01-10 00:00:00' END AS suspended_at FROM {customer}""",
    "key": """
SELECT c_custkey * 10 + d AS key_id, c_custkey AS client_id, 'pre' || cast(c_custkey * 10 + d AS string) AS prefix, timestamp '2023-12-01 00:00:00' AS valid_from,
       CASE WHEN c_custkey % 7 = 0 THEN timestamp '2024-02-03 00:00:00' WHEN c_custkey % 11 = 0 THEN timestamp '2024-01-20 00:00:00' END AS valid_to, CASE WHEN (c_custkey + d) % 13 = 0 THEN timestamp '2024-01-15 00:00:00' END AS revoked_at,
       CASE WHEN d = 1 THEN c_custkey * 10 END AS replaces_id, cast(1 + c_custkey % 3 AS int) AS per_minute, cast(1 + c_custkey % 2 AS int) AS pepper_version
FROM {customer} CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) x""",
    "request": """
SELECT event_id, cast(ts AS timestamp) AS ts, user_id * 10 + event_id % 2 AS key_id, user_id AS client_id, CASE WHEN event_type = 'purchase' THEN '/v1/batch' WHEN event_type = 'signup' THEN '/health' ELSE '/v1/' || event_type END AS route,
       CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 4 = 0 THEN 401 WHEN event_id % 4 = 1 THEN 429 ELSE 500 END AS status, value AS ms, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS items
FROM {events}""",
    "run": """
SELECT o_orderkey AS run_id, timestamp '2024-01-01 00:00:00' + CASE WHEN o_orderkey % 2 = 0 THEN interval '1' day ELSE interval '20' day END AS started_at, CASE WHEN o_orderkey % 5 = 0 THEN 'error' WHEN o_orderkey % 7 = 0 THEN 'held' ELSE 'ok' END AS status,
       CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS source, 'v' || cast(o_orderkey % 8 AS string) AS version FROM {orders}""",
}
_TABLES = ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "conversations")


def carrier(spark: SparkSession, sf_dir: str, name: str, keep: Collection[str] = (), made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derived table; base tables by their own names.

    Tables in ``keep`` are written to a scratch folder when they are first needed, also by other derived tables: whoever reads
    one often makes it once.  ``made`` holds those of one query."""
    made = {} if made is None else made
    if name not in CARRIERS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in made:
        return made[name]
    df = spark.sql(CARRIERS[name], **{n: carrier(spark, sf_dir, n, keep, made) for n in _needs(name)})
    if name in keep:
        df = made[name] = kept(name, df)
    return df


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", CARRIERS[name])))


def with_carriers(sql: str, *names: str) -> str:
    """The oracle's query with the derived tables it uses as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in CARRIERS and name not in order:
            for n in _needs(name):
                visit(n)
            order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CARRIERS[n].format(**{x: x for x in _needs(n)})})" for n in order]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]]) if parts else body
    return "WITH " + ", ".join(parts) + " " + body if parts else body
