"""Queries for rules of the dialect that hold on data: what division by zero gives, how casts round, which order is left."""

from __future__ import annotations

from millrace.plans.more import run_script

#: Texts that mean the same in both.
BOTH: dict[str, str] = {
    "cast_fractions": "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS INTEGER) AS i, (l_extendedprice / 7)::BIGINT AS b, CAST(l_discount * 100 + 0.3 AS SMALLINT) AS s, CAST(CAST(l_tax AS DECIMAL(8,2)) * 50 AS INTEGER) AS d FROM lineitem",
    "date_minus_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '2000-01-01' AS n FROM orders",
    "date_columns_minus": "SELECT k, d - e AS n FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(NULLIF(o_orderdate, TIMESTAMP '1995-01-01') AS DATE) AS e FROM orders) t",
    "date_plus_hours": "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL '1 month 2 days 3 hours' AS t FROM orders",
    "regexp_replace_first": "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS a, regexp_replace(p_name, '[aeiou]+', '', 'g') AS g, regexp_replace(p_name, '[AEIOU]', '#', 'gi') AS i, regexp_replace(nullif(p_name, p_name), 'a', 'b') AS n, regexp_replace(p_name, 'zzz', 'b') AS z FROM part",
    "list_with_nulls": "SELECT o_orderstatus, len(list(nullif(o_custkey % 5, 0))) AS n, len(list(o_custkey) FILTER (WHERE o_totalprice > 1000)) AS f FROM orders GROUP BY o_orderstatus",
    "histogram_by_name": "SELECT l_returnflag, map_keys(histogram(l_linenumber)) AS k, map_values(histogram(l_linenumber)) AS v FROM lineitem WHERE l_quantity > 5 GROUP BY l_returnflag",
    "entropy_by_name": "SELECT l_returnflag AS f, round(entropy(l_linenumber), 8) AS e FROM lineitem GROUP BY l_returnflag",
    "qualify_hidden_order": "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "distinct_on_hidden_order": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "recursive_union_sql": "WITH RECURSIVE r(k) AS (SELECT 0 UNION SELECT n_nationkey FROM nation, r WHERE n_nationkey = (k + 7) % 30 OR n_nationkey = (k + 11) % 30) SELECT k FROM r WHERE k < 20",
    "format_specs": "SELECT format('{:.2f} of {}', p_retailprice, p_size) AS f FROM part",
    "series_down": "SELECT n * 2 AS n FROM (SELECT generate_series AS n FROM generate_series(10, 1, -3)) t",
}

PAIRS: dict[str, tuple[str, str]] = {
    "divide_by_zero": (
        "SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber - 1) AS q, l_orderkey % (l_linenumber - 1) AS m, 1 / 0 AS z, l_quantity / -l_linenumber AS s FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN l_quantity / (l_linenumber - 1) END AS q, CASE WHEN l_linenumber > 1 THEN l_orderkey % (l_linenumber - 1) END AS m, NULL::DOUBLE AS z, l_quantity / -l_linenumber AS s FROM lineitem",
    ),
    "nextval_rows": (
        "CREATE SEQUENCE q START WITH 10 INCREMENT BY 2; CREATE TABLE z (k BIGINT, s VARCHAR); INSERT INTO z SELECT nextval('q'), n_name FROM nation WHERE n_regionkey < 9; INSERT INTO z SELECT nextval('q'), 'x'; SELECT k, count(*) AS n FROM z GROUP BY k",
        "SELECT 10 + 2 * i AS k, 1 AS n FROM range(0, 26) t(i)",
    ),
    "nextval_average": ("CREATE SEQUENCE q; SELECT avg(nextval('q')) AS a FROM nation", "SELECT 13.0::DOUBLE AS a"),
    "schemas": (
        "CREATE SCHEMA s1; CREATE SCHEMA s2; CREATE TABLE s1.t (a INTEGER); CREATE TABLE s2.t (a INTEGER); INSERT INTO s1.t VALUES (1); INSERT INTO s2.t VALUES (2), (3), (4); DELETE FROM s2.t WHERE a = 4; DROP TABLE IF EXISTS s1.nosuch; SELECT x.a AS a, t.a AS b FROM s1.t AS x JOIN s2.t ON t.a > x.a",
        "SELECT 1 AS a, 2 AS b UNION ALL SELECT 1, 3",
    ),
    "insert_default": (
        "CREATE TABLE w (k INTEGER DEFAULT 7, s VARCHAR DEFAULT 'none', v DOUBLE); INSERT INTO w VALUES (DEFAULT, 'a', 1.5), (2, DEFAULT, DEFAULT); INSERT INTO w (v, k) VALUES (2.5, DEFAULT); SELECT k, s, v FROM w",
        "SELECT k, s, v::DOUBLE AS v FROM (VALUES (7, 'a', 1.5), (2, 'none', NULL), (7, 'none', 2.5)) t(k, s, v)",
    ),
}

QUERIES = {n: run_script(sql) for n, sql in BOTH.items()} | {n: run_script(p[0]) for n, p in PAIRS.items()}
ORACLE = BOTH | {n: p[1] for n, p in PAIRS.items()}
