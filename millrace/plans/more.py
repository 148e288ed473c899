"""Queries whose two texts differ, statements that change tables, and operators of the DataFrame API."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregates, joins
from millrace.operators.recursion import fixpoint
from millrace.plans.catalog import TABLES, named
from millrace.plans.engine import Engine
from millrace.streaming import windows

#: Name: the dialect's text, and what another database runs for the same rows.
PAIRS: dict[str, tuple[str, str]] = {
    "fn_volatile": (
        "SELECT random() < 1 AS r, length(gen_random_uuid()) AS u, now() > TIMESTAMP '2020-01-01' AS n, current_date > DATE '2020-01-01' AS d, hash(1) IS NOT NULL AS h, version() IS NOT NULL AS v, current_user() IS NOT NULL AS w",
        "SELECT true AS r, 36::BIGINT AS u, true AS n, true AS d, true AS h, true AS v, true AS w",
    ),
    "fn_bar": ("SELECT length(bar(p_size, 0, 50, 100)) AS b, stats(p_size) IS NOT NULL AS s FROM part", "SELECT (p_size * 2)::BIGINT AS b, true AS s FROM part"),
    "fn_list_names": (
        "SELECT array_push_back([1], 2) AS a, array_push_front([1], 0) AS b, array_length([1, 2]) AS c, list_element([4, 5], -1) AS d, array_has([1], 1) AS e, list_unique([2, 2]) AS f, list_bool_or([false]) AS g, list_bool_and([true]) AS h, array_indexof([1], 9) IS NULL AS i",
        "SELECT [1, 2] AS a, [0, 1] AS b, 2::BIGINT AS c, 5 AS d, true AS e, [2] AS f, false AS g, true AS h, true AS i",
    ),
    "fn_regexp_more": ("SELECT regexp_count(p_name, '[aeiou]') AS c, regexp_substr(p_name, '[a-z]+$') AS s, regexp_like(p_name, 'ring') AS l FROM part", "SELECT len(regexp_extract_all(p_name, '[aeiou]'))::INTEGER AS c, regexp_extract(p_name, '[a-z]+$') AS s, regexp_matches(p_name, 'ring') AS l FROM part"),
    "fn_json_parse": ("SELECT CAST(json_parse('[1,2]') AS VARCHAR) AS p, to_json([p_size]) AS t, json_valid('{') AS v FROM part", "SELECT '[1,2]' AS p, '[' || p_size || ']' AS t, false AS v FROM part"),
    "null_propagation": ("SELECT lower(NULL) AS a, sin(NULL) AS b, length(NULL) AS c, greatest(NULL, 2) AS d, concat('x', NULL) AS e", "SELECT NULL::VARCHAR AS a, NULL::DOUBLE AS b, NULL::BIGINT AS c, 2 AS d, 'x' AS e"),
    "fn_list_logic": (
        "SELECT list_any([true, false]) AS a, list_all([true, NULL]) AS b, list_count([1, NULL, 2]) AS c, list_product([2, 3]) AS p, list_string_agg(['x', NULL, 'y']) AS s, list_filter([1, NULL]) AS f, list_remove([1, 2, 1], 1) AS r",
        "SELECT true AS a, false AS b, 2::BIGINT AS c, 6.0::DOUBLE AS p, 'x,y' AS s, [1] AS f, [2] AS r",
    ),
    "fn_bits_more": (
        "SELECT p_size, get_bit(p_size, 1) AS g, set_bit(p_size, 6) AS s, bitstring(p_size, 8) AS b, bitand(p_size, 6) AS a, bitor(p_size, 1) AS o, bitxor(p_size, 5) AS x, bit_not(p_size) AS n, left_shift(p_size, 2) AS l, right_shift(p_size, 1) AS r FROM part",
        "SELECT p_size, (p_size >> 1) & 1 AS g, (p_size | 64)::BIGINT AS s, lpad(bin(p_size), 8, '0') AS b, p_size & 6 AS a, p_size | 1 AS o, xor(p_size, 5) AS x, ~p_size AS n, p_size << 2 AS l, p_size >> 1 AS r FROM part",
    ),
    "fn_formats": (
        "SELECT zfill(CAST(p_size AS VARCHAR), 5) AS z, to_hex(p_size) AS h, to_oct(p_size) AS o, from_base64(to_base64(p_name)) AS b, unhex(hex(p_name)) AS u, format('{} is {}', p_name, p_size) AS f, format_bytes(p_partkey * 1000) AS y FROM part",
        "SELECT lpad(p_size::VARCHAR, 5, '0') AS z, lower(hex(p_size)) AS h, printf('%o', p_size) AS o, p_name AS b, p_name AS u, p_name || ' is ' || p_size AS f, CASE WHEN p_partkey * 1000 < 1024 THEN (p_partkey * 1000) || ' B' WHEN p_partkey * 1000 < 1048576 THEN (p_partkey * 1000 // 1024) || ' KiB' ELSE (p_partkey * 1000 // 1048576) || ' MiB' END AS y FROM part",
    ),
    "fn_conditions_more": (
        "SELECT iif(p_size > 10, 'a', 'b') AS i, nvl(NULL, p_size) AS v, nvl2(p_name, 1, 2) AS w, decode(p_size, 1, 'one', 2, 'two', 'many') AS d, choose(p_size % 3 + 1, 'x', 'y', 'z') AS c, zeroifnull(nullif(p_size, 3)) AS z, nullifzero(p_size % 2) AS n, ifnot(p_size > 10, 7) AS t FROM part",
        "SELECT CASE WHEN p_size > 10 THEN 'a' ELSE 'b' END AS i, p_size AS v, 1 AS w, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS d, CASE p_size % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS c, CASE WHEN p_size = 3 THEN 0 ELSE p_size END AS z, CASE WHEN p_size % 2 = 0 THEN NULL ELSE 1 END AS n, CASE WHEN NOT p_size > 10 THEN 7 END AS t FROM part",
    ),
    "fn_types": (
        "SELECT typeof(p_size) AS a, typeof(p_name) AS b, typeof(p_retailprice) AS c, pg_typeof(p_partkey) AS d, current_database() AS e, current_schema() AS f, alias(p_size) AS g, constant_or_null(p_size, p_name) AS h, current_setting('TimeZone') AS i FROM part",
        "SELECT 'INTEGER' AS a, 'VARCHAR' AS b, 'DOUBLE' AS c, 'bigint' AS d, 'memory' AS e, 'main' AS f, p_size AS g, p_size AS h, 'UTC' AS i FROM part",
    ),
    "fn_float_more": (
        "SELECT p_size, fmod(p_retailprice, 7) AS a, copysign(p_retailprice, -1) AS b, round(hypot(p_size, 3), 9) AS c, ldexp(p_size, 3) AS d, fdim(p_size, 25) AS e, fma(p_size, 2, 1) AS f, round(remainder(p_size, 7), 9) AS g, odd(p_size + 0.5) AS h, div(p_size, 7) AS i FROM part",
        "SELECT p_size, fmod(p_retailprice, 7) AS a, -p_retailprice AS b, round(sqrt(p_size * p_size + 9), 9) AS c, (p_size * 8)::DOUBLE AS d, greatest(p_size - 25, 0)::DOUBLE AS e, p_size * 2 + 1 AS f, p_size - round(p_size / 7) * 7 AS g, ceil((p_size + 0.5 - 1) / 2) * 2 + 1 AS h, (p_size // 7)::BIGINT AS i FROM part",
    ),
    "fn_jaccard": (
        "SELECT jaccard(left(p_name, 5), left(p_type, 5)) AS j, soundex(p_name) IS NOT NULL AS s FROM part",
        "SELECT len(list_intersect(list_distinct(string_split(left(p_name, 5), '')), list_distinct(string_split(left(p_type, 5), '')))) / len(list_distinct(list_concat(string_split(left(p_name, 5), ''), string_split(left(p_type, 5), '')))) AS j, true AS s FROM part",
    ),
    "fn_json_make": (
        "SELECT json_array(p_size, p_partkey) AS a, json_object('k', p_size, 'n', p_name) AS o, json_quote(p_name) AS q, json_contains(p_name, 'RING') AS c, json_extract('{\"a\":{\"b\":5}}', 'a.b') AS e, try_json_extract('{\"a\":[7,8]}', 'a.1') AS t FROM part",
        "SELECT '[' || p_size || ',' || p_partkey || ']' AS a, '{\"k\":' || p_size || ',\"n\":\"' || p_name || '\"}' AS o, '\"' || p_name || '\"' AS q, contains(lower(p_name), 'ring') AS c, '5' AS e, '8' AS t FROM part",
    ),
    "fn_json_group": (
        "SELECT n_regionkey, json_group_array(n_nationkey) IS NOT NULL AS a, length(json_group_array(n_regionkey)) AS n FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, true AS a, count(*) * 2 + 1 AS n FROM nation GROUP BY n_regionkey",
    ),
    "fn_struct": (
        "SELECT struct_keys({'a': p_size, 'b': p_name}) AS k, struct_values({'a': p_size, 'b': p_partkey}) AS v, struct_pack('x', p_size)['x'] AS x, row(p_size, p_name)['v2'] AS r FROM part",
        "SELECT ['a', 'b'] AS k, [p_size::VARCHAR, p_partkey::VARCHAR] AS v, p_size AS x, p_name AS r FROM part",
    ),
    "fn_map_more": (
        "SELECT map_extract(map(['a', 'b'], [1, p_size]), 'b') AS e, element_at(map(['a'], [p_size]), 'z') AS n, map_from_entries([row('k', p_size)])['k'] AS f FROM part",
        "SELECT p_size AS e, NULL::INTEGER AS n, p_size AS f FROM part",
    ),
    "fn_date_add": (
        "SELECT date_add(CAST(o_orderdate AS DATE), 5) AS a, date_add(CAST(o_orderdate AS DATE), 1, 'month') AS b, date_sub(CAST(o_orderdate AS DATE), 2, 'week') AS c, datediff(CAST(o_orderdate AS DATE), DATE '2000-01-01') AS d, to_date('2024-05-06') AS e, make_timestamp(2024, 1, 2, 3, 4, 5) AS f FROM orders",
        "SELECT (o_orderdate + INTERVAL 5 DAY)::DATE AS a, (o_orderdate + INTERVAL 1 MONTH)::DATE AS b, (o_orderdate - INTERVAL 14 DAY)::DATE AS c, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS d, DATE '2024-05-06' AS e, TIMESTAMP '2024-01-02 03:04:05' AS f FROM orders",
    ),
    "fn_epoch": (
        "SELECT epoch(ts) AS e, epoch_ns(ts) AS n, extract(dow FROM ts) AS w, age(TIMESTAMP '2024-03-05', TIMESTAMP '2022-01-02') AS a FROM events",
        "SELECT epoch(ts) AS e, epoch_us(ts) * 1000 AS n, dayofweek(ts) AS w, '2 years 2 months 3 days' AS a FROM events",
    ),
    "agg_if": (
        "SELECT o_orderstatus, round(sum_if(o_totalprice, o_custkey < 500), 2) AS s, round(avg_if(o_totalprice, o_custkey < 500), 4) AS a, min_if(o_totalprice, o_custkey < 500) AS lo, max_if(o_totalprice, o_custkey < 500) AS hi FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, round(sum(o_totalprice) FILTER (WHERE o_custkey < 500), 2) AS s, round(avg(o_totalprice) FILTER (WHERE o_custkey < 500), 4) AS a, min(o_totalprice) FILTER (WHERE o_custkey < 500) AS lo, max(o_totalprice) FILTER (WHERE o_custkey < 500) AS hi FROM orders GROUP BY o_orderstatus",
    ),
    "agg_regression_more": (
        "SELECT round(regr_syy(l_quantity, l_discount), 2) AS y, regr_slope(l_quantity, NULLIF(l_discount, l_discount)) AS n FROM lineitem",
        "SELECT round(regr_syy(l_quantity, l_discount), 2) AS y, NULL::DOUBLE AS n FROM lineitem",
    ),
    "agg_string_distinct": (
        "SELECT string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS s, length(group_concat(o_orderstatus)) AS g FROM orders",
        "SELECT string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS s, length(string_agg(o_orderstatus, ',')) AS g FROM orders",
    ),
    "agg_avg_temporal": (
        "SELECT o_orderstatus, avg(o_orderdate) AS a, avg(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, avg(o_orderdate) AS a, avg(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY o_orderstatus",
    ),
    "agg_kurtosis_pop": (
        "SELECT l_returnflag, round(kurtosis_pop(l_extendedprice), 6) AS k FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round(kurtosis_pop(l_extendedprice), 6) AS k FROM lineitem GROUP BY l_returnflag",
    ),
    "subscripts": ("SELECT generate_subscripts AS i FROM generate_subscripts([7, 8, 9], 1)", "SELECT unnest([1, 2, 3]) AS i"),
    "cte_materialized": ("WITH t AS MATERIALIZED (SELECT n_regionkey AS r FROM nation) SELECT r, count(*) AS n FROM t GROUP BY r", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "from_first": ("FROM nation SELECT n_name", "SELECT n_name FROM nation"),
    "exists_in_case": (
        "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 1 ELSE 0 END AS big FROM customer",
        "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 1 ELSE 0 END AS big FROM customer",
    ),
    "date_range_hours": ("SELECT count(*) AS n FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL '6' HOUR)", "SELECT 9::BIGINT AS n"),
}

#: Scripts: each run in an engine of its own, the last statement is the result.
SCRIPTS: dict[str, tuple[str, str]] = {
    "ddl_insert_update_delete": (
        "CREATE TABLE w (k INTEGER PRIMARY KEY, s VARCHAR DEFAULT 'none', v DOUBLE); INSERT INTO w VALUES (1, 'a', 1.5), (2, 'b', 2.5), (3, NULL, NULL); INSERT INTO w (k, v) VALUES (4, 4.5); INSERT INTO w SELECT n_nationkey + 10, n_name, 0 FROM nation WHERE n_regionkey = 1; UPDATE w SET v = v * 2, s = upper(s) WHERE k < 3; DELETE FROM w WHERE k = 3; SELECT * FROM w",
        "SELECT k, s, v::DOUBLE AS v FROM (VALUES (1, 'A', 3.0), (2, 'B', 5.0), (4, 'none', 4.5)) t(k, s, v) UNION ALL SELECT n_nationkey + 10, n_name, 0 FROM nation WHERE n_regionkey = 1",
    ),
    "ddl_ctas_alter": (
        "CREATE TABLE c AS SELECT n_nationkey AS k, n_name AS s, n_regionkey AS r FROM nation; ALTER TABLE c ADD COLUMN z INTEGER DEFAULT 7; ALTER TABLE c DROP COLUMN r; ALTER TABLE c RENAME COLUMN s TO name; ALTER TABLE c ALTER COLUMN k SET DATA TYPE BIGINT; ALTER TABLE c RENAME TO d; INSERT INTO d (k, name) VALUES (99, 'new'); SELECT * FROM d",
        "SELECT n_nationkey::BIGINT AS k, n_name AS name, 7 AS z FROM nation UNION ALL SELECT 99, 'new', 7",
    ),
    "ddl_view": ("CREATE OR REPLACE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000; SELECT count(*) AS n FROM rich", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 9000"),
    "ddl_sequence": (
        "CREATE SEQUENCE q START WITH 5 INCREMENT BY 3; CREATE TABLE sq (n BIGINT); INSERT INTO sq VALUES (nextval('q')), (nextval('q')); INSERT INTO sq VALUES (currval('q')); SELECT n FROM sq",
        "SELECT n::BIGINT AS n FROM (VALUES (5), (8), (8)) t(n)",
    ),
    "ddl_session": ("BEGIN; SET threads = 4; PRAGMA version; CREATE TABLE x (a INTEGER); CREATE INDEX i ON x (a); COMMIT; DROP INDEX i; INSERT INTO x VALUES (1); SELECT a FROM x", "SELECT 1 AS a"),
}


def run_script(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).attach(sf_dir, named(sql)).execute_batch(sql)[-1].df

    return run


def _frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copied(kind: str, options: str) -> Callable[[SparkSession, str], DataFrame]:
    """A table written by COPY TO and read again as a file."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark).attach(sf_dir, TABLES)
        path = f"{engine.folder}/copy-{uuid.uuid4().hex}.{kind}"
        engine.sql(f"COPY (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders) TO '{path}' ({options})")
        return engine.sql(f"SELECT * FROM read_{kind}('{path}')")

    return run


def copy_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark).attach(sf_dir, TABLES)
    path = f"{engine.folder}/copy-{uuid.uuid4().hex}.csv"
    engine.execute_batch(f"COPY nation TO '{path}' (HEADER true); CREATE TABLE back (k INTEGER, s VARCHAR, r INTEGER); COPY back FROM '{path}' (HEADER true)")
    return engine.sql("SELECT k, s, r FROM back")


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark).attach(sf_dir, TABLES)
    folder = f"{engine.folder}/save-{uuid.uuid4().hex}"
    engine.sql("CREATE TABLE kept AS SELECT r_regionkey AS k, r_name AS s FROM region")
    engine.save(folder)
    return Engine.load(spark, folder).sql("SELECT * FROM kept")


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursion with UNION: nations that steps of 7 and 11 reach from 0, each once."""
    nations = _frame(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    step = lambda new: new.select(F.explode(F.array((F.col("k") + 7) % 30, (F.col("k") + 11) % 30)).alias("k")).join(nations, "k", "left_semi")
    return fixpoint(nations.filter("k = 0"), step)


def range_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _frame(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    bands = spark.range(0, 40).select(F.col("id").alias("band"), (F.col("id") * 12000.0).alias("low"), (F.col("id") * 12000.0 + 15000).alias("high"))
    return joins.range_join(orders, bands, "o_totalprice", "low", "high", 12000.0).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = _frame(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), _frame(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    return joins.salted_join(orders.select("k", "o_orderkey"), customers.select("k", "c_name"), "k", 8)


def rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.with_rowid(_frame(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]).filter("rowid > 100")


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "copy_csv": (copied("csv", "FORMAT CSV, HEADER true"), "SELECT o_orderkey::INTEGER AS o_orderkey, o_custkey::INTEGER AS o_custkey, o_orderstatus, o_totalprice FROM orders"),
    "copy_parquet": (copied("parquet", "FORMAT PARQUET"), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    "copy_json": (copied("json", "FORMAT JSON"), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    "copy_from": (copy_from, "SELECT n_nationkey AS k, n_name AS s, n_regionkey AS r FROM nation"),
    "save_load": (saved, "SELECT r_regionkey AS k, r_name AS s FROM region"),
    "recursive_union": (reachable, "WITH RECURSIVE r(k) AS (SELECT 0 UNION SELECT n_nationkey FROM nation, r WHERE n_nationkey = (k + 7) % 30 OR n_nationkey = (k + 11) % 30) SELECT k FROM r"),
    "range_join": (range_joined, "SELECT i AS band, count(*) AS n FROM orders, range(0, 40) t(i) WHERE o_totalprice BETWEEN i * 12000.0 AND i * 12000.0 + 15000 GROUP BY i"),
    "salted_join": (salted, "SELECT o_custkey AS k, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "rowid": (rowid, "SELECT * FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rowid FROM orders) WHERE rowid > 100"),
    "agg_histogram": (
        lambda s, d: aggregates.histogram(_frame(s, d, "lineitem"), ["l_returnflag"], "l_linenumber").select("l_returnflag", F.map_keys("histogram").alias("k"), F.map_values("histogram").alias("v")),
        "SELECT l_returnflag, list(l_linenumber ORDER BY l_linenumber) AS k, list(n ORDER BY l_linenumber) AS v FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag",
    ),
    "agg_entropy": (
        lambda s, d: aggregates.entropy(_frame(s, d, "lineitem"), ["l_returnflag"], "l_linenumber").select("l_returnflag", F.round("entropy", 8).alias("e")),
        "SELECT l_returnflag, round(entropy(l_linenumber), 8) AS e FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_mode": (
        lambda s, d: aggregates.mode(_frame(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "m"),
        "SELECT l_returnflag, arg_min(l_quantity, {'a': -n, 'b': l_quantity}) AS m FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag",
    ),
    "agg_approx_distinct": (lambda s, d: _frame(s, d, "orders").agg(F.approx_count_distinct("o_custkey", 0.01).alias("n")), None),
    "window_tumbling": (
        lambda s, d: windows.windowed(_frame(s, d, "events"), "ts", "1 hour", keys=("event_type",)).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n"),
        "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY ALL",
    ),
    "window_session": (
        lambda s, d: windows.sessions(_frame(s, d, "events"), "ts", "30 minutes", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"),
        "SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
    ),
}

QUERIES = {n: run_script(p[0]) for n, p in (PAIRS | SCRIPTS).items()} | {n: f for n, (f, _) in FRAMES.items()}
ORACLE = {n: p[1] for n, p in (PAIRS | SCRIPTS).items()} | {n: sql for n, (_, sql) in FRAMES.items() if sql}
