"""Queries for each operator and function of the SQL surface, written in the dialect.

A query is one text, which the engine plans and which an independent database can run as it is; where that spells
something otherwise, or means something else by the name, ITS has the text for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL: dict[str, str] = {
    # scans and sources
    "scan": "SELECT * FROM nation",
    "dummy_scan": "SELECT 1 AS one, 'a' AS a",
    "values": "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (NULL, 'c')) AS t(n, s)",
    "table_range": "SELECT range AS n FROM range(3, 20, 4)",
    "table_generate_series": "SELECT generate_series AS n FROM generate_series(1, 10, 3)",
    "table_range_dates": "SELECT CAST(range AS DATE) AS d FROM range(DATE '2024-01-01', DATE '2024-01-08', INTERVAL '1' DAY)",
    "table_unnest": "SELECT unnest AS n FROM unnest([1, 2, 3])",
    # projection, filter, operators
    "project": "SELECT l_orderkey, l_quantity * 2 AS twice, l_extendedprice * (1 - l_discount) AS net FROM lineitem",
    "star_exclude": "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer",
    "star_replace": "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation",
    "alias_qualified": "SELECT n.n_name AS name, r.r_name FROM nation AS n, region r WHERE n.n_regionkey = r.r_regionkey",
    "filter": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount > 0.05 AND l_quantity < 24",
    "having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550",
    "qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "arithmetic": "SELECT l_linenumber + 1 AS a, l_linenumber - 10 AS s, l_linenumber * 3 AS m, -l_linenumber AS neg, l_linenumber % 3 AS r, l_orderkey // 7 AS d, l_orderkey / 8 AS q FROM lineitem",
    "date_interval": "SELECT CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS m, CAST(o_orderdate - INTERVAL '10' DAY AS DATE) AS d FROM orders",
    "comparisons": "SELECT o_orderkey, o_custkey = 5 AS eq, o_custkey <> 5 AS ne, o_custkey < 100 AS lt, o_custkey >= 700 AS ge, NULL = 1 AS unknown FROM orders",
    "three_valued": "SELECT a, b, a AND b AS x, a OR b AS y, NOT a AS z FROM (VALUES (true, NULL), (false, NULL), (NULL, NULL), (true, false)) t(a, b)",
    "bitwise": "SELECT l_linenumber & 3 AS a, l_linenumber | 8 AS o, l_linenumber << 2 AS l, l_orderkey >> 3 AS r FROM lineitem",
    "concat_operator": "SELECT n_name || '-' || n_regionkey AS s FROM nation",
    "like": "SELECT p_name LIKE '%ring%' AS a, p_name ILIKE 'RED%' AS b, p_name NOT LIKE '_e%' AS c FROM part",
    "null_tests": "SELECT x IS NULL AS a, x IS NOT NULL AS b, x IS DISTINCT FROM 1 AS c FROM (VALUES (1), (NULL), (2)) t(x)",
    "between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 905 AND 950",
    "in_list": "SELECT p_partkey, p_size IN (1, 2, 3) AS a, p_size NOT IN (1, NULL) AS b FROM part",
    "case": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS s, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS p FROM orders",
    "cast": "SELECT CAST(l_quantity AS INTEGER) AS i, l_orderkey::VARCHAR AS s, CAST('12' AS BIGINT) AS b, l_linenumber::DOUBLE AS d, CAST(l_shipdate AS DATE) AS dt FROM lineitem",
    "try_cast": "SELECT TRY_CAST(s AS INTEGER) AS i, TRY_CAST(s AS DATE) AS d FROM (VALUES ('12'), ('x'), ('2024-02-30'), ('2024-02-29')) t(s)",
    "literals": "SELECT DATE '2024-02-29' AS d, TIMESTAMP '2024-02-29 12:30:00' AS t, 1.5e3 AS f, 'it''s' AS s",
    "syntax_functions": "SELECT EXTRACT(year FROM o_orderdate) AS y, SUBSTRING(o_orderpriority FROM 3 FOR 4) AS s, TRIM(BOTH '-' FROM '--a--') AS t, POSITION('-' IN o_orderpriority) AS p FROM orders",
    "list_literal": "SELECT [1, 2, 3][2] AS e, [10, 20, 30, 40][2:3] AS s, [n_nationkey, n_regionkey] AS l FROM nation",
    "struct_literal": "SELECT {'a': n_nationkey, 'b': n_name}['b'] AS b, struct_extract({'k': n_regionkey}, 'k') AS k FROM nation",
    # joins
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000",
    "join_full": "SELECT p_partkey, s_suppkey FROM part FULL JOIN supplier ON p_partkey = s_suppkey + 50",
    "join_semi": "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_anti": "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000",
    "join_using": "SELECT s.k, s.a, t.b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) s JOIN (SELECT c_nationkey AS k, c_custkey AS b FROM customer) t USING (k)",
    "join_natural": "SELECT * FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) s NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey AS b FROM supplier) t",
    "join_multi": "SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name",
    "join_lateral": "SELECT n_name, top FROM nation, LATERAL (SELECT max(c_acctbal) AS top FROM customer WHERE c_nationkey = n_nationkey) t",
    "join_lateral_left": "SELECT r_name, n_name FROM region LEFT JOIN LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20) t ON true",
    "join_asof": "SELECT a.event_id AS buy, b.event_id AS view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts",
    # aggregation
    "agg_global": "SELECT count(*) AS n, min(l_shipdate) AS a, max(l_shipdate) AS b, round(avg(l_discount), 9) AS d FROM lineitem",
    "agg_empty": "SELECT count(*) AS n, sum(l_quantity) AS s, bool_and(l_quantity > 0) AS b FROM lineitem WHERE l_quantity < 0",
    "agg_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, round(avg(l_extendedprice), 6) AS p FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_expression": "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)",
    "agg_group_all": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "rollup": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, sum(l_quantity) FILTER (WHERE l_discount = 0) AS q FROM lineitem GROUP BY l_returnflag",
    "agg_order": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS s, array_agg(n_nationkey ORDER BY n_nationkey) AS l, first(n_name ORDER BY n_nationkey) AS f, last(n_name ORDER BY n_nationkey) AS z FROM nation GROUP BY n_regionkey",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "pivot": "SELECT * FROM (SELECT l_linestatus, l_returnflag, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_returnflag IN ('A', 'N', 'R'))",
    "unpivot": "SELECT * FROM (SELECT p_partkey, p_size AS size, CAST(floor(p_retailprice) AS INTEGER) AS price FROM part) UNPIVOT INCLUDE NULLS (amount FOR what IN (size, price))",
    "agg_moments": "SELECT l_returnflag, round(stddev(l_quantity), 6) AS a, round(stddev_pop(l_quantity), 6) AS b, round(variance(l_quantity), 6) AS c, round(var_pop(l_quantity), 6) AS d, round(skewness(l_extendedprice), 6) AS s, round(kurtosis(l_extendedprice), 6) AS k FROM lineitem GROUP BY l_returnflag",
    "agg_bool_bit": "SELECT l_returnflag, bool_and(l_quantity > 0) AS a, bool_or(l_quantity > 49) AS o, bit_and(l_linenumber) AS x, bit_or(l_linenumber) AS y, bit_xor(l_orderkey) AS z FROM lineitem GROUP BY l_returnflag",
    "agg_median": "SELECT l_returnflag, median(l_quantity) AS m, quantile_cont(l_extendedprice, 0.25) AS q FROM lineitem GROUP BY l_returnflag",
    "agg_percentile": "SELECT l_returnflag, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS c, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS d FROM lineitem GROUP BY l_returnflag",
    "agg_quantile": "SELECT quantile(l_quantity, 0.3) AS q FROM lineitem",
    "agg_covariance": "SELECT l_returnflag, round(covar_pop(l_quantity, l_discount), 8) AS p, round(covar_samp(l_quantity, l_discount), 8) AS s, round(corr(l_quantity, l_extendedprice), 8) AS c FROM lineitem GROUP BY l_returnflag",
    "agg_regression": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 4) AS ic, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx, round(regr_sxy(l_extendedprice, l_quantity), 0) AS sxy FROM lineitem",
    "agg_arg": "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS a, min_by(o_orderkey, o_totalprice) AS b FROM orders GROUP BY o_orderstatus",
    "agg_any_value": "SELECT n_regionkey, any_value(n_regionkey) AS v FROM nation GROUP BY n_regionkey",
    "agg_product": "SELECT n_regionkey, round(product(n_nationkey + 1), 3) AS p FROM nation GROUP BY n_regionkey",
    "agg_count_if": "SELECT o_orderstatus, CAST(count_if(o_totalprice > 200000) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus",
    "agg_fsum": "SELECT l_returnflag, round(fsum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag",
    "agg_list_distinct": "SELECT n_regionkey, list(DISTINCT n_regionkey) AS l FROM nation GROUP BY n_regionkey",
    # windows
    "window_rank": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS d FROM orders",
    "window_share": "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 9) AS p, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 9) AS c, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS n FROM orders",
    "window_lag": "SELECT o_orderkey, lag(o_orderkey) OVER w AS a, lag(o_orderkey, 2, -1) OVER w AS b, lead(o_totalprice) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_value": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS s, count(*) OVER (PARTITION BY o_custkey) AS n, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 1) AS a, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders",
    "window_rows": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders",
    "window_range": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM lineitem",
    # order and limit
    "sort": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
    "sort_nulls": "SELECT x FROM (VALUES (3), (NULL), (1)) t(x) ORDER BY x NULLS FIRST",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100",
    "top_k": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
    "top_k_group": "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3",
    # set operations
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "except_all": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    "set_nested": "(SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region) UNION ALL SELECT 100 ORDER BY k",
    # subqueries
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "in_subquery": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "not_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 45)",
    "correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "derived": "SELECT avg(n) AS a FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n",
    "cte_columns": "WITH t(a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT a, b FROM t WHERE a < 5",
    "cte_recursive": "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a FROM f",
    # strings
    "fn_case": "SELECT lower(p_name) AS l, upper(p_name) AS u, length(p_name) AS n, reverse(p_name) AS r FROM part",
    "fn_trim": "SELECT trim('  a ') AS a, ltrim('  a ') AS b, rtrim('  a ') AS c, repeat('ab', 3) AS d, lpad('7', 3, '0') AS e, rpad('7', 3, '.') AS f, concat('a', NULL, 'b') AS g, concat_ws('-', 'a', NULL, 'b') AS h",
    "fn_substring": "SELECT substring(p_name, 2, 3) AS a, left(p_name, 3) AS b, right(p_name, 3) AS c, instr(p_name, 'r') AS d, split_part(p_name, ' ', 2) AS e, replace(p_name, ' ', '_') AS f FROM part",
    "fn_characters": "SELECT ascii(p_name) AS a, chr(65 + p_size % 26) AS c, unicode(p_name) AS u, translate(p_name, 'abc', 'xyz') AS t FROM part",
    "fn_accents": "SELECT strip_accents('héllo wörld') AS s",
    "fn_tests": "SELECT starts_with(p_name, 'red') AS a, ends_with(p_name, 'ring') AS b, contains(p_name, 'wid') AS c, prefix(p_name, 'b') AS d, suffix(p_name, 't') AS e FROM part",
    "fn_split": "SELECT string_split(p_name, ' ') AS a, len(string_split(p_name, ' ')) AS n FROM part",
    "fn_printf": "SELECT printf('%s:%d', p_brand, p_size) AS s FROM part",
    # regular expressions
    "fn_regexp": "SELECT regexp_matches(p_name, '^(red|blue)') AS m, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS e, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r FROM part",
    "fn_regexp_split": "SELECT regexp_split_to_array(p_name, ' +') AS a FROM part",
    # lists
    "fn_list_basic": "SELECT list_value(1, 2, 3) AS a, list_extract([5, 6, 7], 2) AS b, list_concat([1], [2]) AS c, list_contains([1, 2], 2) AS d, list_position([4, 5], 5) AS e, array_slice([1, 2, 3, 4], 2, 3) AS f",
    "fn_list_change": "SELECT list_append([1], 2) AS a, list_prepend(0, [1]) AS b, list_reverse([1, 2, 3]) AS c, list_sort([3, 1, 2]) AS d, list_sort(list_distinct([1, 1, 2])) AS e, flatten([[1], [2, 3]]) AS f",
    "fn_list_aggregate": "SELECT CAST(list_sum([1, 2, 3]) AS DOUBLE) AS a, list_avg([1.0, 2.0]) AS b, list_min([3, 1]) AS c, list_max([3, 1]) AS d, array_to_string(['a', 'b'], '-') AS h",
    "fn_list_series": "SELECT generate_series(1, 5) AS a, range(1, 5) AS b",
    # maps and structs
    "fn_map": "SELECT map_keys(map(['a', 'b'], [1, 2])) AS k, map_values(map(['a', 'b'], [1, 2])) AS v, CAST(cardinality(map(['a'], [1])) AS BIGINT) AS c, map_contains(map(['a'], [1]), 'a') AS h",
    # numbers
    "fn_round": "SELECT abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal, 1) AS r, trunc(c_acctbal) AS t, CAST(sign(c_acctbal) AS INTEGER) AS s FROM customer",
    "fn_power": "SELECT round(power(p_size, 2), 6) AS p, round(sqrt(p_size), 9) AS s, round(cbrt(p_size), 9) AS c, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS l10, round(log2(p_size), 9) AS l2, round(exp(p_size / 50), 9) AS e, mod(p_size, 7) AS m FROM part",
    "fn_trigonometry": "SELECT round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size), 6) AS c, round(asin(p_size / 100), 9) AS d, round(acos(p_size / 100), 9) AS e, round(atan(p_size), 9) AS f, round(atan2(p_size, 3), 9) AS g, round(sinh(p_size / 50), 9) AS h, round(cosh(p_size / 50), 9) AS i, round(tanh(p_size), 9) AS j, round(degrees(p_size), 6) AS k, round(radians(p_size), 9) AS l, round(pi(), 9) AS m FROM part",
    "fn_integers": "SELECT gcd(p_size, 12) AS g, lcm(p_size, 12) AS l, CAST(factorial(p_size % 15) AS BIGINT) AS f, even(p_size + 0.5) AS e, CAST(bit_count(p_size) AS INTEGER) AS b FROM part",
    "fn_float": "SELECT isnan(p_retailprice) AS a, isinf(p_retailprice) AS b, isfinite(p_retailprice) AS c, round(lgamma(p_size + 1), 8) AS g, nextafter(p_retailprice, 0) AS n, signbit(-p_retailprice) AS s FROM part",
    # bits, hashes, encodings
    "fn_bits": "SELECT xor(p_size, 3) AS x, bit_length(p_name) AS l, octet_length(CAST(p_name AS BLOB)) AS o, CAST(bin(p_size) AS VARCHAR) AS b FROM part",
    "fn_md5": "SELECT md5(p_name) AS m FROM part",
    "fn_hex": "SELECT lower(hex(p_name)) AS h, to_base64(CAST(p_name AS BLOB)) AS b FROM part",
    # similarity
    "fn_similarity": "SELECT levenshtein(p_name, p_type) AS l, round(jaro_similarity(p_name, p_type), 9) AS j, hamming(left(p_name, 4), left(p_type, 4)) AS h FROM part",
    # conditions
    "fn_conditions": "SELECT greatest(p_size, 10, NULL) AS g, least(p_size, 10) AS l, coalesce(NULL, p_size) AS c, nullif(p_size, 5) AS n, ifnull(NULL, 1) AS i FROM part",
    # dates and times
    "fn_date_parts": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, week(o_orderdate) AS w, dayofyear(o_orderdate) AS doy, dayofweek(o_orderdate) AS dow, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, last_day(o_orderdate) AS ld FROM orders",
    "fn_time_parts": "SELECT hour(ts) AS h, minute(ts) AS m, second(ts) AS s, date_part('hour', ts) AS p, epoch_us(ts) AS u, epoch_ms(ts) AS ms FROM events",
    "fn_date_trunc": "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w FROM events",
    "fn_date_diff": "SELECT date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS d, CAST(date_diff('month', o_orderdate, TIMESTAMP '2000-01-01') AS BIGINT) AS m, make_date(2024, 2, 29) AS k FROM orders",
    "fn_time_bucket": "SELECT time_bucket(INTERVAL '15 minutes', ts) AS b, count(*) AS n FROM events GROUP BY time_bucket(INTERVAL '15 minutes', ts)",
    "fn_strftime": "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events",
    # JSON
    "fn_json": "SELECT json_extract_string(props, '$.k') AS k, json_valid(props) AS v, json_type(props) AS t, json_keys(props) AS ks FROM events",
    "fn_json_array": "SELECT CAST(json_array_length('[1, 2, 3]') AS BIGINT) AS n, CAST(json_merge_patch('{\"a\":1,\"b\":2}', '{\"b\":null,\"c\":3}') AS VARCHAR) AS m",
    # decision support over the star schema
    "tpch_q3": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'MACHINERY' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q12": "SELECT o_orderpriority, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN l_quantity <= 25 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
    "tpch_q18": "SELECT c_name, o_orderkey, sum(l_quantity) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, o_orderkey",
}

#: Where the other database spells it otherwise, or means something else by the name.
ITS: dict[str, str] = {
    # It rounds to milliseconds.
    "fn_time_parts": SQL["fn_time_parts"].replace("epoch_ms(ts)", "epoch_us(ts) // 1000"),
}


def named(sql: str) -> tuple[str, ...]:
    """The tables that a text names."""
    return tuple(t for t in TABLES if re.search(rf"\b{t}\b", sql))


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).attach(sf_dir, named(sql)).sql(sql)

    return run


QUERIES = {name: _query(sql) for name, sql in SQL.items()}
ORACLE = {name: ITS.get(name, sql) for name, sql in SQL.items()}
