import pytest

from millrace.__main__ import loop
from millrace.functions import templates
from millrace.operators import aggregates, joins
from millrace.plans.dialect import Rewriter, rewrite, statements
from millrace.plans.engine import Engine


def test_rewrites_clauses():
    assert rewrite("SELECT DISTINCT ON (a) a, b FROM t ORDER BY a, b") == "SELECT * EXCEPT (__at) FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY a NULLS LAST, b NULLS LAST) AS __at FROM t) WHERE __at = 1 ORDER BY a NULLS LAST, b NULLS LAST"
    assert "WHERE __keep" in rewrite("SELECT a FROM t QUALIFY rank() OVER (ORDER BY a) = 1")
    assert rewrite("SELECT * EXCLUDE (a) FROM t") == "SELECT * EXCEPT (a) FROM t"
    assert "LEFT ANTI" in rewrite("SELECT a FROM t ANTI JOIN u ON a = b")
    assert rewrite("SELECT x::VARCHAR FROM t") == "SELECT CAST(x AS string) FROM t"


def test_arguments_keep_their_precedence():
    assert templates.render("fma", ["a + 1", "b", "c"]) == "((a + 1) * b + c)"


def test_brackets_must_match():
    with pytest.raises(ValueError):
        rewrite("SELECT (1 FROM t")


def test_changes_and_helpers(spark):
    e = Engine(spark)
    e.execute_batch("CREATE TABLE t (k INTEGER, s VARCHAR); INSERT INTO t VALUES (1, 'a'), (2, NULL)")
    assert e.execute("UPDATE t SET s = 'z' WHERE s = 'a'").scalar() == 1
    assert e.query_value("SELECT count(*) FROM t WHERE s = 'z'") == 1
    assert sorted(e.query_column("SELECT k FROM t")) == [1, 2]
    assert e.execute("DELETE FROM t WHERE s = 'none'").scalar() == 0
    assert e.execute("SELECT k FROM t WHERE k > 5").is_empty()
    assert "k" in e.execute("SELECT k FROM t").to_table_string()
    assert "Scan" in e.query_value("EXPLAIN SELECT k FROM t WHERE k = 1")
    with pytest.raises(ValueError):
        e.execute("INSERT INTO t (nope) VALUES (1)")
    with pytest.raises(ValueError):
        e.execute("CREATE TABLE t (k INTEGER)")


def test_sequence_ends_and_cycles(spark):
    e = Engine(spark)
    e.execute_batch("CREATE SEQUENCE s START 1 MAXVALUE 2; CREATE SEQUENCE c START 1 MAXVALUE 2 CYCLE")
    assert [e.query_value("SELECT nextval('s')") for _ in range(2)] == [1, 2]
    with pytest.raises(ValueError):
        e.query_value("SELECT nextval('s')")
    assert [e.query_value("SELECT nextval('c')") for _ in range(3)] == [1, 2, 1]


def test_asof_ties_nulls_and_strictness(spark):
    a = spark.createDataFrame([(1, 10), (1, 5), (None, 10), (2, 10), (1, None)], "k int, t int")
    b = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 11, "z"), (None, 1, "n")], "j int, u int, v string")
    rows = {(r["k"], r["t"]): r["v"] for r in joins.asof_join(a, b, [("k", "j")], ("t", "u")).collect()}
    assert rows == {(1, 10): "y", (1, 5): "x", (None, 10): None, (2, 10): None, (1, None): None}
    strict = {(r["k"], r["t"]): r["v"] for r in joins.asof_join(a, b, [("k", "j")], ("t", "u"), ">").collect()}
    assert strict[(1, 5)] is None
    ahead = {(r["k"], r["t"]): r["v"] for r in joins.asof_join(a, b, [("k", "j")], ("t", "u"), "<=", "inner").collect()}
    assert ahead == {(1, 5): "x", (2, 10): "z"}


def test_rowid_is_dense(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v")
    rows = sorted((r["v"], r["rowid"]) for r in aggregates.with_rowid(df, ["v"], partitions=5).collect())
    assert [i for _, i in rows] == list(range(1000))


def test_filters_reach_the_scan(spark):
    e = Engine(spark).attach("/root/testdata/sf0.001", ("lineitem",))
    plan = e.query_value("EXPLAIN SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_prompt(spark):
    said = []
    loop(Engine(spark), ["CREATE TABLE t (a INTEGER);", "INSERT INTO t", "VALUES (5);", "SELECT nosuch FROM t;", "SELECT a + 1 AS b FROM t;", ".tables", ".quit", "SELECT 1;"], said.append)
    assert len(said) == 5 and said[2].startswith("error: ") and said[3].split() == ["b", "-", "6"] and said[4] == "t"


def test_what_is_not_there_is_an_error(spark):
    db = Engine(spark)
    for text in ("DROP TABLE nosuch", "DROP VIEW nosuch", "CREATE TABLE s9.t (a INTEGER)", "SELECT * FROM range(3) POSITIONAL JOIN range(4)"):
        with pytest.raises(ValueError):
            db.sql(text)
    db.execute_batch("DROP TABLE IF EXISTS nosuch; CREATE SCHEMA s9; CREATE TABLE s9.t (a INTEGER)")
    with pytest.raises(ValueError):
        db.sql("DROP SCHEMA s9")
    db.sql("DROP SCHEMA s9 CASCADE")
    assert not db.tables


def test_histogram_counts_before_it_gathers(spark):
    text = Rewriter().query(statements("SELECT k % 2 AS o, histogram(v) AS h FROM t GROUP BY k % 2 ORDER BY o")[0])
    assert "count(*) AS __n" in text and text.count("GROUP BY") == 2
