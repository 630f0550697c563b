"""End-to-end SQL: statements, errors, NULL logic, atomicity, indexes, durability."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larkspur import Engine
from larkspur import errors as e
from larkspur.plans import nodes as n
from larkspur.plans.parser import parse


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/data")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def users(engine):
    engine.sql("CREATE TABLE users (name TEXT, age INT)")
    engine.sql("INSERT INTO users VALUES ('alice', 35), ('bob', 22)")
    return engine


# -- the reference scenarios ---------------------------------------------------------------


def test_filter_and_project(users):
    df = users.sql("SELECT name FROM users WHERE age > 30")
    assert df.columns == ["name"] and rows(df) == [("alice",)]


def test_unknown_column(users):
    with pytest.raises(e.ColumnNotFoundError) as error:
        users.sql("SELECT ghost FROM users")
    assert error.value.name == "ghost"


def test_insert_then_read(users):
    assert users.sql("INSERT INTO users (name, age) VALUES ('eve', 41)").columns == []
    assert rows(users.sql("SELECT name FROM users WHERE age > 40")) == [("eve",)]


def test_float_filter(engine):
    engine.sql("CREATE TABLE metrics (label TEXT, score FLOAT)")
    engine.sql("INSERT INTO metrics VALUES ('a', 4.0)")
    assert rows(engine.sql("SELECT label FROM metrics WHERE score > 3.0")) == [("a",)]


def test_literal_sum(users):
    assert users.sql("SELECT name FROM users WHERE age > 20 + 1").count() == 2


def test_too_many_values(engine):
    engine.sql("CREATE TABLE one (name TEXT)")
    with pytest.raises(e.ColumnCountMismatchError) as error:
        engine.sql("INSERT INTO one VALUES ('a', 'b')")
    assert (error.value.expected, error.value.actual) == (1, 2)


def test_reopen(users):
    again = Engine(users.spark, users.catalog.data_dir)
    assert rows(again.sql("SELECT name FROM users")) == [("alice",), ("bob",)]


# -- plans ---------------------------------------------------------------------------------


def test_plan_of_select():
    assert parse("SELECT name, age FROM users") == n.Project(n.Scan("users"), ("name", "age"))
    where = n.Binary(">", n.Column("salary"), n.Literal(22.5, n.FLOAT))
    assert parse("SELECT name FROM users WHERE salary > 22.5;") == n.Project(n.Filter(n.Scan("users"), where), ("name",))


def test_precedence():
    expr = parse("SELECT a FROM t WHERE a = 1 OR b = 2 AND c = 3 + 4 IS NULL").input.predicate
    assert expr.op == "OR" and expr.right.op == "AND"
    assert expr.right.right == n.IsNull(n.Binary("=", n.Column("c"), n.Binary("+", n.Literal(3, n.INT), n.Literal(4, n.INT))))


@pytest.mark.parametrize(
    "text",
    [
        "", "SELECT 1", "SELECT * FROM t", "SELECT a AS b FROM t", "SELECT t.a FROM t", "SELECT a + 1 FROM t", "SELECT count(a) FROM t", "SELECT a FROM t, u", "SELECT a FROM t JOIN u ON a = b",
        "SELECT a FROM t x", "SELECT a FROM (SELECT a FROM t)", "SELECT a FROM t ORDER BY a", "SELECT a FROM t WHERE a = 1 LIMIT 1", "SELECT DISTINCT a FROM t", "SELECT a FROM t GROUP BY a",
        "SELECT a FROM t UNION SELECT a FROM u", "WITH x AS (SELECT a FROM t) SELECT a FROM x", "SELECT a FROM t; SELECT a FROM t", "SELECT a FROM t WHERE NOT a", "SELECT a FROM t WHERE a = -1",
        "SELECT a FROM t WHERE a * 2 = 4", "SELECT a FROM t WHERE a BETWEEN 1 AND 2", "SELECT a FROM t WHERE a IN (1)", "SELECT a FROM t WHERE a LIKE 'x'", "SELECT a FROM t WHERE f(a) = 1",
        "SELECT a FROM t WHERE a = (SELECT a FROM t)", "INSERT INTO t SELECT a FROM u", "INSERT INTO t VALUES (1 + 1)", "UPDATE t SET a = b", "UPDATE t x SET a = 1", "CREATE TABLE t (a DATE)", "CREATE TABLE t (a DOUBLE PRECISION)",
        "CREATE TABLE t (a INT PRIMARY KEY)", "CREATE TABLE t (a INT DEFAULT 1)", "CREATE TABLE IF NOT EXISTS t (a INT)", "CREATE TABLE t (a INT, UNIQUE (a))", "CREATE INDEX ON t (a)",
        "CREATE INDEX i ON t (a, b)", "CREATE INDEX i ON t ()", "CREATE UNIQUE INDEX i ON t (a)", "DROP TABLE t", "BEGIN", "EXPLAIN SELECT a FROM t",
    ],
)
def test_unsupported(text):
    with pytest.raises(e.UnsupportedError):
        parse(text)


@pytest.mark.parametrize("text", ["SELECT a FROM", "SELECT a FROM t WHERE", "INSERT t VALUES (1)", "SELECT a FROM t WHERE a = 'x", "UPDATE t SET a 1", "CREATE TABLE t (a INT", "SELECT a FROM t WHERE (a = 1"])
def test_parse_errors(text):
    with pytest.raises(e.ParseError):
        parse(text)


# -- types ---------------------------------------------------------------------------------

_OPERANDS = {n.INT: "i", n.FLOAT: "f", n.TEXT: "t", n.BOOL: "b", n.NULL: "NULL"}


def _allowed(op, a, b):
    if op in ("AND", "OR"):
        return n.NULL in (a, b) or a == b == n.BOOL
    if n.NULL in (a, b):
        return True
    return a == b and (op in ("=", "<>") or op == "+" and a in (n.INT, n.FLOAT) or op in ("<", "<=", ">", ">=") and a != n.BOOL)


@pytest.fixture(scope="module")
def typed(spark, tmp_path_factory):
    engine = Engine(spark, f"file://{tmp_path_factory.mktemp('typed')}/data")
    engine.sql("CREATE TABLE x (i INT, f FLOAT, t TEXT, b BOOL)")
    return engine


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">=", "+", "AND", "OR"])
def test_type_matrix(typed, op):
    for a, b in itertools.product(_OPERANDS, repeat=2):
        text = f"SELECT i FROM x WHERE ({_OPERANDS[a]} {op} {_OPERANDS[b]}) IS NULL"
        if _allowed(op, a, b):
            typed.sql(text)
        else:
            with pytest.raises(e.TypeMismatchError):
                typed.sql(text)


@pytest.mark.parametrize("where", ["i", "i + 1", "t", "f"])
def test_where_needs_bool(typed, where):
    for text in (f"SELECT i FROM x WHERE {where}", f"DELETE FROM x WHERE {where}", f"UPDATE x SET i = 1 WHERE {where}"):
        with pytest.raises(e.TypeMismatchError):
            typed.sql(text)


def test_where_null_keeps_nothing(users):
    assert users.sql("SELECT name FROM users WHERE NULL").count() == 0
    assert users.sql("SELECT name FROM users WHERE NULL AND 5").count() == 0
    assert rows(users.sql("DELETE FROM users WHERE NULL")) == [(0,)]


def test_no_coercion_on_insert(typed):
    for values in ("(1.0, 1.0, 'a', TRUE)", "(1, 1, 'a', TRUE)", "(1, 1.0, 1, TRUE)", "(1, 1.0, 'a', 1)"):
        with pytest.raises(e.TypeMismatchError):
            typed.sql(f"INSERT INTO x VALUES {values}")


def test_literals(engine):
    engine.sql("CREATE TABLE big (i INT, f FLOAT, t VARCHAR(2))")
    engine.sql("INSERT INTO big VALUES (9223372036854775807, 1e999, 'it''s long'), (0, 9223372036854775808, '')")
    assert rows(engine.sql("SELECT i, f, t FROM big")) == [(0, 2.0**63, ""), (2**63 - 1, float("inf"), "it's long")]


def test_names(engine):
    engine.sql('CREATE TABLE "my.t" (Name TEXT, `odd name` INT)')
    engine.sql('INSERT INTO my.t ("odd name", Name) VALUES (1, \'x\')')
    assert rows(engine.sql('SELECT "odd name", Name FROM my.t WHERE `odd name` = 1')) == [(1, "x")]
    with pytest.raises(e.ColumnNotFoundError):
        engine.sql("SELECT name FROM my.t")
    with pytest.raises(e.TableNotFoundError):
        engine.sql("SELECT Name FROM MY.T")
    with pytest.raises(e.UnsupportedError):
        engine.sql("CREATE TABLE two (a INT, A INT)")


# -- changes -------------------------------------------------------------------------------


def test_counts_and_old_values(users):
    users.sql("INSERT INTO users VALUES (NULL, 35), ('zoe', NULL)")
    assert rows(users.sql("UPDATE users SET age = 36, name = 'x' WHERE age = 35")) == [(2,)]
    assert rows(users.sql("UPDATE users SET age = 1, age = 2 WHERE name = 'x'")) == [(2,)]
    assert rows(users.sql("SELECT name, age FROM users")) == [("bob", 22), ("x", 2), ("x", 2), ("zoe", None)]
    assert rows(users.sql("DELETE FROM users WHERE age < 100")) == [(3,)]
    assert rows(users.sql("DELETE FROM users")) == [(1,)]
    assert users.sql("SELECT name FROM users").count() == 0
    assert rows(users.sql("UPDATE users SET age = 1")) == [(0,)]


def test_failed_statements_change_nothing(engine):
    engine.sql("CREATE TABLE strict (id INT NOT NULL, note TEXT)")
    engine.sql("INSERT INTO strict VALUES (1, 'a')")
    for text, error in [
        ("INSERT INTO strict VALUES (2, 'b'), (NULL, 'c')", e.TypeMismatchError),
        ("INSERT INTO strict VALUES (2, 'b'), (3)", e.ColumnCountMismatchError),
        ("INSERT INTO strict (id) VALUES (2)", e.MissingColumnError),
        ("INSERT INTO strict (id, ghost) VALUES (2, 'b')", e.ColumnNotFoundError),
        ("INSERT INTO strict (id, note, note) VALUES (2, 'b', 'c')", e.ColumnCountMismatchError),
        ("UPDATE strict SET id = NULL", e.TypeMismatchError),
        ("UPDATE strict SET note = 1", e.TypeMismatchError),
        ("UPDATE strict SET ghost = 1", e.ColumnNotFoundError),
        ("INSERT INTO nowhere VALUES (1)", e.TableNotFoundError),
        ("CREATE TABLE strict (a INT)", e.TableAlreadyExistsError),
        ("CREATE INDEX i ON strict (ghost)", e.ColumnNotFoundError),
    ]:
        with pytest.raises(error):
            engine.sql(text)
    assert rows(engine.sql("SELECT id, note FROM strict")) == [(1, "a")]


def test_queries_keep_their_snapshot(users):
    before = users.sql("SELECT name FROM users")
    users.sql("DELETE FROM users")
    assert rows(before) == [("alice",), ("bob",)]


def test_only_touched_files_are_rewritten(users):
    users.sql("INSERT INTO users VALUES ('carl', 50)")
    first, second = users.catalog.tables["users"].files
    users.sql("UPDATE users SET age = 51 WHERE name = 'carl'")
    files = users.catalog.tables["users"].files
    assert first in files and second not in files


def test_registered_tables_are_read_only(engine, spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "k").write.parquet(f"{tmp_path}/t")
    engine.register_parquet("t", f"{tmp_path}/t")
    assert engine.sql("SELECT k FROM t WHERE k > 0").count() == 2
    with pytest.raises(e.UnsupportedError):
        engine.sql("DELETE FROM t")


def test_overflow_is_an_error(engine, spark):
    engine.sql("CREATE TABLE big (i INT)")
    engine.sql("INSERT INTO big VALUES (9223372036854775807)")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    with pytest.raises(Exception, match="OVERFLOW"):
        engine.sql("SELECT i FROM big WHERE i + 1 > 0").collect()


def test_pushdown(users, capsys):
    users.sql("SELECT name FROM users WHERE age > 20 + 1").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(age,21)" in plan and "ReadSchema: struct<name:string,age:bigint>" in plan


# -- indexes -------------------------------------------------------------------------------


def test_access_path(users):
    users.sql("CREATE INDEX by_age ON users (age)")
    for where, path in [
        ("age = 3", "IndexScan"), ("3 = age", "IndexScan"), ("age IS NULL", "IndexScan"), ("age < 3", "RangeIndexScan"), ("3 >= age", "RangeIndexScan"), ("age IS NOT NULL", "RangeIndexScan"),
        ("age = 1 + 2", "IndexScan"), ("age = NULL", "SeqScan"), ("age <> 3", "SeqScan"), ("age > 1 AND age < 3", "SeqScan"), ("name = 'x'", "SeqScan"),
    ]:
        assert users.access_path(f"SELECT name FROM users WHERE {where}") == path, where
    with pytest.raises(e.TableAlreadyExistsError):
        users.sql("CREATE INDEX by_age ON users (name)")


_VALUE = st.one_of(st.none(), st.integers(0, 4))


def _three_valued(op, a, b):
    if op == "AND":
        return False if a is False or b is False else None if a is None or b is None else True
    if op == "OR":
        return True if a is True or b is True else None if a is None or b is None else False
    if a is None or b is None:
        return None
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


@st.composite
def _predicate(draw, depth=2):
    if depth and draw(st.booleans()):
        op, (a, f), (b, g) = draw(st.sampled_from(["AND", "OR"])), draw(_predicate(depth=depth - 1)), draw(_predicate(depth=depth - 1))
        return f"({a} {op} {b})", lambda row: _three_valued(op, f(row), g(row))
    column = draw(st.sampled_from(["a", "b"]))
    if draw(st.booleans()):
        negated = draw(st.booleans())
        return f"{column} IS {'NOT ' * negated}NULL", lambda row: (row[column] is None) != negated
    op, value = draw(st.sampled_from(["=", "<>", "<", "<=", ">", ">="])), draw(_VALUE)
    return f"{column} {op} {'NULL' if value is None else value}", lambda row: _three_valued(op, row[column], value)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(_VALUE, _VALUE), min_size=1, max_size=8), st.lists(_predicate(), min_size=1, max_size=4))
def test_random_predicates_with_and_without_index(spark, tmp_path_factory, data, predicates):
    engine = Engine(spark, f"file://{tmp_path_factory.mktemp('random')}/data")
    engine.sql("CREATE TABLE t (a INT, b INT)")
    shown = lambda v: "NULL" if v is None else str(v)
    engine.sql("INSERT INTO t VALUES " + ", ".join(f"({shown(a)}, {shown(b)})" for a, b in data))
    for index in (False, True):
        if index:
            engine.sql("CREATE INDEX i ON t (a)")
        for text, holds in predicates:
            expected = sorted([x for x in data if holds(dict(zip("ab", x, strict=True))) is True], key=repr)
            assert rows(engine.sql(f"SELECT a, b FROM t WHERE {text}")) == expected, text


# -- long predicates, upkeep of files, several engines ---------------------------------------


def test_long_predicates(users):
    ors = " OR ".join(f"age = {k}" for k in range(1000, 3000))
    assert [r.name for r in users.sql(f"SELECT name FROM users WHERE {ors} OR age = 22").collect()] == ["bob"]
    assert users.sql("SELECT name FROM users WHERE " + " AND ".join(["age > 20"] * 1500)).count() == 2
    assert users.access_path(f"SELECT name FROM users WHERE {ors}") == "SeqScan"
    assert users.sql("SELECT name FROM users WHERE " + "(" * 90 + "age = 22" + ")" * 90).count() == 1
    assert users.sql("SELECT name FROM users WHERE NULL OR NULL OR age = 22 OR NULL AND age > 100").count() == 1
    for where in ("(" * 600 + "age = 22" + ")" * 600, "age = " + " + ".join(["1"] * 600), "age" + " IS NULL" * 600):
        with pytest.raises(e.UnsupportedError):
            users.sql(f"SELECT name FROM users WHERE {where}")
    with pytest.raises(e.TypeMismatchError):
        users.sql(f"SELECT name FROM users WHERE {ors} OR name = 1")


def test_compaction_and_vacuum(engine):
    engine.sql("CREATE TABLE t (k INT, s TEXT)")
    for k in range(6):
        engine.sql(f"INSERT INTO t VALUES ({9 - k}, 'x'), ({k}, NULL)")
    rows = lambda: sorted((r.k, r.s or "") for r in engine.sql("SELECT k, s FROM t").collect())
    before = rows()
    assert len(engine.catalog.table("t").files) == 6 and engine.compact("t") == 1 and rows() == before
    assert engine.vacuum("t") == 6 and rows() == before and engine.vacuum("t") == 0
    engine.sql("UPDATE t SET s = 'y' WHERE k = 0")
    engine.sql("DELETE FROM t WHERE k = 1")
    after = rows()
    assert engine.vacuum("t") == 2 and rows() == after and engine.compact("t") == 1
    engine.sql("DELETE FROM t")
    assert rows() == [] and engine.compact("t") <= 1 and engine.vacuum("t") >= 1


def test_new_files_are_sorted_by_the_latest_index(engine, spark):
    engine.sql("CREATE TABLE t (k INT, s TEXT)")
    engine.sql("CREATE INDEX a ON t (k)")
    engine.sql("INSERT INTO t VALUES (3, 'a'), (1, 'c'), (NULL, 'd'), (2, 'b')")
    stored = lambda: [[tuple(r) for r in engine.catalog.scan(engine.catalog.table("t"), [x]).collect()] for x in engine.catalog.table("t").files]
    assert stored() == [[(1, "c"), (2, "b"), (3, "a"), (None, "d")]]
    engine.sql("CREATE INDEX b ON t (s)")
    engine.sql("INSERT INTO t VALUES (9, 'z'), (8, 'y')")
    assert all(rows == sorted(rows, key=lambda r: r[1]) for rows in stored())
    engine.sql("UPDATE t SET k = 0 WHERE k > 1")
    assert all(rows == sorted(rows, key=lambda r: r[1]) for rows in stored())


def test_two_engines_on_one_folder(engine, spark):
    engine.sql("CREATE TABLE t (k INT)")
    other = Engine(spark, engine.catalog.data_dir)
    other.sql("INSERT INTO t VALUES (1)")
    with pytest.raises(e.ConcurrentChangeError):
        engine.sql("INSERT INTO t VALUES (2)")
    assert [r.k for r in Engine(spark, engine.catalog.data_dir).sql("SELECT k FROM t").collect()] == [1]


def test_plans_are_told(users):
    users.sql("CREATE INDEX i ON users (age)")
    assert users.plan("SELECT name FROM users WHERE age = 22").endswith("via IndexScan") and "Scan" in users.plan("SELECT name FROM users")
    assert "Delete" in users.plan("DELETE FROM users")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from larkspur.sources.storage import shared_folder

    session = lambda master, conf: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077", {}))
    assert shared_folder(session("yarn", {"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert shared_folder(session("local[4]", {})).startswith("file://")
