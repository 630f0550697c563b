"""The SQL engine's registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.engine import Engine
from larkspur.sources.storage import scratch

#: name: (table, SELECT). The oracle runs the same text.
SELECTS = {
    "scan_region": ("region", "SELECT r_regionkey, r_name FROM region"),
    "project_reorder_nation": ("nation", "SELECT n_regionkey, n_name, n_nationkey FROM nation"),
    "filter_int_eq": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 30"),
    "filter_int_ne": ("orders", "SELECT o_orderkey FROM orders WHERE o_custkey <> 30"),
    "filter_int_lt": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 30"),
    "filter_int_le": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <= 30"),
    "filter_int_gt": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 30"),
    "filter_int_ge": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 30"),
    "filter_float_eq": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = 22.0"),
    "filter_float_ne": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity != 22.0"),
    "filter_float_lt": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3.5"),
    "filter_float_le": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 3.0"),
    "filter_float_gt": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 48.5"),
    "filter_float_ge": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 4.9e1"),
    "filter_text_eq": ("orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "filter_text_ne": ("orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'"),
    "filter_text_lt": ("orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority < '2'"),
    "filter_text_le": ("orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <= '5-LOW'"),
    "filter_text_gt": ("orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > '4'"),
    "filter_text_ge": ("orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '5-LOW'"),
    "filter_and": ("orders", "SELECT o_orderkey FROM orders WHERE o_custkey > 30 AND o_orderpriority = '1-URGENT'"),
    "filter_or": ("orders", "SELECT o_orderkey FROM orders WHERE o_custkey = 30 OR o_totalprice > 400000.0"),
    "filter_and_or_precedence": ("orders", "SELECT o_orderkey FROM orders WHERE o_custkey = 30 OR o_custkey = 31 AND o_totalprice > 100000.0"),
    "filter_parentheses": ("orders", "SELECT o_orderkey FROM orders WHERE (o_custkey = 30 OR o_custkey = 31) AND o_totalprice > 100000.0"),
    "filter_int_add": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 20 + 1"),
    "filter_float_add": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount + l_tax > 0.125 + 0.02"),
    "filter_column_add": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey + 1 = 2"),
    "filter_col_vs_col": ("lineitem", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey > l_partkey"),
    "filter_literal_left": ("customer", "SELECT c_custkey, c_name FROM customer WHERE 30 < c_custkey"),
    "filter_narrow_int": ("nation", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey + 1 = 3"),
    "filter_const_true": ("nation", "SELECT n_name FROM nation WHERE 1 = 1"),
    "filter_const_false": ("nation", "SELECT n_name FROM nation WHERE FALSE"),
    "filter_eq_null": ("nation", "SELECT n_name FROM nation WHERE n_regionkey = NULL"),
    "filter_is_not_null": ("orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL"),
    "filter_is_null": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IS NULL"),
}

_PEOPLE = (
    "CREATE TABLE people (id INT NOT NULL, name TEXT, age INT, score FLOAT, active BOOL)",
    "INSERT INTO people VALUES (1, 'alice', 35, 1.5, TRUE), (2, 'bob', 22, 2.5, FALSE), (3, 'carol', NULL, 3.5, NULL)",
    "INSERT INTO people VALUES (4, NULL, 41, NULL, TRUE), (5, 'eve', 35, 5.0, FALSE), (6, 'frank', NULL, NULL, NULL)",
)
_PEOPLE_SQL = (
    "(VALUES (1::BIGINT, 'alice', 35::BIGINT, 1.5::DOUBLE, TRUE), (2, 'bob', 22, 2.5, FALSE), (3, 'carol', NULL, 3.5, NULL), "
    "(4, NULL, 41, NULL, TRUE), (5, 'eve', 35, 5.0, FALSE), (6, 'frank', NULL, NULL, NULL)) AS people(id, name, age, score, active)"
)
_ALL = "SELECT id, name, age, score, active FROM people"
_INDEX = "CREATE INDEX by_age ON people (age)"

#: name: (statements after the table is filled, oracle). The last statement's rows are the result.
CHANGES = {
    "create_insert_select": ((_ALL,), f"SELECT * FROM {_PEOPLE_SQL}"),
    "insert_column_reorder": (
        ("INSERT INTO people (active, score, age, name, id) VALUES (TRUE, 7.0, 70, 'grace', 7)", f"{_ALL} WHERE id > 5"),
        "SELECT * FROM (VALUES (6::BIGINT, 'frank', NULL::BIGINT, NULL::DOUBLE, NULL::BOOLEAN), (7, 'grace', 70, 7.0, TRUE)) AS t(id, name, age, score, active)",
    ),
    "update_where": (("UPDATE people SET score = 9.0, age = 36 WHERE age = 35", _ALL), f"SELECT id, name, CASE WHEN age = 35 THEN 36 ELSE age END AS age, CASE WHEN age = 35 THEN 9.0 ELSE score END AS score, active FROM {_PEOPLE_SQL}"),
    "update_count": (("UPDATE people SET score = 9.0 WHERE age > 30",), f"SELECT count(*)::BIGINT AS updated FROM {_PEOPLE_SQL} WHERE age > 30"),
    "update_all": (("UPDATE people SET name = 'x'", _ALL), f"SELECT id, 'x' AS name, age, score, active FROM {_PEOPLE_SQL}"),
    "update_set_null_then_is_null": (("UPDATE people SET age = NULL WHERE id = 1", "SELECT id FROM people WHERE age IS NULL"), f"SELECT id FROM {_PEOPLE_SQL} WHERE age IS NULL OR id = 1"),
    "delete_where": (("DELETE FROM people WHERE age > 30", _ALL), f"SELECT * FROM {_PEOPLE_SQL} WHERE NOT coalesce(age > 30, FALSE)"),
    "delete_count": (("DELETE FROM people WHERE age > 30",), f"SELECT count(*)::BIGINT AS deleted FROM {_PEOPLE_SQL} WHERE age > 30"),
    "delete_all": (("DELETE FROM people", "SELECT id, name FROM people"), f"SELECT id, name FROM {_PEOPLE_SQL} WHERE FALSE"),
    "nulls_three_valued_and": (("SELECT id FROM people WHERE age > 30 AND active",), f"SELECT id FROM {_PEOPLE_SQL} WHERE age > 30 AND active"),
    "nulls_three_valued_or": (("SELECT id FROM people WHERE age > 30 OR active = FALSE",), f"SELECT id FROM {_PEOPLE_SQL} WHERE age > 30 OR active = FALSE"),
    "nulls_comparison_is_null": (("SELECT id FROM people WHERE (age > 30) IS NULL",), f"SELECT id FROM {_PEOPLE_SQL} WHERE (age > 30) IS NULL"),
    "bool_eq": (("SELECT id FROM people WHERE active = TRUE",), f"SELECT id FROM {_PEOPLE_SQL} WHERE active = TRUE"),
    "bool_ne": (("SELECT id FROM people WHERE active <> TRUE",), f"SELECT id FROM {_PEOPLE_SQL} WHERE active <> TRUE"),
    "index_eq": ((_INDEX, f"{_ALL} WHERE age = 35"), f"SELECT * FROM {_PEOPLE_SQL} WHERE age = 35"),
    "index_range_excludes_null": ((_INDEX, f"{_ALL} WHERE age > 30"), f"SELECT * FROM {_PEOPLE_SQL} WHERE age > 30"),
    "index_is_null": ((_INDEX, f"{_ALL} WHERE age IS NULL"), f"SELECT * FROM {_PEOPLE_SQL} WHERE age IS NULL"),
    "index_is_not_null": ((_INDEX, f"{_ALL} WHERE age IS NOT NULL"), f"SELECT * FROM {_PEOPLE_SQL} WHERE age IS NOT NULL"),
    "index_after_update_delete": (
        (_INDEX, "UPDATE people SET age = 50 WHERE id = 2", "DELETE FROM people WHERE id = 5", f"{_ALL} WHERE age >= 35"),
        f"SELECT * FROM (SELECT id, name, CASE WHEN id = 2 THEN 50 ELSE age END AS age, score, active FROM {_PEOPLE_SQL}) WHERE id <> 5 AND age >= 35",
    ),
}


def _select(table: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.register_parquet(table, f"{sf_dir}/{table}.parquet")
        return engine.sql(text)

    return run


def _change(statements: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, scratch(spark, "sql"))
        for text in (*_PEOPLE, *statements):
            df = engine.sql(text)
        return df

    return run


def _duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select("nation", "SELECT n_name, n_name FROM nation")(spark, sf_dir).toDF("first", "second")


def _reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "sql")
    engine = Engine(spark, folder)
    for text in _PEOPLE:
        engine.sql(text)
    return Engine(spark, folder).sql(_ALL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _select(*x) for name, x in SELECTS.items()}
    out |= {name: _change(statements) for name, (statements, _) in CHANGES.items()}
    return out | {"project_duplicate_column": _duplicate, "reopen_durability": _reopen}


def oracle_sql() -> dict[str, str]:
    out = {name: text for name, (_, text) in SELECTS.items()} | {name: text for name, (_, text) in CHANGES.items()}
    return out | {"project_duplicate_column": "SELECT n_name AS first, n_name AS second FROM nation", "reopen_durability": f"SELECT * FROM {_PEOPLE_SQL}"}
