"""Queries over the engine's own operators, each with the same query in DuckDB's SQL.

Each query builds what it needs in a scratch schema of the session's catalog, so none depends on
another.  Projects are written to a folder of the driver, where commands read them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.model import Freshness, Threshold
from weftline.operators import checks, freshness, unit_tests
from weftline.runner import AUDIT, Options, Project
from weftline.sources.backend import Backend, engine_settings, tick

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: instant of the freshness queries
AT = datetime(2030, 1, 1)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; it runs with the engine's settings."""

    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with engine_settings(spark):
                return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch() -> str:
    return f"weftline_{uuid.uuid4().hex[:16]}"


def external(spark: SparkSession, sf_dir: str, schema: str, *names: str) -> None:
    """Declare parquet files as tables, as a source's owner would."""
    Backend(spark).create_schema(schema)
    for name in names:
        path = f"{sf_dir}/{name}.parquet"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {tick(schema)}.{tick(name)} USING parquet LOCATION '{path if '://' in path else Path(path).absolute()}'")


SOURCES = """
version: 2
sources:
  - name: raw
    schema: {raw}
    tables:
{tables}
"""


def project(spark: SparkSession, sf_dir: str, files: dict[str, str], sources: tuple[str, ...] = (), **options) -> Project:
    """A project of the files, with the driver's tables as the source ``raw``."""
    root, schema = Path(tempfile.mkdtemp(prefix="weftline-project-")), scratch()
    external(spark, sf_dir, f"{schema}_raw", *sources)
    files = {
        "dbt_project.yml": "name: shop\nprofile: shop\n",
        "profiles.yml": f"shop:\n  target: dev\n  outputs:\n    dev:\n      type: spark\n      schema: {schema}\n",
        **({"models/sources.yml": SOURCES.format(raw=f"{schema}_raw", tables="\n".join(f"      - name: {s}" for s in sources))} if sources else {}),
        **files,
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return Project(Options(project_dir=str(root), **options), lambda graph: spark)


def relation(p: Project, name: str) -> DataFrame:
    return p.backend.spark.table(f"{tick(p.graph.target.schema)}.{tick(name)}")


# scans, sinks and templates

_CUSTOMER_ORDERS = "select o_custkey, count(*) as order_count, sum(cast(o_totalprice as decimal(18,2))) as total_spend from {{ ref('stg_orders') }} group by o_custkey"
_STG_ORDERS = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from {{ source('raw', 'orders') }}"
_CUSTOMER_ORDERS_SQL = "SELECT o_custkey, count(*) AS order_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend FROM orders GROUP BY o_custkey"


@query(_CUSTOMER_ORDERS_SQL)
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over a source, a table over the view, and their tests."""
    p = project(
        spark,
        sf_dir,
        {
            "models/stg_orders.sql": _STG_ORDERS,
            "models/customer_orders.sql": "{{ config(materialized='table') }}\n" + _CUSTOMER_ORDERS,
            "models/schema.yml": "models:\n  - name: customer_orders\n    columns:\n      - name: o_custkey\n        tests:\n          - unique\n          - not_null\n          - relationships:\n              to: source('raw', 'customer')\n              field: c_custkey\n",
        },
        ("orders", "customer"),
    )
    p.build()
    return relation(p, "customer_orders").select("o_custkey", "order_count", F.col("total_spend").cast("double").alias("total_spend"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def model_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, {"models/stg_orders.sql": _STG_ORDERS}, ("orders",))
    p.run()
    return relation(p, "stg_orders")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, {"models/rich.sql": "select c_custkey, c_nationkey, c_mktsegment from {{ source('raw', 'customer') }} where c_acctbal > 0"}, ("customer",))
    return p.backend.sql(p.compiler.model(p.graph.resources["model.shop.rich"]))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def ref_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(
        spark,
        sf_dir,
        {
            "models/nations.sql": "select n_name, n_regionkey from {{ source('raw', 'nation') }}",
            "models/regions.sql": "{{ config(materialized='table') }} select r_regionkey, r_name from {{ source('raw', 'region') }}",
            "models/named.sql": "select n_name, r_name from {{ ref('nations') }} join {{ ref('shop', 'regions') }} on n_regionkey = r_regionkey",
        },
        ("nation", "region"),
        threads=2,
    )
    p.run()
    return relation(p, "named")


@query("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY r_name")
def ephemeral_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = "{{ config(materialized='ephemeral') }}\n"
    p = project(
        spark,
        sf_dir,
        {
            "models/regions.sql": e + "select * from {{ source('raw', 'region') }} where r_name <> 'ASIA';",
            "models/joined.sql": e + "select n_name, r_name from {{ source('raw', 'nation') }} join {{ ref('regions') }} on n_regionkey = r_regionkey",
            "models/counted.sql": "{{ config(materialized='table') }}\n-- nations of each region\nwith j as (select * from {{ ref('joined') }}) select r_name, count(*) as nations from j group by r_name",
        },
        ("nation", "region"),
    )
    p.run()
    return relation(p, "counted")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("SELECT o_orderstatus, " + ", ".join(f"CAST(sum(CASE WHEN o_orderpriority = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS \"n_{x}\"" for x in _PRIORITIES) + ", count(*) AS total FROM orders GROUP BY o_orderstatus")
def loop_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(
        spark,
        sf_dir,
        {
            "models/pivoted.sql": "{% set priorities = " + str(_PRIORITIES) + " %}\nselect o_orderstatus,\n{% for p in priorities %}  cast(sum(case when o_orderpriority = '{{ p }}' then 1 else 0 end) as bigint) as \"n_{{ p }}\",\n{% endfor %}"
            "{% if execute %}  count(*) as total{% else %}  0 as total{% endif %}\n"
            "from {{ source('raw', 'orders') }} group by 1"
        },
        ("orders",),
    )
    p.run()
    return relation(p, "pivoted")


@query("SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_retailprice * 100 AS DECIMAL(16,2)) AS cents FROM part")
def macro_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(
        spark,
        sf_dir,
        {
            "macros/money.sql": "{% macro to_cents(c) %}{{ return(adapter.dispatch('to_cents')(c)) }}{% endmacro %}\n{% macro default__to_cents(c) %}({{ c }} * 100)::numeric(16, 2){% endmacro %}\n{% macro as_id(c) %}cast({{ c }} as varchar){% endmacro %}",
            "models/cents.sql": "select {{ as_id('p_partkey') }} as part_id, {{ to_cents('p_retailprice') }} as cents from {{ source('raw', 'part') }}",
        },
        ("part",),
    )
    p.run()
    return relation(p, "cents")


@query("SELECT n_nationkey, n_name FROM nation")
def rematerialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation goes from table to view and back."""
    p = project(spark, sf_dir, {"models/m.sql": "select n_nationkey, n_name from {{ source('raw', 'nation') }}"}, ("nation",))
    b, name = p.backend, p.graph.target.schema
    sql = p.compiler.model(p.graph.resources["model.shop.m"])
    for kind in ("table", "view", "table"):
        b.build(name, "m", sql, kind)
        assert b.kind(name, "m") == kind
    return relation(p, "m")


@query("SELECT r_name FROM region WHERE r_name <> ';'")
def trailing_semicolon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, {"models/m.sql": "select r_name from {{ source('raw', 'region') }} where r_name <> ';'; -- the end; really\n/* ; */\n"}, ("region",))
    p.run()
    return relation(p, "m")


@query("SELECT n_regionkey, n_name FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) = 1")
def dialect_shim(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, {"models/m.sql": "select n_regionkey, n_name::varchar as n_name from {{ source('raw', 'nation') }} qualify row_number() over (partition by n_regionkey order by n_name) = 1"}, ("nation",))
    p.run()
    return relation(p, "m")


# seeds

_SEED = "id,name,amount,day\n1,Ada,10.5,2024-01-02\n2,\"Lin, us\",,2024-02-03\n3,,7,\n"
_VALUES = "SELECT CAST(id AS BIGINT) AS id, name, CAST(amount AS DOUBLE) AS amount, CAST(day AS DATE) AS day FROM (VALUES (1, 'Ada', 10.5, '2024-01-02'), (2, 'Lin, us', NULL, '2024-02-03'), (3, NULL, 7, NULL)) t(id, name, amount, day)"


@query(_VALUES)
def seed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, {"seeds/people.csv": _SEED})
    p.seed()
    return relation(p, "people")


@query("SELECT * FROM (VALUES (1234567890123456789, CAST(18446744073709551616 AS VARCHAR), 0.5), (-9223372036854775808, '-5', 2.0)) t(id, wide, part)")
def seed_big_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of 64 bits stay whole, and wider ones too."""
    p = project(spark, sf_dir, {"seeds/big.csv": "id,wide,part\n1234567890123456789,18446744073709551616,0.5\n-9223372036854775808,-5,2\n"})
    p.seed()
    return relation(p, "big").select("id", F.col("wide").cast("string").alias("wide"), F.col("part").cast("double").alias("part"))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS named, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance, c_acctbal > 0 AS rich FROM customer")
def seed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as a CSV file, with quotes, commas and missing values, and read back as a seed."""
    import csv
    import io

    out = io.StringIO()
    lines = csv.writer(out)
    lines.writerow(["c_custkey", "named", "balance", "rich"])
    for r in read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal")).toLocalIterator():
        lines.writerow([r.c_custkey, f'{r.c_name}, "{r.c_mktsegment}"', r.c_acctbal if r.c_acctbal > 0 else None, str(r.c_acctbal > 0).lower()])
    p = project(spark, sf_dir, {"seeds/customers.csv": out.getvalue()})
    p.seed()
    return relation(p, "customers")


@query("SELECT CAST(1 AS INTEGER) AS \"Order ID\", 'Ada' AS \"customer name\", CAST(10.50 AS DECIMAL(10,2)) AS amount")
def seed_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    yml = "seeds:\n  - name: typed\n    config:\n      quote_columns: true\n      column_types:\n        Order ID: integer\n        customer name: varchar\n        amount: decimal(10,2)\n"
    p = project(spark, sf_dir, {"seeds/typed.csv": "Order ID,customer name,amount\n1,Ada,10.50\n", "seeds/seeds.yml": yml})
    return p.backend.read_seed(str(Path(p.options.project_dir) / "seeds/typed.csv"), p.graph.resources["seed.shop.typed"].column_types, True)


@query("SELECT CAST(1 AS BIGINT) AS order_id, CAST(10.5 AS DOUBLE) AS amt")
def seed_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, {"seeds/plain.csv": "Order ID,Amt$\n1,10.5\n", "seeds/seeds.yml": "seeds:\n  - name: plain\n    config:\n      quote_columns: false\n"})
    p.seed()
    return relation(p, "plain")


# data tests


@query("SELECT CAST(NULL AS BIGINT) AS v FROM orders WHERE o_orderpriority = '5-LOW'")
def test_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.not_null(read(spark, sf_dir, "orders").selectExpr("case when o_orderpriority <> '5-LOW' then o_orderkey end as v"), "v")


@query("SELECT CAST(NULL AS BIGINT) AS v FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'")
def test_not_null_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.not_null(read(spark, sf_dir, "orders").selectExpr("case when o_orderpriority <> '5-LOW' then o_orderkey end as v", "o_orderstatus"), "v", "o_orderstatus = 'F'")


@query("SELECT count_if(o_orderkey IS NULL) AS o_orderkey, count_if(nullif(o_orderstatus, 'F') IS NULL) AS o_orderstatus FROM orders")
def test_not_null_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.not_null_counts(read(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'F')")), ["o_orderkey", "o_orderstatus"])
    return spark.createDataFrame([tuple(found.values())], "o_orderkey long, o_orderstatus long")


@query("SELECT l_orderkey AS unique_field, count(*) AS n_records FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey HAVING count(*) > 1")
def test_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unique(read(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT o_orderstatus AS value_field, count(*) AS n_records FROM orders GROUP BY o_orderstatus HAVING o_orderstatus NOT IN ('F')")
def test_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.accepted_values(read(spark, sf_dir, "orders"), "o_orderstatus", ["F"])


@query("SELECT p_size AS value_field, count(*) AS n_records FROM part GROUP BY p_size HAVING p_size NOT IN (1, 2, 3)")
def test_accepted_values_unquoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.accepted_values(read(spark, sf_dir, "part"), "p_size", ["1", "2", "3"], quote=False)


@query("SELECT o_custkey AS from_field FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def test_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.relationships(read(spark, sf_dir, "orders"), "o_custkey", read(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


_TESTED = {
    "models/stg.sql": "select o_orderkey, o_totalprice, o_orderstatus from {{ source('raw', 'orders') }}",
    "macros/tests.sql": "{% test at_most(model, column_name) %}\nselect {{ column_name }} from {{ model }} where {{ column_name }} > 100000\n{% endtest %}",
    "models/schema.yml": "models:\n  - name: stg\n    columns:\n      - name: o_totalprice\n        tests:\n          - at_most:\n              config:\n                where: o_orderstatus = 'O'\n                severity: warn\n                store_failures: true\n",
    "tests/cheap.sql": "{{ config(severity='warn') }} select o_orderkey, o_orderstatus from {{ ref('stg') }} where o_totalprice < 20000;",
}


def _tested(spark: SparkSession, sf_dir: str, **more: str) -> Project:
    p = project(spark, sf_dir, _TESTED | more, ("orders",))
    p.run()
    return p


@query("SELECT o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def test_custom_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tested(spark, sf_dir)
    return p.backend.sql(p.compiler.test(next(t for t in p.graph.of("test") if not t.singular)))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 20000")
def singular_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tested(spark, sf_dir)
    return p.backend.sql(p.compiler.test(p.graph.resources["test.shop.cheap"]))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 20000 AND o_orderstatus = 'F'")
def singular_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tested(spark, sf_dir, **{"tests/tests.yml": "data_tests:\n  - name: cheap\n    config:\n      where: o_orderstatus = 'F'\n"})
    return p.backend.sql(p.compiler.test(p.graph.resources["test.shop.cheap"]))


@query("SELECT least(count(*), 5) AS failures FROM orders WHERE o_totalprice < 20000")
def singular_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tested(spark, sf_dir, **{"tests/tests.yml": "data_tests:\n  - name: cheap\n    config:\n      limit: 5\n"})
    return checks.failure_count(p.backend.sql(p.compiler.test(p.graph.resources["test.shop.cheap"]))).select("failures")


@query("SELECT least(count(*), 7) AS failures FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)")
def test_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.failure_count(checks.limited(checks.unique(read(spark, sf_dir, "lineitem"), "l_orderkey"), 7)).select("failures")


@query("SELECT count(*) AS failures, count(*) > 10 AS should_warn, count(*) >= 1000000 AS should_error FROM orders WHERE o_orderstatus = 'F'")
def failure_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.failure_count(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "> 10", ">= 1000000")


_RUN_YML = """
models:
  - name: stg
    columns:
      - name: o_orderkey
        tests: [not_null, unique]
      - name: o_custkey
        tests:
          - unique: {config: {warn_if: '> 0', error_if: '> 100000000'}}
          - relationships: {to: ref('rich'), field: c_custkey}
      - name: o_orderstatus
        tests:
          - accepted_values: {values: [F, O], config: {severity: warn}}
          - accepted_values: {values: [F], config: {where: o_totalprice > 1000, limit: 2}}
"""


@query(
    "WITH o AS (SELECT * FROM orders), found AS (SELECT 'not_null o_orderkey' AS test, 'fail' AS bad, (SELECT count(*) FROM o WHERE o_orderkey IS NULL) AS failures "
    "UNION ALL SELECT 'unique o_orderkey', 'fail', (SELECT count(*) FROM (SELECT o_orderkey FROM o GROUP BY 1 HAVING count(*) > 1)) "
    "UNION ALL SELECT 'unique o_custkey', 'warn', (SELECT count(*) FROM (SELECT o_custkey FROM o GROUP BY 1 HAVING count(*) > 1)) "
    "UNION ALL SELECT 'relationships o_custkey', 'fail', (SELECT count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) "
    "UNION ALL SELECT 'accepted_values o_orderstatus', 'warn', (SELECT count(DISTINCT o_orderstatus) FROM o WHERE o_orderstatus NOT IN ('F', 'O')) "
    "UNION ALL SELECT 'only_f o_orderstatus', 'fail', (SELECT least(count(DISTINCT o_orderstatus), 2) FROM o WHERE o_totalprice > 1000 AND o_orderstatus <> 'F')) "
    "SELECT test, CASE WHEN failures = 0 THEN 'pass' ELSE bad END AS status, CAST(failures AS BIGINT) AS failures FROM found "
    "UNION ALL SELECT 'model ' || x, CASE WHEN x = 'after' THEN 'skipped' ELSE 'success' END, NULL FROM (VALUES ('stg'), ('rich'), ('after')) t(x)"
)
def test_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses and failures of a build with tests of all built-in kinds, and what they block."""
    from weftline.errors import ResourceFailure

    p = project(
        spark,
        sf_dir,
        {
            "models/stg.sql": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from {{ source('raw', 'orders') }}",
            "models/rich.sql": "select c_custkey from {{ source('raw', 'customer') }} where c_acctbal > 0",
            "models/after.sql": "select o_orderkey from {{ ref('stg') }}",
            "models/tests.yml": _RUN_YML,
        },
        ("orders", "customer"),
        threads=2,
    )
    try:
        results = p.build()
    except ResourceFailure as e:
        results = e.results
    rows = []
    for x in results:
        r = p.graph.resources[x.unique_id]
        label = f"model {r.name}" if r.kind == "model" else f"{'only_f' if r.config.limit else r.spec.name} {r.column}"
        rows.append((label, x.status, x.failures))
    return spark.createDataFrame(rows, "test string, status string, failures long")


_RULES = [("ERROR", "> 0", "> 10"), ("ERROR", "> 0", "> 1000000"), ("warn", "!= 0", "!= 0"), ("Error", "< 0", "= 0")]


@query(
    "SELECT r AS rule, n AS failures, CASE WHEN r = 0 THEN CASE WHEN n > 10 THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END WHEN r = 1 THEN CASE WHEN n > 1000000 THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END "
    "WHEN r = 2 THEN CASE WHEN n <> 0 THEN 'warn' ELSE 'pass' END ELSE CASE WHEN n = 0 THEN 'fail' ELSE 'pass' END END AS status FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'), range(4) x(r)"
)
def threshold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = int(checks.failure_count(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")).first().failures)
    return spark.createDataFrame([(i, n, checks.status(n, s, w, e)[0]) for i, (s, w, e) in enumerate(_RULES)], "rule long, failures long, status string")


@query("SELECT o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def store_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tested(spark, sf_dir)
    t = next(t for t in p.graph.of("test") if not t.singular)
    t.alias = f"{t.alias}_{uuid.uuid4().hex[:8]}"  # the audit schema is shared by all runs
    p.test()
    return spark.table(f"{tick(AUDIT)}.{tick(t.identifier)}")


@query("SELECT * FROM (VALUES ('model.shop.bad', 'error'), ('model.shop.below', 'skipped'), ('model.shop.good', 'success'), ('test.shop.never', 'fail'), ('model.shop.after', 'skipped')) t(unique_id, status)")
def build_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failures block: a broken model its children, a failed test the children of what it tests."""
    from weftline.errors import ResourceFailure

    p = project(
        spark,
        sf_dir,
        {
            "models/good.sql": "{{ config(materialized='table') }} select r_regionkey from {{ source('raw', 'region') }}",
            "models/bad.sql": "{{ config(materialized='table') }} select no_such_column from {{ source('raw', 'region') }}",
            "models/below.sql": "select * from {{ ref('bad') }}",
            "models/after.sql": "select * from {{ ref('good') }}",
            "tests/never.sql": "select * from {{ ref('good') }}",
        },
        ("region",),
        threads=2,
    )
    try:
        results = p.build()
    except ResourceFailure as e:
        results = e.results
    return spark.createDataFrame([(r.unique_id, r.status) for r in results], "unique_id string, status string")


# unit tests


@query("SELECT 1 AS id, 'a' AS name, TRUE AS flag UNION ALL SELECT 2, NULL, FALSE")
def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_tests.literal_rows(spark, [{"id": 1, "name": "a", "flag": True}, {"id": 2, "name": None, "flag": False}])


_UNIT = """
unit_tests:
  - name: counts
    model: counted
    given:
      - input: source('raw', 'nation')
        rows:
          - {{n_regionkey: 1, n_name: 'x'}}
          - {{n_regionkey: 1, n_name: 'y'}}
          - {{n_regionkey: 2, n_name: 'z'}}
    expect:
      rows: {expect}
"""


def _unit(spark: SparkSession, sf_dir: str, expect: str) -> DataFrame:
    p = project(spark, sf_dir, {"models/counted.sql": "select n_regionkey, count(*) as n from {{ source('raw', 'nation') }} group by n_regionkey", "models/unit.yml": _UNIT.format(expect=expect)}, ("nation",))
    return spark.createDataFrame([(p.unit_test_failures(p.graph.of("unit_test")[0]),)], "failures long")


@query("SELECT 0::BIGINT AS failures")
def unit_test_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit(spark, sf_dir, "[{n_regionkey: 1, n: 2}, {n_regionkey: 2, n: 1}]")


_GIVEN = "(SELECT n_regionkey, count(*) AS n FROM (VALUES (1), (1), (2)) t(n_regionkey) GROUP BY 1)"


@query(f"WITH a AS {_GIVEN}, e AS (SELECT * FROM (VALUES (1, 2), (3, 1)) t(n_regionkey, n)) SELECT count(*) AS failures FROM ((FROM a EXCEPT ALL FROM e) UNION ALL (FROM e EXCEPT ALL FROM a))")
def unit_test_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit(spark, sf_dir, "[{n_regionkey: 1, n: 2}, {n_regionkey: 3, n: 1}]")


@query(f"SELECT count(*) AS failures FROM {_GIVEN}")
def unit_test_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit(spark, sf_dir, "[]")


# freshness

_LIMITS = Freshness(Threshold(1, "day"), Threshold(20_000, "day"))
_FRESH_SQL = "SELECT coalesce(strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ'), '0001-01-01T00:00:00Z') AS max_loaded_at, '2030-01-01T00:00:00Z' AS snapshotted_at, coalesce(epoch(TIMESTAMP '2030-01-01') - epoch(max(ts)), 9.223372036854776e18)::DOUBLE AS age_seconds FROM events"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("age_seconds", F.round("age_seconds", 3))


def _rounded_sql(sql: str) -> str:
    return f"SELECT max_loaded_at, snapshotted_at, round(age_seconds, 3) AS age_seconds FROM ({sql})"


@query(f"SELECT *, CASE WHEN age_seconds > 20000 * 86400 THEN 'error' WHEN age_seconds > 86400 THEN 'warn' ELSE 'pass' END AS status FROM ({_rounded_sql(_FRESH_SQL)})")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rounded(freshness.source_freshness(read(spark, sf_dir, "events"), "ts", at=AT))
    return df.withColumn("status", F.lit(freshness.status(df.first().age_seconds, _LIMITS)))


@query(_rounded_sql(f"{_FRESH_SQL} WHERE event_type = 'click'"))
def freshness_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(freshness.source_freshness(read(spark, sf_dir, "events"), "cast(ts as timestamp)", "event_type = 'click'", AT))


@query(_rounded_sql(f"{_FRESH_SQL} WHERE user_id > 10"))
def freshness_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = scratch()
    external(spark, sf_dir, schema, "events")
    return _rounded(freshness.query_freshness(spark, f"select max(ts) from {schema}.events where user_id > 10", AT))


@query(_rounded_sql(f"{_FRESH_SQL} WHERE false"))
def freshness_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(freshness.source_freshness(read(spark, sf_dir, "events"), "ts", "false", AT))


# catalog and graph


@query("SELECT DISTINCT table_name, ordinal_position AS ordinal, column_name, data_type FROM information_schema.columns WHERE table_name IN ('nation', 'orders')")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = scratch()
    external(spark, sf_dir, schema, "orders", "nation")
    rows = [(t, i, c, k) for t in ("nation", "orders") for i, (c, k) in enumerate(Backend(spark).columns(schema, t), 1)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string")


_EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d")]
_NODES = 60


@query(
    f"WITH RECURSIVE e(p, c) AS (SELECT DISTINCT k // d, k FROM range(2, {_NODES + 1}) n(k), (VALUES (2), (3)) t(d) WHERE k // d > 0), "
    "r(ancestor, node) AS (SELECT p, c FROM e UNION SELECT r.ancestor, e.c FROM r JOIN e ON r.node = e.p) SELECT 'm' || ancestor AS ancestor, 'm' || node AS node FROM r"
)
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of every model, as the selector ``x+`` finds them; model k reads the models k // 2 and k // 3."""
    parents = {k: sorted({k // 2, k // 3} - {0}) for k in range(1, _NODES + 1)}
    p = project(spark, sf_dir, {f"models/m{k}.sql": "select 1 as x" + "".join(f" union all select x from {{{{ ref('m{a}') }}}}" for a in v) for k, v in parents.items()})
    rows = [(f"m{k}", r.name) for k in parents for r in p.selector.select(f"m{k}+") if r.name != f"m{k}"]
    return spark.createDataFrame(rows, "ancestor string, node string")


@query("SELECT * FROM (VALUES ('+b', 'a b'), ('b+1', 'b c'), ('@e', 'a b c d e'), ('tag:mart,d+', 'd'), ('c e', 'c e'), ('[c-d]', 'c d')) t(selector, names)")
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents: dict[str, list[str]] = {}
    for a, b in _EDGES:
        parents.setdefault(a, [])
        parents.setdefault(b, []).append(a)
    files = {f"models/{k}.sql": ("{{ config(tags=['mart']) }}" if k in "cd" else "") + "select 1 as x" + "".join(f" union all select x from {{{{ ref('{a}') }}}}" for a in v) for k, v in parents.items()}
    p = project(spark, sf_dir, files)
    return spark.createDataFrame([(s, " ".join(r.name for r in p.selector.select(s))) for s in ("+b", "b+1", "@e", "tag:mart,d+", "c e", "[c-d]")], "selector string, names string")


_TESTED_YML = """
sources:
  - name: raw
    schema: {raw}
    tables:
      - name: nation
        columns:
          - name: n_nationkey
            tests: [not_null]
models:
  - name: places
    config: {{tags: [geo]}}
    columns:
      - name: n_nationkey
        tests: [unique]
"""


def tested_project(spark: SparkSession, sf_dir: str) -> Project:
    """A model over a tested source, with a test of its own and a singular one."""
    schema = scratch()
    external(spark, sf_dir, schema, "nation")
    return project(spark, sf_dir, {"models/geo/places.sql": "select n_nationkey, n_name from {{ source('raw', 'nation') }}", "models/schema.yml": _TESTED_YML.format(raw=schema), "tests/named.sql": "select * from {{ ref('places') }} where n_name is null"})


@query(
    "SELECT * FROM (VALUES ('places', 'named places unique_places_n_nationkey'), ('tag:geo', 'named places unique_places_n_nationkey'), ('path:models/geo', 'places'), ('source:raw.nation', 'nation'),"
    " ('path:tests', 'named'), ('test_type:singular', 'named'), ('resource_type:model', 'places'), ('package:shop,resource_type:source', 'nation'), ('file:named', 'named')) t(selector, names)"
)
def indirect_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests come with models that are chosen by name or tag, and by no other method."""
    p = tested_project(spark, sf_dir)
    chosen = ("places", "tag:geo", "path:models/geo", "source:raw.nation", "path:tests", "test_type:singular", "resource_type:model", "package:shop,resource_type:source", "file:named")
    return spark.createDataFrame([(s, " ".join(sorted(r.name for r in p.selector.select(s)))) for s in chosen], "selector string, names string")
