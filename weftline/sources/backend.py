"""Relations in the Spark catalog: schemas, tables, views, seeds and what the catalog knows of them."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.errors import ProjectError
from weftline.functions.dialect import to_spark, trim_terminator

MATERIALIZATIONS = ("table", "view")
#: options that the engine's SQL is written for
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.session.timeZone": "UTC"}


def tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@contextmanager
def engine_settings(spark: SparkSession) -> Iterator[None]:
    """The settings while a command runs; what was there before is put back."""
    was = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Backend:
    """Runs SQL of a project in a session.  ``schema`` parts are databases of the session's catalog."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def sql(self, text: str) -> DataFrame:
        """The rows of a query of the project, lazily."""
        return self.spark.sql(to_spark(trim_terminator(text)))

    def create_schema(self, schema: str) -> None:
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {tick(schema)}")

    def kind(self, schema: str, name: str) -> str | None:
        """table, view or None."""
        if not self.spark.catalog.databaseExists(tick(schema)):
            return None
        try:
            found = self.spark.catalog.getTable(f"{tick(schema)}.{tick(name)}")
        except AnalysisException:
            return None
        return "view" if found.tableType == "VIEW" else "table"

    def drop(self, schema: str, name: str, keep: str | None = None) -> None:
        """Drop what is there unless it is of the kind ``keep``."""
        found = self.kind(schema, name)
        if found and found != keep:
            self.spark.sql(f"DROP {found.upper()} {tick(schema)}.{tick(name)}")

    def build(self, schema: str, name: str, sql: str, materialized: str) -> None:
        """Build a model's relation.  A table that its own query reads is written beside and swapped."""
        if materialized not in MATERIALIZATIONS:
            raise ProjectError(f"only {' and '.join(MATERIALIZATIONS)} materializations can be run, not {materialized}")
        self.create_schema(schema)
        text = to_spark(trim_terminator(sql))
        if materialized == "view":
            self.drop(schema, name, keep="view")
            self.spark.sql(f"CREATE OR REPLACE VIEW {tick(schema)}.{tick(name)} AS {text}")
        else:
            self.write(schema, name, self.spark.sql(text))

    def write(self, schema: str, name: str, df: DataFrame) -> None:
        """Replace a relation by a table.  Between the drop and the rename there is none of that name."""
        self.create_schema(schema)
        beside = f"{name}__{uuid.uuid4().hex[:12]}"
        df.write.mode("overwrite").format("parquet").saveAsTable(f"{tick(schema)}.{tick(beside)}")  # before anything is dropped: a failure leaves the old relation
        self.drop(schema, name)
        self.spark.sql(f"ALTER TABLE {tick(schema)}.{tick(beside)} RENAME TO {tick(schema)}.{tick(name)}")

    # seeds

    def seed(self, schema: str, name: str, file: Path, types: dict[str, str] | None = None, quote_columns: bool | None = None) -> None:
        """A table of a CSV file with a header; types are inferred or given."""
        self.write(schema, name, self.read_seed(str(file), types, quote_columns))

    def read_seed(self, file: str, types: dict[str, str] | None = None, quote_columns: bool | None = None) -> DataFrame:
        """Rows of a CSV file with a header, typed as declared or as all values of a column allow.

        ``quote_columns`` false makes names plain (``Order ID``: order_id).  A project's files lie where
        the driver runs and executors may not see them, so a seed, which is small, is read here; a path
        with a scheme is read by Spark.
        """
        if "://" in file:
            read = self.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(file)
            names, text, rows = read.columns, read, None
        else:
            with open(file, newline="", encoding="utf-8-sig") as lines:
                parsed = list(csv.reader(lines))
            names = parsed[0] if parsed else []
            rows = [[v if v != "" else None for v in r] for r in parsed[1:] if r]
            if not names or any(len(r) != len(names) for r in rows):
                raise ProjectError(f"seed {file}: a header and rows of the same length are needed")
            text = self.spark.createDataFrame(rows, StructType([StructField(c, StringType()) for c in names]))
        typed = {k.lower(): seed_type(v) for k, v in (types or {}).items()}
        missing = set(typed) - {c.lower() for c in names}
        if missing:
            raise ProjectError(f"seed {file} has no columns {sorted(missing)}")
        columns = []
        for i, c in enumerate(names):
            kind = typed.get(c.lower()) or ("string" if rows is None else inferred([r[i] for r in rows]))
            columns.append(F.col(tick(c)).cast(kind).alias(plain_name(c) if quote_columns is False else c))
        return text.select(*columns)

    # the catalog

    def columns(self, schema: str, name: str) -> list[tuple[str, str]]:
        """Names and types, in order; none if there is no such relation."""
        if self.kind(schema, name) is None:
            return []
        return [(f.name, ansi_type(f.dataType.simpleString())) for f in self.spark.table(f"{tick(schema)}.{tick(name)}").schema]


_INFER = (
    ("bigint", re.compile(r"[-+]?[0-9]+")),
    ("double", re.compile(r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?")),
    ("boolean", re.compile(r"true|false", re.I)),
    ("date", re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")),
    ("timestamp_ntz", re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?")),
)


def inferred(values: list[str | None]) -> str:
    """The first type that all values have; string for a column without values."""
    there = [v.strip() for v in values if v is not None]
    found = next((kind for kind, form in _INFER if there and all(form.fullmatch(v) for v in there)), "string")
    if found == "bigint":
        largest = max(abs(int(v)) - (v[0] == "-") for v in there)  # a long has one more below zero
        return "bigint" if largest < 1 << 63 else "decimal(38,0)" if largest < 10**38 - 1 else "double"
    return found


def plain_name(name: str) -> str:
    """Lower case, with runs of other signs as _, and none at the ends."""
    found = re.sub(r"[^0-9A-Za-z_]+", "_", name.strip()).strip("_").lower()
    return f"_{found}" if found[:1].isdigit() or not found else found


#: fixed values: declared column types and Spark's
SEED_TYPES = {"integer": "int", "int": "int", "int4": "int", "bigint": "bigint", "int8": "bigint", "long": "bigint", "smallint": "smallint", "tinyint": "tinyint", "varchar": "string", "text": "string", "string": "string", "char": "string", "double": "double", "float8": "double", "float": "float", "real": "float", "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "timestamptz": "timestamp"}


def seed_type(declared: str) -> str:
    low = re.sub(r"\s", "", declared.lower())
    m = re.fullmatch(r"(decimal|numeric)(\((\d+)(?:,(\d+))?\))?", low)
    if m:
        return f"decimal({m[3] or 18},{m[4] or (0 if m[3] else 3)})"
    found = SEED_TYPES.get(re.sub(r"\(\d+\)$", "", low))
    if not found:
        raise ProjectError(f"unsupported column type: {declared}")
    return found


#: fixed values: Spark's type names and those of the catalog artifact
ANSI_TYPES = {"int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "binary": "BLOB"}


def ansi_type(kind: str) -> str:
    return ANSI_TYPES.get(kind, kind.upper())
