"""Shared helpers: input access, staging tables, partition counts and Arrow iteration.

Staging tables go to the folder named by ``spark.checkpoint.dir`` (the one folder that driver and
executors share).  They cut lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a batch that goes to a Python worker
BATCH_ROWS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, always read by Spark so that any file system works.

    Batches handed to Python are bounded by rows, and rows hold whole texts, so they are made smaller.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; only where none is set, on a single machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` (doc_id long, ...) with a ``uid`` that is there once, and whether that is the doc_id itself.

    If ids repeat or are null, rows are numbered and written, so that every later pass sees the same numbers.
    """
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return rows.withColumn("uid", F.col("doc_id")), True
    return staged(rows.withColumn("uid", F.monotonically_increasing_id()), "numbered"), False


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` has not, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    return [next(x for k in range(len(taken) + 1) if (x := f"_{name}{k or ''}") not in taken) for name in names]


def spread(spark: SparkSession) -> int:
    """Partition count for explicit repartitioning: what the session uses for its shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is far quicker than ``translate`` and equal on pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``limit`` bytes of text each (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as ``doc_id long, text string, bands array<long>``."""
    fields = []
    for part in ddl.split(", "):
        name, kind = part.split(" ")
        fields.append((name, pa.list_(_KINDS[kind[6:-1]]) if kind.startswith("array<") else _KINDS[kind]))
    return pa.schema(fields)


def record(ddl: str, columns: dict | list) -> pa.RecordBatch:
    """A batch of the columns, as the DDL has them."""
    kind = arrow_schema(ddl)
    given = [columns[n] for n in kind.names] if isinstance(columns, dict) else columns
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) for x, f in zip(given, kind, strict=True)], schema=kind)
