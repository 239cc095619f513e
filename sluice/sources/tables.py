"""Tables by name, small literal relations, and joins that check a side's size before broadcasting it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import ship

#: Rows up to which a side may be broadcast.
SMALL_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A literal relation."""
    return spark.createDataFrame(rows, schema)


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """The same relation as a DuckDB common table expression."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return repr(x)

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``rows`` rows; the count stops beyond that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir`` where the session has one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.gettempdir()
    return f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
