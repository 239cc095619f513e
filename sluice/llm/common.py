"""What the operators of this subpackage share: tables, the shared workspace, union of links."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import ship

#: glibc's own; other systems keep what they have.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path that Spark's readers open will do."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none (tests on one machine) a temporary folder is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"sluice-{uuid.uuid4().hex[:8]}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Workspace:
    """Tables written under the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = ship(spark)
        self.at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.at}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back; the copy has no lineage behind it."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.sluice_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete saved tables that no later plan reads."""
        for t in tables:
            if t is not None and getattr(t, "sluice_path", None):
                remove(self.spark, t.sluice_path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until the frame has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def tasks(rows: int, each: int = 50_000) -> int:
    """Tasks for so many rows."""
    return rows // each + 1


def release() -> None:
    """Give memory that a worker no longer uses back to the system; called between batches."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` is many times faster than ``translate`` and gives the same string unless a
    character outside ASCII has a lower-case form of its own; only such texts are translated.
    """
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cased = text.rlike(r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]")
    return F.when(cased, F.translate(text, upper, low)).otherwise(F.lower(text))


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` as ``(node, component)``, component the least node.

    Alternates large-star and small-star steps until nothing moves.  All state is tables in the
    shared folder; minima are pre-aggregated before they shuffle, so a hub with a large share
    of the links costs one row per task, and the joins back are split by the adaptive planner.
    Nodes without a link to another node are absent.  Null ends and self links are ignored.
    """
    # as many tasks as the edges are worth, whatever the number of shuffle partitions
    n = tasks(2 * links.count())
    few = lambda df: df.coalesce(n)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = ws.save(few(edges), "edges")
    mark = F.xxhash64("u", "v")
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(mark), F.bit_xor(F.xxhash64("v", mark))).first())
    was = state(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        )
        large = few(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            few(large.join(least, "u"))
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct()
        )
        after = ws.save(few(small), "edges")
        ws.drop(edges)
        edges, now = after, state(after)
        # the set of edges is compared by its count and 128 bits of hash; nothing is joined for it
        if now == was:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        was = now
