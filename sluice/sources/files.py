"""Files in and out: CSV, text, JSON, logs, archives, transcripts; sinks with stable headers."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None, infer: bool = False) -> DataFrame:
    """With a header (A1); all text and '' for missing without a schema (A2); typed by inference (A3); pruned to columns (A5).

    A mark at the file's start isn't part of the first name (A4).
    """
    reader = spark.read.option("header", True).option("multiLine", False)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", infer).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    df = df.select(*columns) if columns else df
    return df if schema or infer else df.na.fill("")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """source_file, text of each *.txt, by name."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), "^.*/", "").alias("source_file"), F.col("value").alias("text"))


def lines(df: DataFrame) -> DataFrame:
    """source_file, line_no from 1, text (A7); a line feed at the very end begins no line."""
    return df.select("source_file", F.posexplode(F.split(F.regexp_replace("text", "\r?\n$", ""), "\r?\n")).alias("k", "line")).select("source_file", (F.col("k") + 1).alias("line_no"), F.col("line").alias("text"))


def json(spark: SparkSession, path: str) -> DataFrame:
    """Documents over several lines."""
    return spark.read.option("multiLine", True).json(path)


def log_lines(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """Lines with one of some words, whatever the case (A10)."""
    return spark.read.text(path).where(F.lower("value").rlike("|".join(words)))


def grep(lines_: DataFrame, needle: str, column: str = "text") -> DataFrame:
    """Lines that contain a text, whatever the case, with their numbers."""
    return lines_.where(F.contains(F.lower(column), F.lit(needle.lower())))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """The first member of each ending in every archive."""
    found = spark.read.format("binaryFile").load(path)
    return _first_members(found.select(F.regexp_replace("path", "^.*/", "").alias("archive"), "content"))


def _first_members(archives: DataFrame) -> DataFrame:
    def run(frames):
        for f in frames:
            out = []
            for name, content in zip(f["archive"], f["content"]):
                first: dict[str, str] = {}
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        if not n.endswith("/"):
                            first.setdefault(n.rsplit(".", 1)[-1].lower(), n)
                out += [(name, n, ending) for ending, n in first.items()]
            yield pd.DataFrame(out, columns=["archive", "member", "ending"])

    return archives.mapInPandas(run, "archive string, member string, ending string")


def named_parts(df: DataFrame, file: str, pattern: str, names: list[str]) -> DataFrame:
    """Columns read from a file's name."""
    return df.select("*", *[F.regexp_extract(file, pattern, k + 1).alias(n) for k, n in enumerate(names)])


def sidecar(path: F.Column) -> F.Column:
    """Where the facts of a wide table lie."""
    return F.concat(F.regexp_replace(path, r"\.csv$", ""), F.lit("_facts.csv"))


def transcript(lines_: DataFrame, banner: str, key: str, order: str) -> DataFrame:
    """The banner in force and the number of the run for every line of a transcript."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tag = F.nullif(F.regexp_extract("text", banner, 1), F.lit(""))
    return lines_.select("*", F.last(tag, ignorenulls=True).over(w).alias("tag"), F.sum(tag.isNotNull().cast("int")).over(w).alias("run"))


def canonical(df: DataFrame, first: list[str]) -> DataFrame:
    """Known columns in order, then the others by name."""
    return df.select(*[c for c in first if c in df.columns], *sorted(c for c in df.columns if c not in first))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """With a header; committed as a whole."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """A18."""
    df.write.mode(mode).json(path)


def report(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """A report with new rows and perhaps new columns, best first."""
    return old.unionByName(new, allowMissingColumns=True).orderBy(F.desc(order))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows over old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_archives(df: DataFrame, path: str) -> None:
    """Zip archives, a row each of (archive, members array<struct<member, text>>), as rows of bytes."""

    def run(frames):
        for f in frames:
            out = []
            for members in f["members"]:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for m in members:
                        z.writestr(m["member"], m["text"])
                out.append(held.getvalue())
            yield pd.DataFrame({"archive": f["archive"], "content": out})

    df.mapInPandas(run, "archive string, content binary").write.parquet(path)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """As ``zip_members``, of archives that are stored as rows of (archive, content)."""
    return _first_members(spark.read.schema("archive string, content binary").parquet(path))


def replace(df: DataFrame, path: str) -> None:
    """Write a table anew as a whole: into a folder of its own, which a marker then names.

    A run that dies before the marker leaves the old table in force.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/{name}")
    order = _markers(spark, path)
    next_ = 1 + (order.agg(F.max("k")).first()[0] or 0) if order is not None else 1
    spark.createDataFrame([(next_, name)], "k long, name string").write.mode("append").parquet(f"{path}/markers")


def _markers(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/markers")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema("k long, name string").parquet(f"{path}/markers") if there else None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that the last marker names."""
    return spark.read.parquet(f"{path}/{_markers(spark, path).orderBy(F.desc('k')).first()['name']}")


def resume(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key isn't there yet, and return all."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        done = spark.read.schema(df.schema).parquet(path).select(key).distinct()
        df.join(done, key, "left_anti").write.mode("append").parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
