"""Wide and long: facts, pivots, merges of field values, column roles from values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.tables import scratch

#: Fields of a wide table; a schema beyond this isn't one.
MOST_FIELDS = 2000
HINTS = ["id", "rule_id", "ruleid", "identifier"]


def facts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each non-empty cell (DM6)."""
    cells = [F.struct(F.lit(c).alias("field"), F.trim(F.col(c).cast("string")).alias("value")) for c in fields]
    return df.select(key, F.inline(F.array(*cells))).where("value <> ''")


def field_order(long: DataFrame) -> list[str]:
    """Fields by falling count, then name (D27); the list is bounded by MOST_FIELDS."""
    rows = long.groupBy("field").count().orderBy(F.desc("count"), "field").limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    return [r["field"] for r in rows]


def wide(long: DataFrame, key: str, fields: list[str], order: str = "value") -> DataFrame:
    """Facts to records; values of one field are joined."""
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "value") if order != "value" else F.struct("value"))), lambda x: x["value"]), " | ")
    return long.groupBy(key).pivot("field", fields).agg(cell)


def merge_values(values: Column, numeric: Column) -> Column:
    """First value of a numeric field; prose joined by '; ' unless already said."""
    said = F.aggregate(values, F.lit("").cast("string"), lambda acc, v: F.when((v == "") | F.contains(acc, v), acc).when(acc == "", v).otherwise(F.concat(acc, F.lit("; "), v)))
    first = F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit(""))
    return F.when(numeric, first).otherwise(said)


def inventory(long: DataFrame, samples: int = 6, width: int = 80) -> DataFrame:
    """Fields with counts and a few distinct values.

    Values are counted per field first, so the window that picks samples sees each value once.
    """
    each = long.groupBy("field", F.substring("value", 1, width).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy("value")
    few = each.withColumn("k", F.row_number().over(w)).where(F.col("k") <= samples).groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return each.groupBy("field").agg(F.sum("n").alias("n")).join(few, "field")


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, filled cells, distinct values, mean length, and shape tests; one pass over the cells."""
    cells = [F.struct(F.lit(c).alias("field"), F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias("value")) for c in df.columns]
    each = df.select(F.inline(F.array(*cells))).groupBy("field", "value").agg(F.count("*").alias("n"))
    full = F.col("value") != ""
    label = (F.length("value") <= 24) & ~F.contains("value", F.lit(" ")) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    return each.groupBy("field").agg(
        F.sum("n").alias("rows"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("filled"), F.count_if(full).alias("distinct"),
        F.sum(F.when(full, F.col("n") * F.length("value")).otherwise(0)).alias("chars"), F.bool_and(~full | label).alias("labels"),
    )


def id_column(profile: DataFrame, coverage: float = 0.9, uniqueness: float = 0.9) -> DataFrame:
    """The column whose values are there, differ and are short; a usual name settles a near tie."""
    p = profile.withColumn("unique", F.col("distinct") / F.col("filled")).where((F.col("filled") > 0) & (F.col("filled") / F.col("rows") >= coverage) & (F.col("distinct") / F.col("filled") >= uniqueness))
    s = p.withColumn("score", F.round(F.col("unique") - F.col("chars") / F.col("filled") / 200 + F.when(F.lower("field").isin(HINTS), 0.05).otherwise(0.0), 9))
    return s.groupBy().agg(F.max(F.struct("score", "field")).alias("m")).select("m.field", "m.score")


def noise_columns(profile: DataFrame) -> DataFrame:
    """Columns that say where a row is from: one value, or few that all look like document labels."""
    few = F.col("distinct") <= F.greatest(F.lit(6), F.floor(F.col("rows") * 0.1))
    return profile.where((F.col("rows") > 1) & (F.col("filled") >= 2) & ((F.col("distinct") == 1) | (few & F.col("labels")))).select("field")


def ordinal(df: DataFrame, *order, name: str = "k") -> DataFrame:
    """Each row's place in the order, from 1; numbered within ranges, so no task holds the table."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = scratch(spark, "ordinal")
    # written once: ranges come from a sample and could differ between two runs of the plan
    df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()).write.parquet(at)
    rows = spark.read.parquet(at)
    before = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = before.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_before")
    return rows.join(F.broadcast(before), "_p").withColumn(name, place).drop("_p", "_before")
