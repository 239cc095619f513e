"""A property graph as two frames: nodes(id, label, props) and edges(src, dst, type, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nodes(df: DataFrame, label: str, key: str, props: list[str]) -> DataFrame:
    """A node for each distinct key; the id carries the label, so ids of different tables don't meet."""
    pairs = [x for p in props for x in (F.lit(p), F.col(p).cast("string"))]
    return df.where(F.col(key).isNotNull()).select(node_id(label, F.col(key)).alias("id"), F.lit(label).alias("label"), (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("props"))


def node_id(label: str, key: Column) -> Column:
    return F.concat(F.lit(label + ":"), key.cast("string"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New properties over old ones, per id (K1)."""
    both = old.select("id", "label", "props", F.lit(0).alias("v")).union(new.select("id", "label", "props", F.lit(1).alias("v")))
    per = both.groupBy("id").agg(F.max_by("label", "v").alias("label"), F.transform(F.array_sort(F.collect_list(F.struct("v", F.map_entries("props").alias("e")))), lambda x: x["e"]).alias("all"))
    last = F.aggregate("all", F.expr("cast(map() as map<string,string>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: ~F.exists(e, lambda x: x["key"] == k)), F.map_from_entries(e)))
    return per.select("id", "label", last.alias("props"))


def edges(df: DataFrame, kind: str, src: Column, dst: Column) -> DataFrame:
    """Distinct typed edges (K2)."""
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type")).where("src is not null and dst is not null").distinct()


def matched(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes_.select("id")
    return edges_.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


def neighbours(edges_: DataFrame) -> DataFrame:
    """Distinct neighbours, either way."""
    return edges_.select("src", "dst").union(edges_.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def duplicates(nodes_: DataFrame) -> DataFrame:
    """Ids that break uniqueness (K8)."""
    return nodes_.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def corroborated(records: DataFrame, names: DataFrame, documents: int = 2) -> DataFrame:
    """Pairs of names that records in several documents mention, by the first two of each record (K6).

    ``records``: doc, record, words (array); ``names``: name.
    """
    hit = records.select("doc", "record", F.posexplode("words").alias("at", "name")).join(F.broadcast(names), "name")
    first = hit.groupBy("doc", "record", "name").agg(F.min("at").alias("at"))
    w = Window.partitionBy("doc", "record").orderBy("at")
    two = first.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("doc", "record").agg(F.array_sort(F.collect_list("name")).alias("p")).where(F.size("p") == 2)
    return two.groupBy(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b")).agg(F.count_distinct("doc").alias("docs")).where(F.col("docs") >= documents)


def build(spark, tables: dict[str, DataFrame], plan: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges by a plan of node and relationship rules."""
    n = e = None
    for rule in plan:
        t = tables[rule["table"]]
        if rule["kind"] == "node":
            got = nodes(t, rule["label"], rule["key"], rule.get("props", [])).dropDuplicates(["id"])
            n = got if n is None else n.unionByName(got)
        else:
            got = edges(t, rule["type"], node_id(rule["from_label"], F.col(rule["from"])), node_id(rule["to_label"], F.col(rule["to"])))
            e = got if e is None else e.unionByName(got)
    return n, matched(e, n)
