"""Text to blocks, chunks and parsed rule lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import text as T


def blocks(lines: DataFrame) -> DataFrame:
    """Numbers of the runs of lines between blank lines, from 1 (N1). ``lines``: doc_id, n, s."""
    w = Window.partitionBy("doc_id").orderBy("n")
    blank = F.trim("s") == ""
    fresh = ~blank & F.coalesce(F.lag(blank).over(w), F.lit(True))
    out = lines.withColumn("_new", fresh.cast("int")).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(~blank).drop("_new")


def carried(lines: DataFrame, label: F.Column, name: str) -> DataFrame:
    """The last label so far, for every line."""
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(label, ignorenulls=True).over(w))


def pack(blocks_: DataFrame, budget: int) -> DataFrame:
    """Chunks of whole blocks up to a budget; a longer block is cut between lines.

    ``blocks_``: doc_id, n, s, block, heading, ruled.  Greedy and in order, so one document is
    worked on as a whole; documents are independent.
    """
    kind = blocks_.schema["doc_id"].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out, chunk, size, section, last, number = [], [], 0, "", "", 0

        def close():
            nonlocal chunk, size, section, number
            if chunk:
                out.append((f["doc_id"].iloc[0], number, section, chunk))
                number += 1
            chunk, size, section = [], 0, last

        for _, b in f.sort_values("n").groupby("block", sort=True):
            if len(b) == 1 and b["heading"].iloc[0]:
                last = b["heading"].iloc[0]
                if chunk:
                    size += len(last) + 12
                else:
                    section = last
                continue
            rows = [(int(n), len(s) + 1) for n, s, r in zip(b["n"], b["s"], b["ruled"]) if not r]
            whole = sum(k for _, k in rows)
            if not rows:
                continue
            if whole > budget:
                close()
                for n, k in rows:
                    if chunk and size + k > budget:
                        close()
                    chunk.append(n)
                    size += k
                close()
                continue
            if chunk and size + whole > budget:
                close()
            chunk += [n for n, _ in rows]
            size += whole
        close()
        return pd.DataFrame(out, columns=["doc_id", "chunk", "section", "lines"])

    return blocks_.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, chunk int, section string, lines array<int>")


def paragraphs(text: str, most: int, least: int) -> list[str]:
    """Paragraphs merged up to a size; a small last piece joins the one before."""
    out: list[str] = []
    for p in (p.strip() for p in re.split(r"\n{2,}", text or "")):
        if not p:
            continue
        if out and len(out[-1]) + 2 + len(p) <= most:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least:
        tail = out.pop()
        out[-1] += "\n\n" + tail
    return out


def paragraph_chunks(docs: DataFrame, most: int = 2000, least: int = 200) -> DataFrame:
    """doc_id, chunk, text; a map over the documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = [(i, k, p) for i, t in zip(f["doc_id"], f["text"]) for k, p in enumerate(paragraphs(t, most, least))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk int, text string")


def rendered(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """A chunk as numbered lines under its section."""
    each = chunks.select("doc_id", "chunk", "section", F.explode("lines").alias("n")).join(lines, ["doc_id", "n"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: F.concat(F.lit("L"), x["n"].cast("string"), F.lit(": "), x["s"])), "\n")
    return each.groupBy("doc_id", "chunk", "section").agg(body.alias("body")).select("doc_id", "chunk", F.concat(F.when(F.col("section") != "", F.concat(F.lit("[Section: "), "section", F.lit("]\n"))).otherwise(F.lit("")), "body").alias("text"))


def shaped(lines: DataFrame) -> DataFrame:
    """Blocks with what packing needs to know of each line."""
    return blocks(lines).withColumn("heading", T.heading(F.col("s"))).withColumn("ruled", T.is_rule_off(F.col("s")))
