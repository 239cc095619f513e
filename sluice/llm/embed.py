"""Embedding near-dedup by sorted projection passes.

Each pass hashes every vector with its own random hyperplanes and orders the vectors of a label
lexicographically by the concatenated hash bits.  The neighbour window of a vector is the run of
vectors that share its leading bits, so many bits that a run of evenly spread vectors holds about
``WINDOW``; a run is compared in blocks of at most ``BLOCK`` vectors, each with itself and with
the other blocks of its run.  So no window cuts a dense group short: what shares the leading
bits is compared, however much it is, by matrix products over a block at a time.  Pairs with
cosine >= the threshold in double precision are links; links of all passes are united.

How many passes: two vectors at the threshold share a hash bit with a known probability, and
meet in a pass if they share the leading bits.  The number of passes makes the chance of missing
such a pair in all of them at most ``MISSED``; it grows with the logarithm of a label's vectors,
and the rule is the same at every size.  A label of up to ``WINDOW`` vectors takes one pass
without a bit, in which all of them meet.

Links are counted where they are found and never become rows: a pair counts in the first pass
in which the two meet, which both can tell from their own bits.  For the components a block
yields the edges of a spanning forest, at most one for each of its vectors.

Equal vectors of a label are one class from the start, so a vector that fills a third of the
table costs one row.  The work of a dense group of unequal vectors grows with its square, as all
its links are asked for, in products of bounded size that spread over the tasks; rows that are
shuffled for it grow with its square divided by ``BLOCK``.

Defined results: null label, null vector, null or non-finite component, or zero length: linked
with nothing.  Vectors of different length aren't compared.  Very long vectors are taken whole.
Rows that repeat vec_id, label and vector count once as a link and are all returned.  Ties: the
least vec_id stands for a component.  Empty table: empty result.  Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD, WINDOW, BLOCK, MISSED = 0.93, 512, 4096, 1e-4
#: Rows of a product in work at once.
STRIPE = 512
#: Sizes of labels, and of long runs, that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def plan(n: int, threshold: float = THRESHOLD, window: int = WINDOW) -> tuple[int, int]:
    """Leading bits and passes for a label of ``n`` vectors."""
    bits = max(0, math.ceil(math.log2(max(1, n) / window)))
    if not bits:
        return 0, 1
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - meet))


def usable(v: F.Column) -> F.Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & sound & F.exists(v, lambda x: x != 0)


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _coded(classes: DataFrame, threshold: float, window: int) -> DataFrame:
    """Classes with their unit vector and the leading bits of each pass; ``n`` is the size of the label."""
    kind = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int, int], np.ndarray] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                vectors, many = b.column("vector"), b.column("n").to_numpy(zero_copy_only=False)
                size = np.diff(vectors.offsets.to_numpy())
                flat, start = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
                for dim, n in np.unique(np.stack((size, many)), axis=1).T.tolist():
                    who = np.flatnonzero((size == dim) & (many == n))
                    x = flat[start[who][:, None] + np.arange(dim)].astype(np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)  # squares then neither overflow nor vanish
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    bits, passes = plan(n, threshold, window)
                    code = np.zeros((len(who), passes), np.int64)
                    if bits:
                        if (dim, bits, passes) not in planes:
                            planes[dim, bits, passes] = np.random.default_rng([dim, 7]).standard_normal((dim, passes * bits))
                        side = (x @ planes[dim, bits, passes]).reshape(len(who), passes, bits) > 0
                        code = side @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    at = np.arange(len(who) + 1, dtype=np.int32)
                    own = b.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("rep"), own.column("label"), own.column("size"), pa.ListArray.from_arrays(pa.array(at * dim), pa.array(x.ravel())), pa.ListArray.from_arrays(pa.array(at * passes), pa.array(code.ravel()))],
                        ["rep", "label", "size", "unit", "codes"],
                    )

    return classes.select("rep", "label", "size", "vector", "n").mapInArrow(run, f"rep long, label {kind}, size long, unit array<double>, codes array<long>")


def _forest(links: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[list, list]:
    """Edges that connect what a matrix of links between rows and columns connects."""
    new_row, new_col, a, b = links.any(axis=1), np.ones(len(cols), bool), [], []
    for k in np.flatnonzero(new_row).tolist():
        if not new_row[k]:
            continue
        new_row[k] = False
        front = np.array([k])
        while len(front):
            hit = links[front].any(axis=0) & new_col
            new_col &= ~hit
            front = np.flatnonzero(links[:, hit].any(axis=1) & new_row) if hit.any() else front[:0]
            new_row[front] = False
            found = np.concatenate((cols[hit], rows[front]))
            a.append(np.full(len(found), rows[k]))
            b.append(found)
    return a, b


def _links(ordered: DataFrame, threshold: float) -> DataFrame:
    """Of each group of rows: edges (a, b), and for a vector ``a`` how many others it is linked with here."""

    def group(t: int, one: bool, rep, size, unit, code, second) -> Iterator[pa.RecordBatch]:
        left, right = (np.arange(len(rep)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
        if not len(left) or not len(right):
            return
        links, other = np.zeros((len(left), len(right)), bool), unit[right].T
        for k in range(0, len(left), STRIPE):
            part = left[k : k + STRIPE]
            hit = unit[part] @ other >= threshold
            if one:
                hit[np.arange(len(part)), np.arange(k, k + len(part))] = False
            some = np.flatnonzero(hit.any(axis=0))
            for q in range(t):
                if not len(some):
                    break
                hit[:, some] &= code[part, q][:, None] != code[right[some], q]  # they met before
            links[k : k + STRIPE] = hit
        if not links.any():
            return
        a, b = _forest(links, rep[left], rep[right])
        counts = [(rep[left], links @ size[right].astype(np.float64))] + ([] if one else [(rep[right], size[left].astype(np.float64) @ links)])
        who, n = (np.concatenate(x) for x in zip(*counts))
        n = np.rint(n).astype(np.int64)
        who, n = who[n > 0], n[n > 0]
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((a, who))), pa.concat_arrays([pa.array(b), pa.nulls(len(who), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(n)])], ["a", "b", "n"]
        )

    def groups(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > 1:
                own = table.slice(lo, hi - lo).combine_chunks()
                flat = {c: own.column(c).chunk(0).to_numpy(zero_copy_only=False) for c in ("i", "j", "block", "rep", "size")}
                wide = [own.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1) for c in ("unit", "codes")]
                one = bool(flat["i"][0] == flat["j"][0])
                yield from group(own.column("pass")[0].as_py(), one, flat["rep"], flat["size"], *wide, flat["block"] != flat["i"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the last group, which may go on in the next batch
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                table = pa.Table.from_batches([*rest, whole.slice(k, BLOCK)])
                g1, g2 = (table.column(c).to_numpy() for c in ("g1", "g2"))
                cuts = [0, *(np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + 1).tolist()]
                yield from groups(table, cuts)
                rest = table.slice(cuts[-1]).to_batches()
        if rest:
            table = pa.Table.from_batches(rest)
            yield from groups(table, [0, table.num_rows])

    return ordered.mapInArrow(run, "a long, b long, n long")


def link(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ws = common.Workspace(spark, "embed")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False)))
    classes = ws.save(
        rows.where("ok").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("size")), "classes"
    )
    sized = classes.select("rep", "label", "size", "vector", F.size("vector").alias("dim"))
    labels = ws.save(sized.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumnRenamed("dim", "d").withColumnRenamed("label", "l"), "labels")
    coded = sized.join(_checked(labels), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    coded = ws.save(_coded(coded, threshold, window), "coded")
    run = ["label", F.size("unit").alias("dim"), F.posexplode("codes").alias("pass", "cell")]
    long = coded.select(*run).groupBy("label", "dim", "pass", "cell").agg(F.count("*").alias("many")).where(F.col("many") > block)
    long = ws.save(long.toDF("l", "d", "p", "c", "many"), "long")
    placed = coded.select("rep", "size", "unit", "codes", *run).join(
        _checked(long), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("pass") == F.col("p")) & (F.col("cell") == F.col("c")), "left"
    )
    blocks = F.coalesce(F.ceil(F.col("many") / block), F.lit(1)).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    key = ["label", "dim", "pass", "cell", "i", "j"]
    placed = placed.select(F.xxhash64(*key).alias("g1"), F.xxhash64(*key, F.lit(1)).alias("g2"), "pass", "i", "j", "block", "rep", "size", "unit", "codes")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = ws.save(_links(placed.repartition(parts, "g1", "g2").sortWithinPartitions("g1", "g2"), threshold), "links")
    degree = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("others"))
    groups = common.components(ws, found.where("n is null").select("a", "b"))
    ends = (
        classes.join(degree, classes["rep"] == degree["a"], "left").join(groups, F.col("rep") == F.col("node"), "left")
        .select("label", "vector", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    out = rows.where("ok").join(ends, ["label", "vector"]).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.read(spark, sf_dir, "embeddings"))
