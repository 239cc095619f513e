"""MinHash near-dedup with tensored banding.

Instead of fresh minhashes for every table, two small collections of ``SIDES`` half keys are
made, each of ``DEPTH`` minhashes; every pair (one half key from each) is a table.  So
``SIDES ** 2`` tables cost ``2 * SIDES * DEPTH`` minhashes.  Two sets at the threshold share no
table with a probability of 7e-5 for 0.85 and 6e-4 for 0.80.

Equal sets are one class from the start.  A class has a row for each table; rows alone in their
bucket go at once.  Most of a group is united first, cheaply: ``SIDES`` of the tables are sorted
by bucket, then by the bytes of further minhashes, and each row is proposed with the first of its
bucket and the ``NEIGHBOURS`` rows before it.  A sort splits a bucket of any size over tasks; the
rows at the borders are brought together and proposed in the same way.  This proposes in
proportion to the rows, and what it leaves out the second step finds.

The second step takes every bucket of every table that holds more than one component and compares
all its pairs of different components: those that pass the ratio of set sizes and agree in enough
minhashes (a true link fails with a probability below 1e-4) are candidates.  What candidates
connect is a cluster of components; in a cluster all pairs of different components are compared by their full
sets, made again from the texts, with products of 0/1 matrices that count common shingles.
Nothing is capped and no round is left out.  Rows of a large group share many buckets; buckets
of more than ``CROWD`` rows that have components in common are one group, each row once, so that
its pairs are compared once, not again in each table (unless that makes more pairs than the
buckets have).  A large group or cluster is dealt into blocks of ``NUMBERS`` or ``BLOCK`` rows,
and blocks meet in pairs; the blocks of its largest component don't meet each other.  So where most of a group is one component, rows grow with the group, times its rows
outside that component; a group without any links costs its square, in blocks.  Neither
candidates nor links of a block become rows each: a block gives the edges of a spanning forest.

What can be missed: a linked pair that shares no table, or that agrees in too few minhashes.

Defined results: null text, or text without words: n_shingles 0, linked with nothing.  Very long
texts are cut into words segment by segment; their sets are whole.  Ties: of a group the least
doc_id is kept.  Rows that share a doc_id are one document for links; each is returned.  Rows
without a doc_id link with nothing and are kept.  Empty table: empty result.  Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, embed, shingles

WIDTH, SIDES, DEPTH = 5, 8, 2
#: Rows of a bucket, just before it in the bucket's order, with which one is compared in the first step.
NEIGHBOURS = 2
#: Rows and bytes of text of a block; larger clusters are compared by pairs of blocks.
BLOCK, BYTES_OF_BLOCK = 512, 1 << 24
#: Rows of a block of minhashes, which have no text; rows of a bucket beyond which it may join others.
NUMBERS, CROWD = 1024, 128
#: Groups of rows up to which their pairs are made by shifts, without a matrix; rows and columns of a matrix in work.
FEW, STRIPE, COLUMNS = 9, 64, 4096
#: A link is 100 * intersection >= PERCENT * union.
PERCENT = 85
#: The pipeline's stage has no contract of its own and takes the usual 0.8.
STAGE_PERCENT = 80
#: Ids that may be broadcast; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000

#: Chance that a pair at the threshold agrees in fewer bytes of minhashes than is asked for.
FAILS = 1e-4
BYTES = [f"low{k}" for k in range(2 * SIDES * DEPTH // 8)]

_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 63, 2 * SIDES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 64, 2 * SIDES * DEPTH, np.uint64)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_shingles, two hashes of the whole set, half keys, a byte of each minhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                sets = list(shingles.shingle_sets(b.column("text"), width))
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                some = np.flatnonzero(n)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                start = (np.cumsum(n) - n)[some]
                low = np.zeros((len(sets), len(_A)), np.uint64)
                whole_hash = np.zeros((2, len(sets)), np.uint64)
                if len(some):
                    for j in range(len(_A)):
                        low[some, j] = np.minimum.reduceat(flat * _A[j] + _B[j], start)
                    whole_hash[0, some] = np.add.reduceat(shingles.mix(flat), start)
                    whole_hash[1, some] = np.add.reduceat(shingles.mix(flat + np.uint64(0x1234567)), start)
                half = low.reshape(len(sets), 2 * SIDES, DEPTH)
                keys = np.zeros((len(sets), 2 * SIDES), np.uint64)
                for d in range(DEPTH):
                    keys = shingles.mix(keys + half[:, :, d])
                keys = shingles.mix(keys + np.arange(2 * SIDES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                as_long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), pa.array(n), as_long(whole_hash[0]), as_long(whole_hash[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 2 * SIDES), as_long(keys.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (SIDES * DEPTH // 4)), as_long(_places(low).ravel())),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "halves", "place"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, h1 long, h2 long, halves array<long>, place array<long>"
    )


def _places(low: np.ndarray) -> np.ndarray:
    """A byte of each minhash, eight to a number: what rows of a bucket are ordered by."""
    return np.ascontiguousarray((low[:, : 2 * SIDES * DEPTH] >> np.uint64(40)).astype(np.uint8)).view(">u8").astype(np.uint64)


def agree(percent: int) -> int:
    """In how many of the minhash bytes two sets at the threshold agree, but for a chance of ``FAILS``."""
    n, p = 2 * SIDES * DEPTH, percent / 100
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > FAILS:
            return k
    return n


def _tables(classes: DataFrame) -> DataFrame:
    """A row for each class and table; the table's number stands in the last bits of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                half = b.column("halves").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(b.num_rows, 2, SIDES)
                key = shingles.mix(half[:, 0, :, None] * _A[0] + half[:, 1, None, :]).reshape(b.num_rows, SIDES * SIDES)
                key = key & ~np.uint64(SIDES * SIDES - 1) | np.arange(SIDES * SIDES, dtype=np.uint64)
                rep = np.repeat(b.column("rep").to_numpy(zero_copy_only=False), SIDES * SIDES)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rep)], ["key", "rep"])

    return classes.select("rep", "halves").mapInArrow(run, "key long, rep long")


def _crowded(ordered: DataFrame) -> DataFrame:
    """Rows that aren't alone in their bucket; those of a task's first and last bucket stay, as it may go on beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, key, rep = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = lambda ok: pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(rep[ok])], ["key", "rep"])
        again = np.zeros(0, bool)  # whether the row held back has its key in common with one that is out
        for b in batches:
            if not b.num_rows:
                continue
            key, rep = (np.concatenate((x, b.column(c).to_numpy(zero_copy_only=False))) for x, c in ((key, "key"), (rep, "rep")))
            head = key[0] if head is None else head
            same = key[1:] == key[:-1]
            ok = (key == head) | np.append(False, same) | np.append(same, False)
            ok[: len(again)] |= again
            yield out(slice(0, -1) if ok[:-1].all() else np.flatnonzero(ok[:-1]))
            key, rep, again = key[-1:], rep[-1:], ok[-1:]
        if len(key):
            yield out(slice(None))

    return ordered.mapInArrow(run, "key long, rep long")


ROW = ["key", "place", "rep", "comp", "n", *BYTES]


def _proposals(ordered: DataFrame, percent: int, neighbours: int) -> DataFrame:
    """Of sorted rows: pairs (a, b), and the rows at the borders of each task."""
    least = agree(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = pa.array([], pa.int64())

        def out(pairs: list, rows: list) -> pa.RecordBatch:
            n, m = len(pairs[0]), len(rows[0])
            fill = lambda x, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), x, pa.nulls(after, pa.int64())])
            return pa.RecordBatch.from_arrays([*(fill(x, 0, m) for x in pairs), *(fill(x, n, 0) for x in rows)], ["a", "b", *ROW])

        rows, border = None, [nothing] * len(ROW)
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in ROW]
            if rows is None:
                border = [pa.array(x[: neighbours + 1]) for x in new]
            rows = new if rows is None else [np.concatenate(x) for x in zip(rows, new)]
            key, _, rep, comp, n = rows[:5]
            low = np.stack(rows[5:], axis=1).view(np.uint8)
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            old = np.flatnonzero(~fresh)
            one = np.concatenate((first[old], *(np.maximum(old - k, first[old]) for k in range(1, neighbours + 1))))
            two = np.tile(old, neighbours + 1)
            ok = (comp[one] != comp[two]) & (100 * np.minimum(n[one], n[two]) >= percent * np.maximum(n[one], n[two]))
            one, two = one[ok], two[ok]
            ok = (low[one] == low[two]).sum(axis=1) >= least
            x, y = rep[one[ok]], rep[two[ok]]
            if len(x):
                pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
                yield out([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], [nothing] * len(ROW))
            keep = sorted({int(first[-1]), *range(max(int(first[-1]), len(key) - neighbours), len(key))})
            rows = [x[keep] for x in rows]
        if rows is not None:
            yield out([nothing] * 2, [pa.concat_arrays([x, pa.array(y)]) for x, y in zip(border, rows)])

    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in ["a", "b", *ROW]))


def _first(ws: common.Workspace, live: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs (a, b) that the first step proposes."""
    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = F.col("key").bitwiseAND(SIDES * SIDES - 1).cast("int")
    word, turn = table % len(BYTES), table % 7 + 1
    low = F.element_at(F.array(*BYTES), word + 1)
    place = F.call_function("shiftleft", low, 8 * turn).bitwiseOR(F.call_function("shiftrightunsigned", low, 64 - 8 * turn))
    rows = live.where(table % (SIDES + 1) == 0).select("key", place.alias("place"), "rep", F.col("rep").alias("comp"), "n", *BYTES)
    order = ["key", "place", "rep"]
    made = ws.save(_proposals(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), percent, NEIGHBOURS).coalesce(tasks), "proposals")
    # a few rows from each task: where a bucket goes on in the next one
    border = made.where("key is not null").select(*ROW).distinct().coalesce(1).sortWithinPartitions(*order)
    pairs = made.select("a", "b").union(_proposals(border, percent, NEIGHBOURS).select("a", "b")).where("a is not null").distinct()
    return ws.save(pairs.coalesce(tasks), "pairs")


def _merged(ws: common.Workspace, rows: DataFrame) -> DataFrame:
    """``rows(key, comp, rep, ...)`` of buckets with several components; crowded ones that share components are one, each row once."""
    each = rows.groupBy("key").agg(F.count("*").alias("many"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    each = ws.save(each, "keys")
    crowded = each.where(F.col("many") > CROWD)
    if not crowded.limit(1).count():
        return rows
    own = rows.join(crowded, "key")
    edges = own.select(F.col("comp").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    group = common.components(ws, edges).toDF("comp", "group")
    own = own.join(group, "comp").withColumn("again", F.row_number().over(Window.partitionBy("group", "rep").orderBy("key")) > 1)
    own = ws.save(own, "crowded")
    # what the group compares once, against what its buckets compare
    once = own.where("not again").groupBy("group").agg(F.count("*").alias("once"))
    apart = own.groupBy("group", "key").agg(F.count("*").cast("double").alias("n")).groupBy("group").agg(F.sum(F.col("n") * F.col("n")).alias("apart"))
    better = once.join(apart, "group").where(F.col("once").cast("double") * F.col("once") < F.col("apart")).select("group", F.lit(True).alias("merge"))
    own = own.join(better, "group", "left").where("merge is null or not again")
    own = own.withColumn("key", F.when(F.col("merge"), F.xxhash64(F.lit("group"), "group")).otherwise(F.col("key"))).select(rows.columns)
    return rows.join(each.where(F.col("many") <= CROWD).select("key"), "key", "left_semi").unionByName(own)


def _blocked(rows: DataFrame, group: str, block: int) -> DataFrame:
    """``rows(group, comp, rep, size, ...)`` of groups with several components, dealt into the pairs of blocks that must meet.

    A pair of blocks has one (g1, g2); ``one`` if it is a block with itself, ``second`` for rows of the second block.
    """
    each = rows.groupBy(group, "comp").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    whole = each.groupBy(F.col(group).alias("of")).agg(F.count("*").alias("comps"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.max(F.struct("m", "s", "comp")).alias("top"))
    need = lambda m, s: F.greatest(F.ceil(m / block), F.ceil(s / BYTES_OF_BLOCK), F.lit(1)).cast("int")
    split = need(F.col("m"), F.col("s")) > 1
    whole = whole.where("comps > 1").select(
        "of", F.col("top.comp").alias("main"), F.when(split, need(F.col("top.m"), F.col("top.s"))).otherwise(0).alias("p"), need(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("q")
    )
    own, p, q = F.col("comp") == F.col("main"), F.col("p"), F.col("q")
    deal = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    placed = rows.join(whole, F.col(group) == F.col("of"))
    placed = placed.withColumn("block", F.when(p == 0, 0).when(own, deal(p)).otherwise(p + deal(q)))
    placed = placed.withColumn("with", F.explode(F.when(p == 0, F.array(F.lit(0))).when(own, F.sequence(p, p + q - 1)).otherwise(F.sequence(F.lit(0), p + q - 1))))
    i, j = F.least("block", "with"), F.greatest("block", "with")
    placed = placed.withColumns({"g1": F.xxhash64(group, i, j), "g2": F.xxhash64(group, i, j, F.lit(1)), "one": i == j, "second": F.col("block") != i})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in rows.columns if c not in (group, "size")]
    return placed.select("g1", "g2", "one", "second", *keep).repartition(parts, "g1", "g2").sortWithinPartitions("g1", "g2")


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole groups, and where each starts and ends."""
    rest: list[pa.RecordBatch] = []  # of the last group, which may go on in the next batch
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            table = pa.Table.from_batches([*rest, batch.slice(k, most)])
            g1, g2 = (table.column(c).to_numpy() for c in ("g1", "g2"))
            cuts = np.append(0, np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + 1)
            if len(cuts) > 1:
                yield table.slice(0, cuts[-1]), cuts
            rest = table.slice(cuts[-1]).to_batches()
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, np.array([0, table.num_rows])


def _sides(one: bool, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and the columns of a group's matrix."""
    return (np.arange(len(second)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))


def _edges(matrix: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[list, list]:
    return embed._forest(matrix, rows, cols) if matrix.any() else ([], [])


def _candidates(blocks: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components; they connect what is connected by pairs that may be links."""
    least = agree(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole(batches, 10_000):
            one, second, comp, n = (table.column(c).to_numpy() for c in ("one", "second", "comp", "n"))
            low = np.stack([table.column(c).to_numpy() for c in BYTES], axis=1).view(np.uint8)

            def passes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                ok = np.flatnonzero((comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])))
                return ok[(low[x[ok]] == low[y[ok]]).sum(axis=1) >= least]

            size = np.diff(cuts)
            few, group = size <= FEW, np.repeat(np.arange(len(size)), size)
            a, b = [], []
            for k in range(1, FEW):
                y = np.flatnonzero((group[k:] == group[:-k]) & few[group[k:]]) + k
                y = y[one[y] | (second[y] != second[y - k])]
                y = y[passes(y - k, y)]
                a.append(comp[y - k])
                b.append(comp[y])
            for g in np.flatnonzero(~few).tolist():
                left, right = (x + cuts[g] for x in _sides(one[cuts[g]], second[cuts[g] : cuts[g + 1]]))
                may = np.zeros((len(left), len(right)), bool)
                for k in range(0, len(left), STRIPE):
                    i, j = np.nonzero(comp[left[k : k + STRIPE], None] != comp[right])
                    i += k
                    if one[cuts[g]]:
                        i, j = i[i < j], j[i < j]
                    ok = passes(left[i], right[j])
                    may[i[ok], j[ok]] = True
                for all_, new in zip((a, b), _edges(may, comp[left], comp[right])):
                    all_ += new
            edges = np.stack((np.concatenate(a), np.concatenate(b)), axis=1)
            edges.sort(axis=1)
            edges = np.unique(edges[edges[:, 0] < edges[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``."""
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = many[at] > 1
    own, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[some], (np.cumsum(many > 1) - 1)[at[some]]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    out = np.zeros((len(left), len(right)))
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        first, last = np.searchsorted(col, (lo, lo + COLUMNS))
        m = np.zeros((len(sets), int(col[last - 1]) + 1 - lo), np.float32)  # sums of one product stay below 2 ** 24
        m[own[first:last], col[first:last] - lo] = 1
        out += m[left] @ m[right].T
    return out


def _exact(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect what links between different components connect; links are counted on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole(batches, 2 * BLOCK):
            a, b = [], []
            one, second, rep, comp = (table.column(c).to_numpy() for c in ("one", "second", "rep", "comp"))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                left, right = _sides(one[lo], second[lo:hi])
                other = comp[lo:hi][left, None] != comp[lo:hi][right]
                if not other.any():
                    continue
                sets = list(shingles.shingle_sets(table.column("text").slice(lo, hi - lo).combine_chunks(), width))
                n, shared = np.array([len(s) for s in sets]), _common(sets, left, right)
                links = other & (shared > 0) & (100 * shared >= percent * (n[left, None] + n[right] - shared))
                for all_, new in zip((a, b), _edges(links, rep[lo:hi][left], rep[lo:hi][right])):
                    all_ += new
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])
            common.release()

    return blocks.mapInArrow(run, "a long, b long")


def _rest(ws: common.Workspace, docs: DataFrame, live: DataFrame, found: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """Links (a, b) between the components found so far: of every pair that shares a table."""
    comp = F.coalesce("component", "rep").alias("comp")
    rows = ws.save(live.join(found, F.col("rep") == F.col("node"), "left").select("key", comp, "rep", F.lit(0).alias("size"), "n", *BYTES), "buckets")
    near = ws.save(_candidates(_blocked(_merged(ws, rows), "key", NUMBERS), percent).distinct().coalesce(tasks), "near")
    ws.drop(rows)
    clusters = common.components(ws, near).toDF("comp", "cluster")
    members = clusters.join(found, F.col("comp") == F.col("component"), "left").select(F.coalesce("node", "comp").alias("id"), "comp", "cluster")
    members = ws.save(members.coalesce(tasks), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    n = members.count()
    texts = only(texts, "id", members.select("id"), n).distinct().join(members, "id")
    texts = texts.select("cluster", "comp", F.col("id").alias("rep"), F.octet_length("text").alias("size"), "text")
    texts = ws.save(texts.coalesce(common.tasks(n, 10_000)), "clusters")
    links = ws.save(_exact(_blocked(texts, "cluster", BLOCK), width, percent).coalesce(tasks), "links")
    ws.drop(texts)
    return links


def _confirm(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among pairs with both texts, on the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                b = whole.slice(k, 128)
                keep = []
                for x, y in zip(shingles.shingle_sets(b.column("ta"), width), shingles.shingle_sets(b.column("tb"), width)):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0)
                yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def only(df: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` whose column is among ``n`` ids; the ids are broadcast if they are few."""
    ids = ids.withColumnRenamed(ids.columns[0], column)
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, column, "left_semi")


def _linked(ws: common.Workspace, docs: DataFrame, pairs: DataFrame, n: int, width: int, percent: int) -> DataFrame:
    """Those of ``n`` proposed pairs that are links."""
    ids = pairs.select("a").union(pairs.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    few = common.tasks(n, 10_000)
    texts = ws.save(only(texts, "id", ids, 2 * n).distinct().coalesce(few), "texts")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    linked = _confirm(both, width, percent).coalesce(few)
    linked = ws.save(linked.distinct().coalesce(few), "links")
    ws.drop(texts)
    return linked


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ws = common.Workspace(spark, "minhash")
    rows = ws.save(signatures(docs, width), "rows")
    classes = ws.save(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves"), F.first("place").alias("place")),
        "classes",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _tables(classes).repartitionByRange(parts, "key", "rep").sortWithinPartitions("key", "rep")
    crowded = ws.save(_crowded(ordered).coalesce(common.tasks(SIDES * classes.count())), "crowded")
    live = crowded.join(classes.select("rep", F.col("n_shingles").alias("n"), *[F.col("place")[k].alias(c) for k, c in enumerate(BYTES)]), "rep")
    live = ws.save(live, "live")
    ws.drop(crowded)
    tasks = common.tasks(live.count())
    pairs = _first(ws, live, percent, tasks)
    links = _linked(ws, docs, pairs, pairs.count(), width, percent)
    found = common.components(ws, links)
    found = common.components(ws, links.union(_rest(ws, docs, live, found, width, percent, tasks)))
    member = classes.join(found, classes["rep"] == found["node"], "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "h1", "h2").join(member, ["h1", "h2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at a similarity of 0.8 or more, the one with the least id.

    Rows that share an id are one document and stay or go together; of those that share the text
    too, one stays.  Rows without an id all stay.
    """
    own, n, row = F.col("doc_id"), common.fresh(docs, "n"), common.fresh(docs, "other")
    gone = groups(docs, percent=STAGE_PERCENT).where("not kept").select(F.col("doc_id").alias(row)).distinct()
    kept = docs.join(gone, own.cast("long") == F.col(row), "left_anti")
    again = docs.where(own.isNotNull()).groupBy(own.alias(row)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(row)
    again = common.Workspace(spark, "minhash").save(again, "again")
    if not again.limit(1).count():
        return kept
    # only the rows that share an id are compared
    shared = kept.join(again, own == F.col(row), "left_semi")
    return kept.join(again, own == F.col(row), "left_anti").unionByName(shared.dropDuplicates(["doc_id", "text"]))
