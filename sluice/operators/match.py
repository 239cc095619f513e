"""Matching records: scored pairs, optimal one-to-one assignment, audit rows, medoids, clusters, top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sluice.sources.tables import small

#: Blocks of queries up to which they may be broadcast.
SMALL_BLOCKS = 800
#: Rows of a block of names; larger groups meet as pairs of blocks.
BLOCK_OF_NAMES = 1024


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs with the greatest total score, each row and column at most once (L2).

    Successive shortest augmenting paths with dual prices on costs 1 - score, in the size of the
    smaller side squared times the larger; all columns of a step are relaxed as one array.
    """
    score = np.asarray(score, float)
    if score.size == 0:
        return []
    turned = score.shape[0] > score.shape[1]
    cost = 1.0 - (score.T if turned else score)
    n, m = cost.shape
    price_row, price_col = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)  # the row that holds a column
    for row in range(n):
        reach, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, col, far = row, -1, 0.0
        while True:
            step = far + cost[at] - price_row[at] - price_col
            better = ~done & (step < reach)
            reach[better], back[better] = step[better], col
            col = int(np.argmin(np.where(done, np.inf, reach)))
            far, done[col] = reach[col], True
            if owner[col] < 0:
                break
            at = owner[col]
        settled = done & (owner >= 0)
        price_row[row] += far
        price_row[owner[settled]] += far - reach[settled]
        price_col[done] += reach[done] - far
        while col >= 0:
            prior = back[col]
            owner[col] = row if prior < 0 else owner[prior]
            col = prior
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return sorted((c, r) for r, c in pairs) if turned else sorted(pairs)


def assignment(pairs: DataFrame, group: str) -> DataFrame:
    """Optimal pairs of each group of ``pairs(group, gt, pred, score)``; a group is one corpus and run.

    Of repeated pairs the best score counts; a pair that isn't there scores 0.
    """
    kind = pairs.schema[group].dataType.simpleString()

    def run(batches):
        for b in batches:
            who, own, gts, preds, scores = b.column(0), b.column(1), [], [], []
            at, rows = [], own.offsets.to_numpy()
            flat = [own.values.field(c).to_numpy(zero_copy_only=False) for c in ("gt", "pred", "score")]
            for k in range(b.num_rows):
                g, p, s = (x[rows[k] : rows[k + 1]] for x in flat)
                left, i = np.unique(g, return_inverse=True)
                right, j = np.unique(p, return_inverse=True)
                m = np.zeros((len(left), len(right)))
                np.maximum.at(m, (i, j), s)
                got = assign(m)
                at += [k] * len(got)
                gts += [left[r] for r, _ in got]
                preds += [right[c] for _, c in got]
                scores += [m[r, c] for r, c in got]
            yield pa.RecordBatch.from_arrays([who.take(pa.array(at, pa.int64())), pa.array(gts, pa.int64()), pa.array(preds, pa.int64()), pa.array(scores, pa.float64())], [group, "gt", "pred", "score"])

    rows = pairs.select(group, F.struct(F.col("gt").cast("long").alias("gt"), F.col("pred").cast("long").alias("pred"), F.col("score").cast("double").alias("score")).alias("_pair"))
    return rows.groupBy(group).agg(F.collect_list("_pair").alias("pairs")).mapInArrow(run, f"{group} {kind}, gt long, pred long, score double")


def closeness(g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``functions.text.closeness`` on arrays."""
    with np.errstate(over="ignore"):
        return np.maximum(0.0, 1 - np.abs(g - p) / np.maximum(np.maximum(np.abs(g), np.abs(p)), 1e-9))


def _ship(score: np.ndarray, supply: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Units from each row to each column with the greatest total score: rows ship all, columns take at most their room.

    As ``assign``, but a path carries as many units as fit, so equal rows or columns cost one.
    """
    cost, (n, m), room = 1.0 - score, score.shape, room.copy()
    price_row, price_col, units = np.zeros(n), np.zeros(m), np.zeros((n, m), np.int64)
    for row in range(n):
        need = int(supply[row])
        while need:
            far, reach = 0.0, cost[row] - price_row[row] - price_col
            back, done, met = np.full(m, row), np.zeros(m, bool), {row: (0.0, -1)}  # row: distance, column it was met by
            while True:
                left = np.where(done, np.inf, reach)
                ends = left == left.min()
                # of columns equally far, one with room
                col = int(np.argmax(ends & (room > 0))) if (ends & (room > 0)).any() else int(np.argmax(ends))
                far, done[col] = left[col], True
                if room[col]:
                    break
                for at in np.flatnonzero(units[:, col]).tolist():
                    if at not in met:
                        met[at] = (far, col)
                        step = far + cost[at] - price_row[at] - price_col
                        better = ~done & (step < reach)
                        reach[better], back[better] = step[better], at
            for at, (near, _) in met.items():
                price_row[at] += far - near
            price_col[done] += reach[done] - far
            path, at = [], col
            while at >= 0:
                path.append((int(back[at]), at))
                at = met[int(back[at])][1]
            # a row on the path gives up units of the column it was met by
            given = [(r, met[r][1]) for r, _ in path if met[r][1] >= 0]
            many = min([need, int(room[col]), *(int(units[g]) for g in given)])
            for to in path:
                units[to] += many
            for g in given:
                units[g] -= many
            room[col] -= many
            need -= many
    return units


def _nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted ``x`` and ``y``, ``y`` not shorter: places in ``y`` for all of ``x`` with the greatest total closeness, and the scores.

    Of K rows, each does best among its K nearest columns on either side: the K - 1 others can't
    hold all of them, and closeness falls away from a number to both sides.  So rows whose
    stretches of ``y`` overlap are solved together, and the others on their own, exactly.
    """
    place = np.zeros(len(x), np.int64)
    value, start, many = np.unique(x, return_index=True, return_counts=True)
    at = np.searchsorted(y, value, "left").tolist()
    # first and last distinct value of a component, and its rows
    parts: list[tuple[int, int, int]] = []
    for k, n in enumerate(many.tolist()):
        first, last = k, k
        while parts and at[parts[-1][1]] + parts[-1][2] > at[first] - n:
            first, n = parts[-1][0], n + parts[-1][2]
            parts.pop()
        parts.append((first, last, n))
    lone = np.array([f for f, _, n in parts if n == 1], np.int64)
    if len(lone):
        here = np.array(at)[lone]
        low, high = np.maximum(here - 1, 0), np.minimum(here, len(y) - 1)
        place[start[lone]] = np.where(closeness(value[lone], y[high]) >= closeness(value[lone], y[low]), high, low)
    for first, last, n in parts:
        if n == 1:
            continue
        lo, hi = max(at[first] - n, 0), min(at[last] + n, len(y))
        other, begin, room = np.unique(y[lo:hi], return_index=True, return_counts=True)
        score = closeness(value[first : last + 1, None], other)
        if first == last:
            order = np.argsort(-score[0], kind="stable")
            units = np.zeros(score.shape, np.int64)
            units[0, order] = np.diff(np.minimum(np.cumsum(room[order]), n), prepend=0)
        else:
            units = _ship(score, many[first : last + 1], room)
        own, col = np.nonzero(units)
        col = np.repeat(col, units[own, col])
        turn = np.argsort(col, kind="stable")
        of = np.empty(len(col), np.int64)
        of[turn] = np.arange(len(col)) - np.searchsorted(col[turn], col[turn], "left")
        place[start[first] : start[first] + n] = lo + begin[col] + of
    return place, closeness(x, y[place])


def assign_numbers(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of ``assign`` and their scores where the score is the closeness of two numbers; no matrix of all is made.

    What is null, NaN or infinite scores 0 with everything.
    """
    if np.isfinite(x).sum() > np.isfinite(y).sum():
        return tuple(assign_numbers(y, x)[k] for k in (1, 0, 2))
    own, other = (np.flatnonzero(np.isfinite(v))[np.argsort(v[np.isfinite(v)], kind="stable")] for v in (x, y))
    place, score = _nearest(x[own], y[other])
    i, j = own, other[place]
    # the rest scores nothing, whoever takes whom
    free = [np.setdiff1d(np.arange(len(v)), k) for v, k in ((x, i), (y, j))]
    n = min(map(len, free))
    return np.append(i, free[0][:n]), np.append(j, free[1][:n]), np.append(score, np.zeros(n))


def number_assignment(sides: DataFrame, group: str) -> DataFrame:
    """Optimal pairs of each row of ``sides(group, left, right)`` by closeness; sides are arrays of (id, value).

    Of rows that share an id the best score counts; a group where that happens is solved by all its pairs.
    """
    kind = sides.schema[group].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                each = []
                for c in (1, 2):
                    v = b.column(c)[k].values
                    each += [v.field(0).to_numpy(zero_copy_only=False), v.field(1).to_numpy(zero_copy_only=False).astype(float)]
                gts, x, preds, y = each
                left, right = np.unique(gts, return_inverse=True), np.unique(preds, return_inverse=True)
                if len(left[0]) == len(gts) and len(right[0]) == len(preds):
                    i, j, score = assign_numbers(x, y)
                    gts, preds = gts[i], preds[j]
                else:
                    m = np.zeros((len(left[0]), len(right[0])))
                    for r in range(len(x)):
                        with np.errstate(invalid="ignore"):
                            np.maximum.at(m[left[1][r]], right[1], np.where(np.isfinite(y) & np.isfinite(x[r]), closeness(x[r], y), 0.0))
                    got = np.array(assign(m), np.int64).reshape(-1, 2)
                    gts, preds, score = left[0][got[:, 0]], right[0][got[:, 1]], m[got[:, 0], got[:, 1]]
                who = b.column(0).take(pa.array(np.full(len(score), k)))
                yield pa.RecordBatch.from_arrays([who, pa.array(gts, pa.int64()), pa.array(preds, pa.int64()), pa.array(score, pa.float64())], [group, "gt", "pred", "score"])

    return sides.select(group, "left", "right").mapInArrow(run, f"{group} {kind}, gt long, pred long, score double")


def places(df: DataFrame, setting: str, value: str) -> DataFrame:
    """(setting, value, place): the rank of each distinct value of a setting, equal values sharing the lowest.

    Rows are counted per distinct value first, so what is ordered is values, not rows.
    """
    n = df.groupBy(setting, value).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(setting).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    return n.select(setting, value, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).alias("place"))


def runner_up(pairs: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The best other score of each reference row, and the margin to it."""
    own = chosen.select(*keys, F.col("pred").alias("own"), F.col("score").alias("own_score"))
    other = pairs.join(own, keys).where(F.col("pred") != F.col("own")).groupBy(*keys, "own", "own_score").agg(F.max(F.struct("score", -F.col("pred"))).alias("b"))
    return other.select(*keys, F.col("own").alias("pred"), F.col("own_score").alias("score"), F.col("b.score").alias("next_score"), (F.col("own_score") - F.col("b.score")).alias("margin"))


def counts(chosen: DataFrame, n_gt: Column, n_pred: Column, threshold: float) -> list[Column]:
    """tp, fp, fn, precision ceiling of accepted pairs (L3)."""
    tp = F.count_if(F.col("score") >= threshold)
    return [tp.alias("tp"), (F.first(n_pred) - tp).alias("fp"), (F.first(n_gt) - tp).alias("fn"), (F.least(F.first(n_gt), F.first(n_pred)) / F.nullif(F.first(n_pred), F.lit(0))).alias("ceiling")]


def f1(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1 with zero where there is nothing to divide by."""
    p = F.when(tp + fp == 0, 0.0).otherwise(tp / F.nullif(tp + fp, F.lit(0)))
    r = F.when(tp + fn == 0, 0.0).otherwise(tp / F.nullif(tp + fn, F.lit(0)))
    f = F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)))
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double precision; 0 where one has no length (L1)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """``df(id, vector)`` as rows of many vectors: ids, sizes (-1: null, or with a null component), flat."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                sound = [v.is_valid and not v.values.null_count for v in b.column(1)] if b.column(1).flatten().null_count or b.column(1).null_count else None
                flat = b.column(1) if sound is None else b.column(1).filter(pa.array(sound))
                size = np.full(b.num_rows, -1, np.int32)
                size[slice(None) if sound is None else np.array(sound, bool)] = np.diff(flat.offsets.to_numpy())
                flat = flat.flatten()
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(b.column(0)), one(pa.array(size)), one(flat)], ["ids", "sizes", "flat"])

    return df.mapInArrow(run, "ids array<long>, sizes array<int>, flat array<double>")


def cosines(queries: DataFrame, items: DataFrame, best: int | None = None) -> DataFrame:
    """(query, item, score) of all pairs of ``queries(id, vector)`` and ``items(id, vector)``, the score as by ``cosine``.

    Vectors meet as blocks, and products are summed in the order of the components, so equal
    vectors have equal scores.  With ``best``, of each pair of blocks only pairs that may be among
    a query's ``best`` are returned.
    """
    cast = lambda df: df.select(F.col(df.columns[0]).cast("long"), F.col(df.columns[1]).cast("array<double>"))

    def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
        for k in range(x.shape[-1]):
            out += x[..., k] * y[..., k]
        return out

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                get = lambda c: b.column(c)[row].values.to_numpy(zero_copy_only=False)  # noqa: E731,B023
                q, i, nq, ni = get("q_ids"), get("ids"), get("q_sizes"), get("sizes")
                score, known = np.zeros((len(q), len(i))), np.zeros((len(q), len(i)), bool)
                for n in np.intersect1d(nq, ni):
                    if n < 0:
                        continue
                    side = lambda size, flat: flat[(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0))[size == n][:, None] + np.arange(n)]  # noqa: E731,B023
                    x, y = side(nq, get("q_flat")), side(ni, get("flat"))
                    with np.errstate(all="ignore"):
                        length = np.sqrt(dots(x, x)[:, None] * dots(y, y))
                        score[np.ix_(nq == n, ni == n)] = np.where(length == 0, 0.0, dots(x[:, None, :], y[None, :, :]) / length)
                    known[np.ix_(nq == n, ni == n)] = True
                # a sound side of length zero gives 0, whatever the size of the other sound side
                of = lambda size, flat: np.array([dots(v, v) if n >= 0 else np.nan for n, v in zip(size, np.split(flat, np.cumsum(np.maximum(size, 0))[:-1]))])
                with np.errstate(all="ignore"):
                    none = of(nq, get("q_flat"))[:, None] * of(ni, get("flat")) == 0
                score[none], known[none] = 0.0, True
                at = np.arange(len(q))[:, None], np.arange(len(i))[None, :]
                if best is not None and len(i) > best:
                    # nulls are last, NaN is above all numbers, as in Spark's order
                    rank = np.where(known, np.where(np.isnan(score), -np.inf, -score), np.inf)
                    order = [np.lexsort((i, ~np.isnan(s) & k, r)) for s, k, r in zip(score, known, rank)]
                    at = at[0], np.stack(order)[:, :best]
                who, which = np.broadcast_arrays(*at)
                out = pa.array(score[who, which].ravel(), mask=~known[who, which].ravel(), from_pandas=False)
                yield pa.RecordBatch.from_arrays([pa.array(q[who].ravel()), pa.array(i[which].ravel()), out], ["query", "item", "score"])

    left = _packed(cast(queries), 128).toDF("q_ids", "q_sizes", "q_flat")
    both = _packed(cast(items), 2048).crossJoin(small(left, SMALL_BLOCKS))
    return both.mapInArrow(run, "query long, item long, score double")


def _packed_tokens(df: DataFrame, rows: int) -> DataFrame:
    """``df(id, tokens)`` as rows of many: ids, sizes (-1: null), tokens one after the other."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                size = b.column(1).value_lengths().fill_null(-1)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(b.column(0)), one(size), one(b.column(1).flatten())], ["ids", "sizes", "flat"])

    return df.select(F.col(df.columns[0]).cast("long"), F.col(df.columns[1])).mapInArrow(run, "ids array<long>, sizes array<int>, flat array<string>")


def jaccards(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query, item, score) of all pairs of ``queries(id, tokens)`` and ``items(id, tokens)``, the score as by ``text.jaccard``.

    Tokens are distinct in each row.  Both sides meet as blocks: what a pair shares is the product
    of two 0/1 matrices over the words of the block of queries, so a word is looked up once for
    an item, not once for each pair.
    """

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                get = lambda c: b.column(c)[row].values  # noqa: E731,B023
                q, i = get("q_ids"), get("ids")
                nq, ni = get("q_sizes").to_numpy(), get("sizes").to_numpy()
                # a word's number, those of the queries first
                words = get("q_flat").dictionary_encode()
                col, own = words.indices.to_numpy(), np.repeat(np.arange(len(q)), np.maximum(nq, 0))
                at = pc.index_in(get("flat"), value_set=words.dictionary).fill_null(-1).to_numpy()
                who = np.repeat(np.arange(len(i)), np.maximum(ni, 0))
                hit = np.flatnonzero(at >= 0)
                shared = np.zeros((len(i), len(q)), np.float32)  # counts stay below 2 ** 24
                order = hit[np.argsort(at[hit], kind="stable")]
                for lo in range(0, len(words.dictionary), 2048):
                    side = np.zeros((2048, len(q)), np.float32)
                    mine = (col >= lo) & (col < lo + 2048)
                    side[col[mine] - lo, own[mine]] = 1
                    first, last = np.searchsorted(at[order], (lo, lo + 2048))
                    part = order[first:last]
                    if len(part):
                        base = np.zeros((len(i), 2048), np.float32)
                        base[who[part], at[part] - lo] = 1
                        shared += base @ side
                both = np.maximum(ni, 0)[:, None] + np.maximum(nq, 0) - shared.astype(np.float64)
                with np.errstate(invalid="ignore"):
                    score = np.where(both == 0, 0.0, shared / both)
                none = (ni < 0)[:, None] | (nq < 0)
                for k in range(0, len(i), 64):  # rows that go out at once
                    some = pa.array(score[k : k + 64].ravel(), mask=none[k : k + 64].ravel() if none.any() else None)
                    n = len(i[k : k + 64])
                    yield pa.RecordBatch.from_arrays([i.slice(k, n).take(pa.array(np.repeat(np.arange(n), len(q)))), q.take(pa.array(np.tile(np.arange(len(q)), n))), some], ["item", "query", "score"])

    left = _packed_tokens(queries, 1024).toDF("q_ids", "q_sizes", "q_flat")
    both = _packed_tokens(items, 512).crossJoin(small(left, SMALL_BLOCKS))
    return both.mapInArrow(run, "item long, query long, score double").select("query", "item", "score")


def hashed_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, weight): how often a text's words fall into each of 256 buckets, scaled to length one (L1).

    Stands in for a sentence encoder: sparse rows instead of vectors.  Equal texts are encoded once.
    """
    texts = df.select(F.xxhash64(text).alias("_t"), F.col(text).alias("_s")).dropDuplicates(["_t"])
    words = texts.select("_t", F.explode(F.regexp_extract_all(F.lower("_s"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    n = words.groupBy("_t", F.substring(F.md5("w"), 1, 2).alias("bucket")).agg(F.count("*").alias("n"))
    size = n.groupBy("_t").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    unit = n.join(size, "_t").select("_t", "bucket", (F.col("n") / F.col("size")).alias("weight"))
    return df.select(F.col(key).alias("key"), F.xxhash64(text).alias("_t")).join(unit, "_t").select("key", "bucket", "weight")


def sparse_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, score) of all keys that share a bucket, cosine within 0 and 1 (L1)."""
    both = a.toDF("a", "bucket", "x").join(b.toDF("b", "bucket", "y"), "bucket")
    dot = F.sum(F.col("x") * F.col("y"))
    return both.groupBy("a", "b").agg(F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0)).alias("score"))


def top_k(queries: DataFrame, items: DataFrame, k: int, score: Column, query_id: str, item_id: str) -> DataFrame:
    """The k best items of each query; a small set of queries is broadcast."""
    both = items.join(small(queries)).withColumn("score", score)
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), item_id)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, item_id, "score", "rank")


def medoids(pairs: DataFrame, group: str, a: str, score: str) -> DataFrame:
    """The candidate that agrees most with the others of its group."""
    total = pairs.groupBy(group, a).agg(F.sum(score).alias("total"))
    return total.groupBy(group).agg(F.max(F.struct("total", (-F.col(a)).alias("k"))).alias("b")).select(group, (-F.col("b.k")).alias("medoid"), F.col("b.total").alias("total"))


def greedy_clusters(pairs: DataFrame, group: str, threshold: float) -> DataFrame:
    """Pairs by falling score make or grow clusters; clusters never join; those of one run go.

    ``pairs``: group, a, b, run_a, run_b, score.
    """
    kind = pairs.schema[group].dataType.simpleString()

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        of, runs = {}, {}
        f = f[(f["score"] >= threshold) & (f["run_a"] != f["run_b"])].sort_values(["score", "a", "b"], ascending=[False, True, True])
        for a, b, ra, rb in f[["a", "b", "run_a", "run_b"]].itertuples(index=False):
            ca, cb = of.get(a), of.get(b)
            if ca is None and cb is None:
                of[a] = of[b] = a
                runs[a] = {ra, rb}
            elif ca is None or cb is None:
                c = cb if ca is None else ca
                of[a] = of[b] = c
                runs[c] |= {ra, rb}
        keep = [(x, c) for x, c in of.items() if len(runs[c]) > 1]
        return pd.DataFrame({group: [f[group].iloc[0]] * len(keep) if len(f) else [], "member": [x for x, _ in keep], "cluster": [c for _, c in keep]})

    return pairs.groupBy(group).applyInPandas(solve, f"{group} {kind}, member long, cluster long")


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Jaro similarity raised by a common prefix of up to four characters."""
    if not a or not b:
        return float(bool(a == b and a is not None))
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winklers(names: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``jaro_winkler`` of the pairs (one[k], two[k]) of ``names``, by UTF-8 bytes as DuckDB counts; an empty name is like none.

    Names of up to 64 bytes are matched as bits, all pairs at once; a longer one by itself.
    """
    raw = [x.encode() for x in names]
    size = np.array([len(x) for x in raw], np.int64)
    out = np.zeros(len(one))
    text = np.zeros((len(raw), 64), np.uint8)
    seen = np.zeros((len(raw), 256), np.uint64)  # the places of each byte
    for k, x in enumerate(raw):
        if len(x) <= 64:
            text[k, : len(x)] = np.frombuffer(x, np.uint8)
            np.bitwise_or.at(seen[k], text[k, : len(x)], np.uint64(1) << np.arange(len(x), dtype=np.uint64))
    short = (size[one] <= 64) & (size[two] <= 64)
    for k in np.flatnonzero(~short & (size[one] > 0) & (size[two] > 0)).tolist():
        out[k] = jaro_winkler(raw[one[k]].decode("latin-1"), raw[two[k]].decode("latin-1"))
    short = np.flatnonzero(short & (size[one] > 0) & (size[two] > 0))
    for at in range(0, len(short), 20_000):
        own = short[at : at + 20_000]
        a, b = one[own], two[own]
        la, lb = size[a], size[b]
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        taken, hits, none, bit = np.zeros(len(own), np.uint64), np.zeros((64, len(own)), bool), np.uint64(0), np.uint64(1)
        full = ~none
        for i in range(int(la.max())):
            low, high = np.maximum(i - reach, 0), np.minimum(i + reach, 63)
            window = (full << np.minimum(low, 63).astype(np.uint64)) & (full >> (63 - high).astype(np.uint64))
            free = seen[b, text[a, i]] & window & ~taken
            free = np.where((i < la) & (low < 64), free, none)
            hits[i] = free != 0
            taken |= free & (~free + bit)
        m, swaps, rest = hits.sum(axis=0), np.zeros(len(own), np.int64), taken
        for i in range(int(la.max())):
            first = rest & (~rest + bit)
            swaps += hits[i] & ((seen[b, text[a, i]] & first) == 0)
            rest = np.where(hits[i], rest ^ first, rest)
        jaro = np.where(m > 0, (m / la + m / lb + (m - swaps // 2) / np.maximum(m, 1)) / 3, 0.0)
        same = (text[a, :4] == text[b, :4]) & (np.arange(4) < np.minimum(la, lb)[:, None])
        prefix = np.cumprod(same, axis=1).sum(axis=1)
        out[own] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return out


def similar_names(rows: DataFrame, group: list[str], key: str, name: str, least: float) -> DataFrame:
    """(a, b, s) of all pairs of rows of a group with keys a < b and names more alike than ``least``.

    Rows of a group meet in Python as blocks of about ``BLOCK_OF_NAMES``, dealt by key; names are
    compared once for a pair of blocks, however many rows have them.
    """
    named = rows.where(" and ".join(f"`{c}` is not null" for c in [*group, key, name]))
    p = F.ceil(F.col("_n") / BLOCK_OF_NAMES).cast("int")
    sizes = named.groupBy(*group).agg(F.count("*").alias("_n"))
    dealt = named.join(sizes, group).select(*group, F.col(key).cast("long").alias("key"), F.col(name).alias("name"), p.alias("p"), F.pmod(F.xxhash64(key), p).cast("int").alias("block"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    i, j = F.least("block", "with"), F.greatest("block", "with")
    dealt = dealt.select(*group, i.alias("i"), j.alias("j"), (F.col("block") != i).alias("second"), "key", "name")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                v = batch.column(0)[r].values
                second, keys = v.field("second").to_numpy(zero_copy_only=False), v.field("key").to_numpy()
                alone = batch.column(1)[r].as_py()
                words = v.field("name").dictionary_encode()
                names, of = words.dictionary.to_pylist(), words.indices.to_numpy()
                turn = np.argsort(of, kind="stable")
                sides = [turn, turn] if alone else [turn[~second[turn]], turn[second[turn]]]
                # where each name's rows are on either side
                span = [(np.searchsorted(of[t], np.arange(len(names)), "left"), np.searchsorted(of[t], np.arange(len(names)), "right")) for t in sides]
                x, y = (g.ravel() for g in np.meshgrid(*[np.flatnonzero(hi > lo) for lo, hi in span], indexing="ij"))
                if alone:
                    x, y = x[x <= y], y[x <= y]
                s = jaro_winklers(names, x, y)
                x, y, s = x[s > least], y[s > least], s[s > least]
                (first, last), (begin, end) = span
                wide = end[y] - begin[y]
                many = (last[x] - first[x]) * wide
                cut = 0
                while cut < len(x):
                    # as many pairs of names as make about 2 ** 19 rows, one at least
                    till = max(int(np.searchsorted(np.cumsum(many[cut:]), 1 << 19, "right")), 1) + cut
                    at = np.repeat(np.arange(cut, till), many[cut:till])
                    turn = np.arange(len(at)) - np.repeat(np.cumsum(many[cut:till]) - many[cut:till], many[cut:till])
                    one, two = keys[sides[0][first[x[at]] + turn // wide[at]]], keys[sides[1][begin[y[at]] + turn % wide[at]]]
                    # rows of one name meet in both orders
                    ok = (one < two) | ((one > two) & ~((x == y)[at] & alone))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)[ok]), pa.array(np.maximum(one, two)[ok]), pa.array(s[at][ok])], ["a", "b", "s"])
                    cut = till

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = dealt.repartition(parts, *group, "i", "j").groupBy(*group, "i", "j").agg(F.collect_list(F.struct("second", "key", "name")).alias("rows"))
    return packed.select("rows", (F.col("i") == F.col("j")).alias("alone")).mapInArrow(run, "a long, b long, s double")


@F.pandas_udf(DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in the longest common blocks, found recursively."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])
