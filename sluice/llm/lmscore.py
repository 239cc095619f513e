"""Cross-entropy difference: a target and a background n-gram model over one vocabulary.

The target is the documents labelled as good, the background all documents.  Both models are
bigrams interpolated with unigrams, with the same smoothing, over the same vocabulary: the
``VOCABULARY`` most frequent words of all documents, and one unknown word.  A document's score
is the mean, over its tokens, of the loss under the target less the loss under the background:
the lower, the more like the target.

Counts cover every document and add up before they shuffle.  Words are counted exactly; counts
of bigrams share ``CELLS`` cells by hash, so a model's size is fixed and it may be broadcast,
while what is gathered grows with the input.

Defined results: no words: 0 tokens, losses and score 0.  Rows share a label by doc_id; an id
with several labels counts as good if one says so.  Without good documents both models are the
same smoothed one on the target's side, and scores still come out.  Null doc_id has no label.
Very long texts count whole.  Ties: of equally frequent words at the vocabulary's border those of
the lesser hash belong to it.
Repeated rows count and are returned as often as they stand.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

VOCABULARY, CELLS = 1 << 16, 1 << 20
#: Weight of the bigram, and the counts added to each unigram.
MIX, ADDED = 0.6, 0.5
BROADCAST_LABELS = 1_000_000


def _marked(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, text, good; the ids of good documents are broadcast if they are few."""
    good = good.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("good")).where("doc_id is not null").distinct()
    few = good.count() <= BROADCAST_LABELS
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(F.broadcast(good) if few else good, "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Small batches with the hashes of their words and the row of each word."""
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            b = whole.slice(k, 256)
            words = [w for _, w in shingles.word_hashes(b.column("text"))]
            yield b, np.concatenate([*words, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(words)), [len(w) for w in words])


def _word_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b, words, row in _slices(batches):
            good = b.column("good").to_numpy(zero_copy_only=False)
            kinds, code = np.unique(words, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.view(np.int64)), pa.array(np.bincount(code, minlength=len(kinds))), pa.array(np.bincount(code, good[row], len(kinds)).astype(np.int64))], ["word", "n", "n_good"]
            )

    return docs.mapInArrow(run, "word long, n long, n_good long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_good").alias("n_good"))


def _ids(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place in the vocabulary; its length for the unknown word."""
    if not len(vocabulary):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, len(vocabulary))


def _cells(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a token has one before it in its document, and the cell of the two."""
    at = np.flatnonzero(row[1:] == row[:-1]) + 1 if len(ids) > 1 else np.zeros(0, np.int64)
    return at, (shingles.mix(ids[at - 1].astype(np.uint64) << np.uint64(32) | ids[at].astype(np.uint64)) % np.uint64(CELLS)).astype(np.int64)


def _cell_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    def run(batches):
        n, n_good = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for b, words, row in _slices(batches):
            good = b.column("good").to_numpy(zero_copy_only=False)
            at, cell = _cells(_ids(words, vocabulary), row)
            kinds, code = np.unique(cell, return_inverse=True)
            n[kinds] += np.bincount(code, minlength=len(kinds))
            n_good[kinds] += np.bincount(code, good[row[at]], len(kinds)).astype(np.int64)
        some = np.flatnonzero(n)
        for k in range(0, len(some), 1 << 16):
            s = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n[s]), pa.array(n_good[s])], ["cell", "n", "n_good"])

    return docs.mapInArrow(run, "cell long, n long, n_good long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("n_good").alias("n_good"))


class Models:
    """Unigram counts over the vocabulary and its unknown word, bigram counts by cell; column 0 background, 1 target."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, cells: np.ndarray):
        self.vocabulary = vocabulary
        self.unigram = (words + ADDED) / (words + ADDED).sum(axis=0)
        self.words, self.cells = words.astype(np.float32), cells.astype(np.float32)

    def losses(self, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Loss of each token under background and target."""
        ids = _ids(words, self.vocabulary)
        p = self.unigram[ids]
        at, cell = _cells(ids, row)
        context = np.maximum(self.words[ids[at - 1]], 1e-9)
        p[at] = MIX * np.minimum(self.cells[cell] / context, 1.0) + (1 - MIX) * p[at]
        return -np.log(p)


def fit(marked: DataFrame) -> Models:
    counts = _word_counts(marked)
    ws = common.Workspace(marked.sparkSession, "lm")
    counts = ws.save(counts, "words")
    total = counts.agg(F.sum("n").alias("n"), F.sum("n_good").alias("g")).first()
    # as Arrow: a row object for each would take the driver's memory many times over
    column = lambda t, name: t.column(name).to_numpy()
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    hashes = column(top, "word").astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    vocabulary = np.ascontiguousarray(hashes[order])
    words = np.zeros((len(vocabulary) + 1, 2))
    words[:-1] = np.stack([column(top, "n"), column(top, "n_good")], axis=1)[order]
    words[-1] = np.array([total["n"] or 0, total["g"] or 0]) - words[:-1].sum(axis=0)
    got = _cell_counts(marked, vocabulary).toArrow()
    cells = np.zeros((CELLS, 2), np.float32)
    cells[column(got, "cell").astype(np.int64)] = np.stack([column(got, "n"), column(got, "n_good")], axis=1)
    ws.drop(counts)
    return Models(vocabulary, words, cells)


def score(docs: DataFrame, models: Models) -> DataFrame:
    """Per row: doc_id, n_tokens, loss_target, loss_background, score.  Map-only."""

    def run(batches):
        for b, words, row in _slices(batches):
            n = np.bincount(row, minlength=b.num_rows)
            loss = models.losses(words, row)
            mean = [np.bincount(row, loss[:, k], b.num_rows) / np.maximum(n, 1) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(mean[1]), pa.array(mean[0]), pa.array(mean[1] - mean[0])], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def op3_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    good = common.read(spark, sf_dir, "labels").where("quality = 1")
    return score(docs, fit(_marked(docs, good)))
