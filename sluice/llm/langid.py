"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.  A word's
probability under a language is the sum over all ways to cut it into pieces, by a forward pass;
a text's is the product over its words.  Piece probabilities are fitted by expectation
maximisation: the expected use of each piece over all segmentations of the training words.

Words are maximal runs of letters in lower case behind the vocabulary's word mark.  The forward
pass keeps the sums of as many positions as the longest piece has letters, and goes over a word
in blocks of ``BLOCK`` letters; so a word of any length is one lattice in bounded memory.

Defined results: null text or text without a letter is ``und`` with score 0; so is every text
when there is nothing to learn from.  Very long texts and words count whole; only in fitting are
words cut after ``BLOCK`` letters.  Ties: equal scores go to the language first in order.  A row
with null ``lang`` is predicted but not learnt from.  Repeated rows give repeated rows; an empty
table gives an empty result; other columns pass through ``predict`` with ``keep`` and through
``stage`` untouched, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters of a word, and sums (of positions, words and languages), in work at once.
BLOCK, SUMS = 4096, 1 << 21
#: Positions after which small sums are scaled up.
SCALED, SMALL = 8, 1e-100
#: Probability of a letter outside the vocabulary, in every language.
UNKNOWN = 1e-7
#: The classifier is fitted on at most about so many rows of each language, taken by a hash of the id.
TRAIN_ROWS = 400
ROUNDS, SMOOTHING = 3, 0.02

BASE, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
NO_LETTER = r"[^\p{L}]+"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[str]:
    """Pieces of letters, in lower case, with or without the word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(k).lower() for k in range(sp.get_piece_size())}
    return sorted(p for p in found if p.lstrip("▁").isalpha() and "▁" not in p[1:])


class Lattice:
    """Finds the vocabulary's pieces in many words at once, through a table of hashed prefixes."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        known: dict[int, int] = {}
        for p in sorted(pieces, key=len):
            for k in range(1, len(p)):
                known.setdefault(self._hash(p[:k]), -1)
        for k, p in enumerate(pieces):
            known[self._hash(p)] = k
        keys = np.array(list(known), np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(known.values()), np.int32)[order]
        self.bits = max(1, int(np.ceil(np.log2(max(len(keys), 2)))))
        self.first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = ((h ^ ord(c)) * int(BASE) + int(FINAL)) & (1 << 64) - 1
            h ^= h >> 29
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a mere prefix, -2 for neither."""
        if not len(self.keys):
            return np.full(len(h), -2, np.int32)
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(h), -2, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            todo = todo[at[todo] < len(self.keys)]
            key = self.keys[at[todo]]
            same = key == h[todo]
            out[todo[same]] = self.ids[at[todo[same]]]
            todo = todo[key < h[todo]]
            at[todo] += 1
        return out

    def matches(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every piece in every part of a word: part, where it ends there, its length, the piece.

        Sorted by end, then part.  A letter outside the vocabulary is the piece ``self.n``.
        """
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(parts)), size)
        start = (np.cumsum(size) - size)[owner]
        stop = start + size[owner]
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        ends, lengths, pieces = [], [], []
        for n in range(1, self.longest + 1):
            live = at + n <= stop[at]
            at, h = at[live], h[live]
            if not len(at):
                break
            h = (h ^ chars[at + n - 1]) * BASE + FINAL
            h ^= h >> np.uint64(29)
            got = self.find(h)
            hit = got >= 0 if n > 1 else np.ones(len(at), bool)
            ends.append(at[hit] + n)
            lengths.append(np.full(int(hit.sum()), n))
            pieces.append(np.where(got[hit] < 0, self.n, got[hit]))
            at, h = at[got > -2], h[got > -2]
        if not ends:
            return (np.zeros(0, np.int64),) * 4
        end, length, piece = (np.concatenate(x).astype(np.int64) for x in (ends, lengths, pieces))
        part = owner[end - 1]
        end -= start[end - 1]
        order = np.argsort(end * len(parts) + part, kind="stable")
        return part[order], end[order], length[order], piece[order]

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log probability of each word under each language: all segmentations summed."""
        out = np.zeros((len(words), prob.shape[1]))
        step = max(1, min(20_000, SUMS // ((self.longest + 1) * max(1, prob.shape[1]))))
        for k in range(0, len(words), step):
            out[k : k + step] = self._forward(words[k : k + step], prob)
        return out

    def _forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        ring, back = self.longest + 1, self.longest
        size = np.fromiter(map(len, words), np.int64, len(words))
        sums = np.zeros((ring, len(words), prob.shape[1]))
        sums[0] = 1.0
        out, scale = np.zeros((len(words), prob.shape[1])), np.zeros((len(words), prob.shape[1]))
        for base in range(0, int(size.max(initial=0)), BLOCK):
            who = np.flatnonzero(size > base)
            since = max(0, base - back)
            part, end, length, piece = self.matches([words[w][since : base + BLOCK] for w in who])
            end = end + since
            cuts = np.searchsorted(end, np.arange(base + 1, min(int(size.max()), base + BLOCK) + 2))
            for e, lo, hi in zip(range(base + 1, base + len(cuts)), cuts[:-1].tolist(), cuts[1:].tolist()):
                w = who[part[lo:hi]]
                x = sums[(e - length[lo:hi]) % ring, w] * prob[piece[lo:hi]]
                at = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                w = w[at]
                sums[e % ring, w] = np.add.reduceat(x, at, axis=0)
                over = w[size[w] == e]
                out[over] = np.log(np.maximum(sums[e % ring, over], 1e-300)) + scale[over]
                if e % SCALED == 0 and len(over) < len(w):
                    w = w[size[w] > e]
                    low = sums[:, w].max(axis=0) < SMALL
                    if low.any():
                        up = np.where(low, 1 / SMALL, 1.0)
                        sums[:, w] *= up
                        scale[w] -= np.log(up)
        return out

    def expected(self, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of weighted words of one language."""
        out = np.zeros(self.n + 1)
        for k in range(0, len(words), 4096):
            out += self._expected(words[k : k + 4096], weight[k : k + 4096], np.log(prob))
        return out

    def _expected(self, words: list[str], weight: np.ndarray, log: np.ndarray) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        zero = np.cumsum(size + 1) - size - 1
        part, end, length, piece = self.matches(words)
        ahead, back = np.zeros(int((size + 1).sum())), np.zeros(int((size + 1).sum()))
        to, source, p = zero[part] + end, zero[part] + end - length, log[piece]

        def sweep(table, order, key, into, out_of):
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                some = order[lo:hi]
                x, goal = table[out_of[some]] + p[some], into[some]
                at = np.flatnonzero(np.append(True, goal[1:] != goal[:-1]))
                most = np.maximum.reduceat(x, at)
                count = np.diff(np.append(at, len(x)))
                table[goal[at]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, count)), at))

        if not len(part):
            return np.zeros(self.n + 1)
        sweep(ahead, np.arange(len(part)), end, to, source)
        left = size[part] - end + length  # letters from the piece's start to the word's end
        order = np.lexsort((part, left))
        sweep(back, order, left[order], source, to)
        uses = np.exp(ahead[source] + p + back[to] - back[zero[part]]) * weight[part]
        return np.bincount(piece, uses, self.n + 1)


def blocks(word: str) -> list[str]:
    """A word behind its mark, in blocks."""
    return [("▁" + word)[k : k + BLOCK] for k in range(0, len(word) + 1, BLOCK)]


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, path: str | None = None, rows: int = TRAIN_ROWS) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and their probabilities, from rows that aren't held out and have a label.

    Words are counted on the executors and the expected uses are summed there; the driver sees
    one number for each language and piece.
    """
    learnt = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    learnt = learnt.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    per = learnt.groupBy("lang").agg(F.count("*").alias("__n"))
    spot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("train")), F.lit(1 << 20)) / float(1 << 20)
    words = (
        learnt.join(per, "lang").where(spot < F.lit(rows) / F.col("__n"))
        .select("lang", F.explode(F.split(F.lower("text"), NO_LETTER)).alias("word")).where("word <> ''")
        .groupBy("lang", "word").agg(F.count("*").alias("n"))
    )
    ws = common.Workspace(docs.sparkSession, "langid")
    words = ws.save(words, "words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    pieces = vocabulary(path or vocabulary_path())
    if not langs:
        return [], pieces, np.zeros((len(pieces) + 1, 0))
    prob = np.full((len(pieces) + 1, len(langs)), 1.0 / max(1, len(pieces)))
    prob[-1] = UNKNOWN
    for _ in range(ROUNDS):
        uses = np.zeros((len(pieces) + 1, len(langs)))
        got = _uses(words, langs, pieces, prob).groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses[got.column("piece").to_numpy(), got.column("lang").to_numpy()] = got.column("uses").to_numpy()
        uses = uses[:-1] + SMOOTHING
        prob = np.vstack([uses / uses.sum(axis=0), np.full(len(langs), UNKNOWN)])
    ws.drop(words)
    return langs, pieces, prob


def _uses(words: DataFrame, langs: list[str], pieces: list[str], prob: np.ndarray) -> DataFrame:
    def run(frames):
        lattice = Lattice(pieces)
        for f in frames:
            for lang, own in f.groupby("lang"):
                k = bisect.bisect_left(langs, lang)
                cut = [(s, n) for w, n in zip(own["word"], own["n"]) for s in blocks(w)]
                uses = lattice.expected([s for s, _ in cut], np.array([n for _, n in cut], float), np.ascontiguousarray(prob[:, k]))
                at = np.flatnonzero(uses)
                yield type(f)({"lang": np.full(len(at), k, np.int32), "piece": at.astype(np.int32), "uses": uses[at]})

    return words.mapInPandas(run, "lang int, piece int, uses double")


def prediction(model: tuple[list[str], list[str], np.ndarray], text: str = "text") -> F.Column:
    """A struct of lang_pred, score and fit (mean log probability of a letter) from a text alone.

    Only the texts go to Python.  Words are looked up once a batch.
    """
    langs, pieces, prob = model

    @F.arrow_udf("lang_pred string, score double, fit double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice = Lattice(pieces)
        for texts in batches:
            got = [score(lattice, prob, langs, texts.slice(k, 512)) for k in range(0, len(texts), 512)]
            cols = [pa.concat_arrays([g[j] for g in got]) for j in range(3)] if got else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.float64())]
            yield pa.StructArray.from_arrays(cols, ["lang_pred", "score", "fit"])
            common.release()

    return run(F.col(text).cast("string"))


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], keep: bool = False) -> DataFrame:
    """Per row doc_id, lang_pred, score, fit.  With ``keep`` all columns, and a struct ``langid`` of the three.

    Should the docs have a column ``langid``, the struct's name gets underscores until it is new.
    """
    if not keep:
        return docs.select("doc_id", prediction(model).alias("__p")).select("doc_id", "__p.*")
    return docs.withColumn(common.fresh(docs, "langid"), prediction(model))


def score(lattice: Lattice, prob: np.ndarray, langs: list[str], texts: pa.Array) -> list[pa.Array]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), NO_LETTER)
    row = np.repeat(np.arange(n), np.diff(parts.offsets.to_numpy()))
    flat = parts.flatten().dictionary_encode()
    words, code = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.bincount(row, size[code], n) if len(code) else np.zeros(n)
    if not langs or not len(words):
        return [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n))]
    logs = np.zeros((len(words), len(langs)))
    some = np.flatnonzero(size)
    logs[some] = lattice.forward(["▁" + words[j] for j in some], prob)
    total = np.stack([np.bincount(row, logs[code, k], n) for k in range(len(langs))], axis=1)
    best = total.argmax(axis=1)
    top = total[np.arange(n), best]
    sure = 1 / np.exp(total - top[:, None]).sum(axis=1)
    none = letters == 0
    name = np.array([*langs, "und"], object)[np.where(none, len(langs), best)]
    return [pa.array(name, pa.string()), pa.array(np.where(none, 0.0, sure)), pa.array(np.where(none, 0.0, top / np.maximum(letters, 1)))]


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a recognised language; texts without any letter go."""
    name = common.fresh(docs, "langid")
    return docs.withColumn(name, prediction(fit(docs))).where(F.col(name)["lang_pred"] != "und").select(*[F.col(f"`{c}`") for c in docs.columns])
