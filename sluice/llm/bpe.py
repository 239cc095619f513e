"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

``Transducer`` reads a merge list once and computes its sufficient lookahead: how many bytes
beyond the end of a token can still change whether that token stands.  Texts are byte streams
that run through a buffer of ``BUFFER`` bytes.  What is in the buffer is cut into pre-tokens and
merged by passes over whole arrays; a token is emitted once no later byte can change it, that
is, when its pre-token has ended or when the token ends at least the lookahead before the last
byte that is known.  The rest stays in the buffer and the stream goes on behind it, in the midst
of a pre-token if need be.  Every text takes this one way, whatever its length and that of its
words, so memory is bounded by the buffer.  Nothing is remembered from one buffer to the next.

``Decoder`` turns tokens into text with an incremental UTF-8 state machine, a byte run at a time.

Defined results: null text is the empty text: no tokens, empty decoded text.  A very long text,
or a very long word, passes through the buffer piece by piece.  Repeated rows give repeated rows
and an empty table an empty result; there are no ties, as of equal pairs the leftmost merges.
Extra columns pass through ``encode`` and ``decode`` and are left out of ``digests``.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, shingles

#: Fixed values of byte-level BPE: the bytes that stand for themselves in a vocabulary file, and the
#: contractions that are pre-tokens.  The other pre-tokens are runs of letters, of numbers or of other
#: characters, each with a space before it, and white space without the one that goes to the next run.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHORT_FORMS = ["s", "t", "re", "ve", "m", "ll", "d"]
LETTER, NUMBER, OTHER, SPACE = range(4)

#: Bytes of text in work at once.
BUFFER = 1 << 20
#: Characters that the pre-tokenizer must see behind a border.
BEHIND = 3
#: Of the table of ranks.
EMPTY, NONE, MULTIPLIER = np.uint64((1 << 64) - 1), np.int32((1 << 31) - 1), 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(8).integers(0, 1 << 64, 256, np.uint64)


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file, as char -> byte."""
    out = {chr(b): b for b in PRINTABLE}
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary_path() -> str:
    """Default vocabulary; every function here takes another path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _kinds() -> np.ndarray:
    """The kind of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(what, every):
            out[m.start() : m.end()] = kind
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, run after run."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


class Round:
    """What one buffer emits: tokens of adjoining streams, ``first[k]:first[k + 1]`` those of stream ``lo + k``."""

    def __init__(self, lo: int, ids: np.ndarray, first: np.ndarray, ended: bool):
        self.lo, self.ids, self.first, self.ended = lo, ids, first, ended


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, k in vocab.items():
            bytes_of[k] = s.encode() if s.encode() in self.special else raw(s)
        for s, k in self.special.items():
            bytes_of[k] = s
        self.single = np.array([vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])], np.int32)
        rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.size = np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.longest = int(self.size.max())
        self.lookahead = self._lookahead(rank)
        self.least = 4 * (self.lookahead + self.longest + 4 * BEHIND)
        self._table(rank)
        decimals = [b",%d" % k for k in range(len(bytes_of))]
        self.decimal_size = np.fromiter(map(len, decimals), np.int64, len(decimals))
        wide = int(self.decimal_size.max())
        self.decimals = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in decimals), np.uint8).reshape(-1, wide)
        self.specials = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.kinds = _kinds()

    def _lookahead(self, rank: dict) -> int:
        """Sufficient lookahead of the merge list, by one pass in rank order.

        ``need[t]`` is how far beyond its end a span that spells token t must be known to tell
        whether t forms there: as far as its right part needs, or as far as an earlier merge
        (right part, x) that would take the right part away needs, which is all of x and what x
        needs itself.  A formed t stands unless a later merge (t, x) takes it.  Both maxima only
        look at merges of lower rank, so the pass is linear in the list.
        """
        size = self.size.tolist()
        need = [0] * len(size)
        taken = [0] * len(size)  # the farthest that any merge so far with this left part looks
        for (a, b), (_, t) in sorted(rank.items(), key=lambda x: x[1][0]):
            need[t] = max(need[t], need[b], taken[b], max(need[a], taken[a]) - size[b])
            taken[a] = max(taken[a], size[b] + max(need[b], taken[b]))
        return max([1, *need, *taken])

    def _table(self, rank: dict) -> None:
        """Open-addressed table from a pair of ids to its rank, for whole arrays of pairs."""
        n = 1 << (4 * len(rank) - 1).bit_length() if rank else 2
        self.shift, self.slots = np.uint64(64 - n.bit_length() + 1), n
        self.keys, self.ranks = np.full(n, EMPTY, np.uint64), np.full(n, NONE, np.int32)
        self.joins = np.zeros(max((r for r, _ in rank.values()), default=0) + 1, np.int32)
        for (a, b), (r, t) in rank.items():
            self.joins[r] = t
            at = (((a << 32 | b) * MULTIPLIER) & (1 << 64) - 1) >> int(self.shift)
            while self.keys[at] != EMPTY:
                at = (at + 1) % n
            self.keys[at], self.ranks[at] = a << 32 | b, r

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = ((key * np.uint64(MULTIPLIER)) >> self.shift).astype(np.int64)
        out, kept = self.ranks[at], self.keys[at]
        todo = np.flatnonzero((kept != key) & (kept != EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) % self.slots
            kept = self.keys[at[todo]]
            out[todo] = self.ranks[at[todo]]
            todo = todo[(kept != key[todo]) & (kept != EMPTY)]
        out[self.keys[at] != key] = NONE
        return out

    def merged(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of adjoining words: the ids, and how many each word has.

        Every round joins, in each word, its lowest-ranked pair wherever it stands (of
        overlapping ones the leftmost), until no word has a pair of the list.
        """
        count = np.zeros(len(size), np.int64)
        done_ids, done_who = [], []
        who = np.flatnonzero(size)
        size = size[who]
        ids = self.single[data]
        rank = np.full(len(ids), NONE, np.int32)
        if len(ids) > 1:
            rank[:-1] = self._ranks(ids[:-1], ids[1:])
        if len(who):
            rank[np.cumsum(size) - 1] = NONE
        while len(who):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            if (over := least == NONE).any():
                gone = np.repeat(over, size)
                done_ids.append(ids[gone])
                done_who.append(np.repeat(who[over], size[over]))
                count[who[over]] = size[over]
                ids, rank, who, size, least = ids[~gone], rank[~gone], who[~over], size[~over], least[~over]
                if not len(who):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            if len(at) > 1 and (touch := np.diff(at) == 1).any():
                # a run of overlapping pairs, as in "aaaa": every other one counts
                run = np.concatenate(([0], np.cumsum(~touch)))
                at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
            ids[at] = self.joins[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            owner = np.searchsorted(np.cumsum(size) - 1, at)
            size = size - np.bincount(owner, minlength=len(size))
            at = at - np.arange(len(at))  # each join so far has taken one place out
            ids, rank = ids[keep], rank[keep]
            end = np.zeros(len(ids) + 1, bool)
            end[np.cumsum(size) - 1] = end[-1] = True
            after = at[~end[at]]
            rank[at] = NONE
            rank[after] = self._ranks(ids[after], ids[after + 1])
            before = at - 1
            before = before[~end[before]]
            rank[before] = self._ranks(ids[before], ids[before + 1])
        if not done_ids:
            return np.zeros(0, np.int32), count
        order = np.argsort(np.concatenate(done_who), kind="stable")
        return np.concatenate(done_ids)[order], count

    def borders(self, data: np.ndarray, heads: np.ndarray, within: int) -> np.ndarray:
        """Where pre-tokens begin in a buffer of streams that begin at ``heads``.

        ``within`` is the kind of the pre-token in whose midst the first stream goes on, or -1.
        """
        lead = (data & 0xC0) != 0x80
        lead[0] = True
        first = np.flatnonzero(lead)
        b = data[first]
        kind = self.kinds[b]
        if (wide := np.flatnonzero(b >= 0xC0)).size:
            at = first[wide]
            byte = lambda k: (data[np.minimum(at + k, len(data) - 1)] & 0x3F).astype(np.int64)
            x = b[wide].astype(np.int64)
            two = (x & 0x1F) << 6 | byte(1)
            three = (x & 0x0F) << 12 | byte(1) << 6 | byte(2)
            four = (x & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)
            kind[wide] = self.kinds[np.minimum(np.where(x < 0xE0, two, np.where(x < 0xF0, three, four)), 0x10FFFF)]
        if within >= 0:
            kind[0] = within
        n = len(first)
        head = np.zeros(n + 3, bool)
        head[np.searchsorted(first, heads)] = True
        head[n:] = True
        new = head[:n].copy()
        new[1:] |= kind[1:] != kind[:-1]
        # of white space before something else, the last one stands apart; a plain space goes with what follows
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n])
        new[last] = True
        new[last[b[last] == 0x20] + 1] = False
        q = np.flatnonzero((b == 0x27) & new)
        if within >= 0:
            q = q[q > 0]
        if len(q):
            ahead = np.concatenate((b, np.zeros(3, np.uint8)))
            for form in SHORT_FORMS:
                hit = q
                for k, c in enumerate(form.encode(), 1):
                    hit = hit[(ahead[hit + k] == c) & ~head[hit + k]]
                new[hit + 1] = False
                new[(end := hit + 1 + len(form))[end < n]] = True
        return first[new], first, kind

    def _specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """Start, end and id of the special tokens that are spelt out in the texts."""
        if not self.specials:
            return []
        lo = int(offsets[0])
        view, out = memoryview(data)[lo : int(offsets[-1])], []
        for m in self.specials.finditer(view):
            k = int(np.searchsorted(offsets, m.start() + lo, "right"))
            if m.end() + lo <= offsets[k]:
                out.append((m.start() + lo, m.end() + lo, self.special[m[0]]))
        return out

    def rounds(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Round]:
        """Encodes adjoining texts, ``offsets[k]:offsets[k + 1]`` each, a buffer at a time."""
        special = self._specials(data, offsets)
        n, k, at, within = len(offsets) - 1, 0, int(offsets[0]), -1
        while k < n:
            end = min(at + max(BUFFER, self.least), int(offsets[-1]))
            while end < offsets[-1] and (data[end] & 0xC0) == 0x80:
                end -= 1
            here = [x for x in special if at <= x[0] < end]
            cut = bool(here) and here[-1][1] > end  # a special token is a border for what stands before it
            if cut:
                end = here.pop()[0]
            m = int(np.searchsorted(offsets, end, "right")) - 1
            ended = int(offsets[m]) == end
            edges = np.maximum(offsets[k : m + (not ended)], at) - at
            marks = [x - at for s, e, _ in here for x in (s, e) if x < end]
            heads = np.unique(np.concatenate((edges[edges < end - at], marks)).astype(np.int64))
            ids, starts, first, on, kind = self._buffer(data[at:end], heads, within, ended or cut, [(s - at, e - at, t) for s, e, t in here])
            yield Round(k, ids, first[np.append(np.searchsorted(starts, edges), len(starts))], ended)
            k, at, within = m, at + on, kind

    def _buffer(self, data: np.ndarray, heads: np.ndarray, within: int, whole: bool, special: list) -> tuple:
        """The final tokens of a buffer, the pre-tokens and where their tokens begin, and where the stream goes on.

        Pre-tokens are ``starts``; their tokens begin at ``first``, one entry more.  Where all of
        the buffer is known to its end (``whole``) everything is final.
        """
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64), 0, -1
        starts, chars, kind = self.borders(data, heads, within)
        for s, e, _ in special:
            starts = starts[(starts <= s) | (starts >= e)]
        known, unfinished = len(data), False
        ends = np.append(starts[1:], known)
        if not whole:
            known = max(int(chars[max(0, len(chars) - BEHIND)]), int(heads[-1]))
            starts = starts[starts < known]
            unfinished = bool(len(starts)) and int(ends[len(starts) - 1]) > known
            ends = np.minimum(ends[: len(starts)], known)
            if not len(starts):
                return np.zeros(0, np.int32), starts, np.zeros(1, np.int64), known, -1
        size = ends - starts
        # words of equal bytes are merged once
        power, inverse = shingles.powers(known)
        total = np.zeros(known + 1, np.uint64)
        np.cumsum(_BYTE[data[:known]] * power[:known], out=total[1:])
        key = shingles.mix((total[ends] - total[starts]) * inverse[starts] + size.astype(np.uint64))
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        if (size[one][which] != size).any() or (data[_spread(starts[one][which], size)] != data[:known]).any():
            one = which = np.arange(len(starts))  # two words with one hash
        ids, count = self.merged(data[_spread(starts[one], size[one])], size[one])
        if special:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for s, _, t in special:
                parts[which[np.searchsorted(starts, s)]] = np.array([t], np.int32)
            ids, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        from_ = np.cumsum(count) - count
        count = count[which]
        ids = ids[_spread(from_[which], count)]
        on, kind_on = known, -1
        if unfinished:
            stop = starts[-1] + np.cumsum(self.size[ids[len(ids) - count[-1] :]])
            stable = int(np.searchsorted(stop, known - self.lookahead, "right"))
            ids, on = ids[: len(ids) - count[-1] + stable], int(stop[stable - 1] if stable else starts[-1])
            kind_on = int(kind[np.searchsorted(chars, on, "right") - 1]) if stable else -1
            count[-1] = stable
        return ids, starts, np.append(0, np.cumsum(count)), on, kind_on

    def ids(self, text: str | None) -> list[int]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return [t for r in self.rounds(data, np.array([0, len(data)])) for t in r.ids.tolist()]

    def spelt(self, ids: np.ndarray, first: np.ndarray) -> tuple[memoryview, list[int]]:
        """The bytes of tokens, and where those of the tokens from each of ``first`` on begin."""
        size = self.size[ids]
        return memoryview(self.bytes[_spread(self.start[ids], size)]), np.append(0, np.cumsum(size))[first].tolist()

    def listed(self, ids: np.ndarray, first: np.ndarray) -> tuple[memoryview, list[int]]:
        """Decimal ids, a comma before each, and where those from each of ``first`` on begin."""
        out = self.decimals[ids].ravel()
        return memoryview(out[out != 0]), np.append(0, np.cumsum(self.decimal_size[ids]))[first].tolist()


class Decoder:
    """Tokens to text: a token's bytes go through a state machine that keeps an unfinished character."""

    def __init__(self, coder: Transducer):
        self.coder = coder
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.spelt(self.coder.spelt(ids, np.array([0]))[0])

    def spelt(self, data) -> str:
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", final=True)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of a column and where its rows begin and end; null is the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


_coders: dict[str, Transducer] = {}


def coder(path: str | None = None) -> Transducer:
    """The transducer of a vocabulary; one per worker process."""
    path = path or vocabulary_path()
    if path not in _coders:
        _coders[path] = Transducer(path)
    return _coders[path]


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids array<int>``; a column of that name is replaced.  Map-only."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s):
        c, out = coder(vocabulary), [[] for _ in s]
        for r in c.rounds(*_texts(pa.array([t if isinstance(t, str) else None for t in s], pa.large_string()))):
            for j in range(len(r.first) - 1):
                out[r.lo + j].append(r.ids[r.first[j] : r.first[j + 1]])
        return s.__class__([np.concatenate([np.zeros(0, np.int32), *x]) for x in out], index=s.index)

    return docs.withColumn("token_ids", run(F.col(text)))


def decode(docs: DataFrame, ids: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``decoded string``, the text of a column of token ids; null ids give the empty text."""

    @F.pandas_udf(T.StringType())
    def run(s):
        def one(x):
            d = Decoder(coder(vocabulary))
            return (d.feed(x) if x is not None else "") + d.close()

        return s.map(one)

    return docs.withColumn("decoded", run(F.col(ids)))


def digest_all(c: Transducer, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
    """Length, SHA-256 of the decimal ids and of the decoded text of each text, in one streaming pass."""
    n, ids_hash, out_hash = [0] * len(texts), [], []
    open_at, state = -1, None
    for r in c.rounds(*_texts(texts)):
        listed, list_at = c.listed(r.ids, r.first)
        spelt, spelt_at = c.spelt(r.ids, r.first)
        counts = np.diff(r.first).tolist()
        for j, count in enumerate(counts):
            k = r.lo + j
            if k != open_at:
                state = hashlib.sha256(), hashlib.sha256(), Decoder(c)
                open_at = k
            if count:
                state[0].update(listed[list_at[j] + (n[k] == 0) : list_at[j + 1]])
                state[1].update(state[2].spelt(spelt[spelt_at[j] : spelt_at[j + 1]]).encode())
                n[k] += count
            if j + 1 < len(counts) or r.ended:
                state[1].update(state[2].close().encode())
                ids_hash.append(state[0].hexdigest())
                out_hash.append(state[1].hexdigest())
    return n, ids_hash, out_hash


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256.  Streams; ids never leave the worker."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for b in batches:
            n, ids, out = digest_all(c, b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
            common.release()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))
