import hashlib
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sluice.llm import bpe


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(bpe.vocabulary_path())


CASES = [
    "", " ", "  ", "a", " a", "a  b", "a   b ", "foo \n bar\n\n  baz", "don't we'll I'VE", "x\xa0y 　 z", "tab\t x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>",
    "Ünïcödé ñandú é", "日本語 テキスト", "🙂🙂 ok 👩‍👩‍👧", "\x00\x01 \x7f", "!!! ??? ...", "123 4567 8.9", "a" * 5000, "ab" * 3000, " " * 3000, "=" * 2500, "é" * 2000, "\r\n\r\n x", "aé" * 900 + " " * 7 + "b",
    "'s", "a's b'll 've 're x'tx 'sé ''s '' s", "\n's\t're  'd", "x'", " 's 't", "1's2'm", "a\x1cb\x85c᠎d", "'s's'", "'r 'l 'v",
]


@pytest.mark.parametrize("text", CASES)
def test_matches_library(lib, text):
    c = bpe.coder()
    want = lib.encode(text, add_special_tokens=False).ids
    assert c.ids(text) == want
    d = bpe.Decoder(c)
    assert "".join(d.feed([t]) for t in want) + d.close() == lib.decode(want, skip_special_tokens=False)


def test_every_kind_of_character(lib):
    c = bpe.coder()
    for low in range(0, 0x30000, 64):
        text = "".join(f"a{x}b {x} {x}{x}1" for x in map(chr, range(low, low + 64)) if not 0xD800 <= ord(x) < 0xE000)
        assert c.ids(text) == lib.encode(text, add_special_tokens=False).ids


ALPHABETS = ["ab ", "aeiou nrst", "the ing  \n", "01 .,", "éèa ñ", "abcdefghijklmnopqrstuvwxyz", "\t \n x", "'svelrtmd ' ", "日本語テキ", "!?'s ", " \n", "🙂é' "]


@pytest.mark.parametrize("buffer", [0, 3000, bpe.BUFFER])
def test_streams_of_any_length(lib, monkeypatch, buffer):
    """The least buffer lets the lookahead decide what is final in most of these texts."""
    monkeypatch.setattr(bpe, "BUFFER", buffer)
    rng, c = random.Random(buffer), bpe.coder()
    texts = []
    for _ in range(120):
        alphabet = rng.choice(ALPHABETS)
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 40, 700, 4000, 9000])))
        at = rng.randrange(len(text) + 1)
        texts.append(None if rng.random() < 0.05 else text if rng.random() < 0.8 else text[:at] + "<|endoftext|>" + text[at:])
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [c.ids(t) for t in texts] == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    n, ids, out = bpe.digest_all(c, pa.array(texts))
    assert n == list(map(len, want))
    assert ids == [sha(",".join(map(str, w))) for w in want]
    assert out == [sha(t or "") for t in texts]


def test_what_a_buffer_emits_stays(lib):
    """Tokens before the end of a buffer do not depend on what follows, and the rest held back is short."""
    rng, c = random.Random(7), bpe.coder()
    import numpy as np

    for _ in range(60):
        alphabet = rng.choice(ALPHABETS)
        text = "".join(rng.choice(alphabet) for _ in range(2000))
        data = np.frombuffer(text.encode(), np.uint8)
        end = len("".join(text[:1500]).encode())
        ids, _, _, on, _ = c._buffer(data[:end], np.array([0]), -1, False, [])
        assert lib.encode(text, add_special_tokens=False).ids[: len(ids)] == ids.tolist()
        assert end - on <= c.lookahead + c.longest + 4 * bpe.BEHIND


def test_frames(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z"), (4, "ab " * 9000, None)], "doc_id long, text string, token_ids string")
    out = bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["", "", "hello world", "hello world", "ab " * 9000]
    rows = bpe.digests(docs).collect()
    assert sorted(r.n_tokens for r in rows)[:4] == [0, 0, 2, 2]
    assert bpe.digests(docs.limit(0)).count() == 0 and bpe.encode(docs.limit(0)).count() == 0
