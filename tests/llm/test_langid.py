import zlib
from fractions import Fraction

import numpy as np

from sluice.llm import langid


def brute(word, probs, unknown):
    at = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - 20), j):
            s = word[i:j]
            if s in probs:
                at[j] += at[i] * probs[s]
            elif j - i == 1:
                at[j] += at[i] * unknown
    return np.log(at[-1])


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "a", "b", "ab", "▁ab", "ba", "aba", "▁"]
    prob = np.linspace(0.02, 0.2, len(pieces) + 1)
    lattice = langid.Lattice(pieces)
    words = ["▁abab", "▁a", "abaabab", "zb", "▁zzz", "b" * 20, "▁" + "abbaz" * 3000]
    got = lattice.forward(words, prob[:, None])[:, 0]
    want = [brute(w[:300], dict(zip(pieces, prob)), prob[-1]) for w in words]
    assert np.allclose(got[:-1], want[:-1])
    langid_block = langid.BLOCK
    try:
        langid.BLOCK = 7
        assert np.allclose(lattice.forward(words, prob[:, None])[:, 0], got)
    finally:
        langid.BLOCK = langid_block
    # 15000 letters: far below the least double, so in exact arithmetic
    exact = [Fraction(1)] + [Fraction(0)] * 300
    word, p = words[-1][:300], dict(zip(pieces, map(Fraction, prob)))
    for j in range(1, 301):
        for i in range(max(0, j - 3), j):
            exact[j] += exact[i] * p.get(word[i:j], Fraction(prob[-1]) if j - i == 1 else 0)
    log = np.log(float(exact[-1] * Fraction(10) ** 200)) - 200 * np.log(10)
    assert np.isclose(lattice.forward([word], prob[:, None])[0, 0], log)
    assert np.isfinite(got[-1]) and got[-1] < 40 * log


def test_expected_counts_match_derivative():
    pieces = ["▁a", "a", "b", "ab", "▁"]
    prob = np.array([0.1, 0.2, 0.3, 0.15, 0.2, 0.01])
    lattice = langid.Lattice(pieces)
    words, weight = ["▁abab", "ab"], np.array([2.0, 3.0])
    got = lattice.expected(words, weight, prob)
    for k in range(len(pieces)):
        up = prob.copy()
        up[k] *= 1 + 1e-6
        slope = (lattice.forward(words, up[:, None]) - lattice.forward(words, prob[:, None]))[:, 0] / 1e-6
        assert np.isclose(got[k], (slope * weight).sum(), atol=1e-4)


def test_rows(spark):
    base = {"xx": "abra kadabra simsala bim ", "yy": "lorem ipsum dolor sit amet "}
    rows = [(k, base[l] * (1 + k % 4), l) for k, l in enumerate(["xx", "yy"] * 30)]
    rows += [(100, None, "xx"), (101, "", "yy"), (102, "123 !!", None), (103, "kadabra", None), (103, "kadabra", None), (104, "ipsum" * 3000, None), (None, "dolor", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang as score", "lang as fit", "lang as lang_pred", "lang as langid")
    out = langid.predict(docs, langid.fit(docs), keep=True).selectExpr("doc_id", "text", "lang", "langid", "langid_.lang_pred", "langid_.score").collect()
    assert all(r.langid == r.lang for r in out)
    kept = langid.stage(spark, docs, "").collect()
    assert len(kept) == len(rows) - 3 and all(r.score == r.fit == r.lang_pred == r.langid == r.lang for r in kept)
    assert len(out) == len(rows)
    got = {(r.doc_id, r.text): r.lang_pred for r in out}
    assert all(got[i, t] == l for i, t, l in rows[:60])
    assert got[100, None] == got[101, ""] == got[102, "123 !!"] == "und"
    assert got[103, "kadabra"] == "xx" and got[104, "ipsum" * 3000] == got[None, "dolor"] == "yy"
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
    held = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out(docs.doc_id).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items() if i is not None)


def test_held_out_labels_are_not_seen(spark):
    rows = [(k, "abc abd " * 3, "aa" if zlib.crc32(str(k).encode()) % 3 != 1 else "zz") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {"aa"}


def test_whole_query_against_brute_force(spark, tmp_path):
    """Held-out rows, texts without letters, and every score against plain sums over the fitted model."""
    rng = np.random.default_rng(4)
    stems = {"aa": ["kala", "mori", "suvi", "tala"], "bb": ["grond", "werk", "stad", "kracht"], "cc": ["piu", "bello", "ciao", "terra"]}
    rows = [(k, " ".join(rng.choice(stems[l], 6)) + rng.choice(["", " 12 !", " KALA", "\n"]), l) for k, l in enumerate(rng.choice(list(stems), 90).tolist())]
    rows += [(200, None, "aa"), (201, " 7 ", "bb"), (202, "x" * 5000, None), (203, "bello " * 4000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fit(docs)
    langs, pieces, prob = model
    got = {r.doc_id: r for r in langid.op6_langid(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    tables = [dict(zip(pieces, prob[:-1, k])) for k in range(len(langs))]
    right = 0
    for i, t, l in rows:
        words = ["".join(c if c.isalpha() else " " for c in (t or "").lower()).split()][0]
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        elif len(t) < 1000:
            total = np.array([sum(brute("▁" + w, p, langid.UNKNOWN) for w in words) for p in tables])
            assert got[i].lang_pred == langs[int(total.argmax())]
            assert np.isclose(got[i].score, 1 / np.exp(total - total.max()).sum())
            right += got[i].lang_pred == l
    assert right >= 88 and got[203].lang_pred == "cc"
