import random
import re

from sluice.llm import pii

PATTERN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def good(kind, m):
    n = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(n) <= 19 and luhn(n)
    if kind == "phone":
        return 9 <= len(n) <= 15
    return True


def brute(text):
    out = [(m.start(), k, m.end()) for o, k in enumerate(PATTERN) for m in re.finditer(PATTERN[k], text or "", re.ASCII) if good(k, m[0])]
    return sorted(out, key=lambda x: (x[0], list(PATTERN).index(x[1])))


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as pii", "1 as __m_email")
    df = df.drop("__m_email")
    rows = pii.find(df).collect()
    assert all(r.pii == "x" for r in rows)  # the docs' own column stays
    return {r.doc_id: r.pii_ for r in rows}


def test_against_brute_force(spark):
    rng = random.Random(7)
    bits = ["a@b.c", "x.y+z@host-1.example.org", "@", ".", "+", "1.2.3.4", "256.1.1.1", "000255.0.0.1", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49 30 1234567", "é", "🙂", " ", "-", "12", "0", "\n", "word", "a@b", "a@b.c.d.", "5500000000000004", "+", "1.2.3.4.5.6.7.8", "378282246310005 6011111111111117"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([1, 3, 8, 40]))) for _ in range(600)]
    texts += [None, "", "a@b.c " * 3000, "9" * 50_000, "a" * 50_000, "1.1.1.1." * 2000, "+1" * 5000, "4111111111111111 " * 700, "1 " * 30_000, "a." * 20_000 + "@b" + ".c" * 20_000]
    got = run(spark, texts)
    for k, t in enumerate(texts):
        want = brute(t)
        assert [(s.start, s.kind, s.end) for s in got[k] if s.kind != "iban"] == want, (t or "")[:80]


def test_added_spans_and_scores(spark):
    texts = ["my iban DE89 3704 0044 0532 0130 00.", "GB82WEST12345698765432 ok", "DE89 3704 0044 0532 0130 01", "call my mobile +49 30 1234567", "+49 30 1234567"]
    got = run(spark, texts)
    assert [(s.kind, s.start, s.end) for s in got[0] if s.kind == "iban"] == [("iban", 8, 35)]
    assert [(s.kind, s.start, s.end) for s in got[1]] == [("iban", 0, 22)]
    assert not [s for s in got[2] if s.kind == "iban"]
    assert got[3][0].score > got[4][0].score
    assert (got[3][0].score, got[4][0].score, got[0][0].score) == (70, 60, 100)


def test_frames(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, None)], "doc_id long, text string")
    assert sorted(len(r.pii) for r in pii.find(df).collect()) == [0, 1, 1]
    assert pii.find(df.limit(0)).count() == 0
