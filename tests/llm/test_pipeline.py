"""The stages one after the other against plain versions of each decision."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from sluice.llm import bpe
from tests.llm.test_decontam import brute as hits
from tests.llm.test_linededup import brute as dropped_lines
from tests.llm.test_minhash import brute as near_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain(rows, items):
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    gone, out = dropped_lines(rows), []
    for i, t in rows:
        kept = [s for k, s in enumerate(t.split("\n")) if (i, k) not in gone]
        if len(kept) == len(t.split("\n")) or "\n".join(kept):
            out.append((i, "\n".join(kept)))
    keep = {i for i, _, c in near_groups(out, 80) if i == c}
    out = [(i, t) for i, t in out if i in keep]
    bad = {i for i, _, n, *_ in hits(out, items) if n}
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in out if i not in bad}
    return sorted((i, len(x), sha(",".join(map(str, x))), sha(lib.decode(x, skip_special_tokens=False))) for i, x in ids.items())


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocab = {"aa": ["alpha%s" % c for c in "bcdefghijklmnop"], "bb": ["zulu%s" % c for c in "qrstuvwxyzabc"]}
    line = lambda l, n: " ".join(rng.choice(vocab[l]) for _ in range(n))
    rows = []
    for k in range(60):
        l = rng.choice(["aa", "bb"])
        rows.append((k, "\n".join(line(l, rng.choice([3, 9, 40])) for _ in range(rng.choice([1, 4]))), l))
    rows += [(60, rows[0][1], "aa"), (61, rows[1][1].replace("alphab", "alphac"), "aa"), (62, None, None), (63, "", "aa"), (64, "12 34", "bb"), (65, rows[4][1] + "\nnew line of its own here", "aa")]
    items = [(1, line("aa", 14)), (2, line("bb", 5))]
    rows += [(70, line("aa", 30) + " " + items[0][1], "aa"), (71, line("bb", 30) + "\n" + items[1][1].upper() + ".", "bb")]
    spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == plain([(i, t) for i, t, _ in rows], items)
    assert {70, 71, 62, 63, 64}.isdisjoint(r[0] for r in got)


def test_odd_rows_and_extra_columns(spark, tmp_path):
    """Nulls, an empty text, a very long one, repeated ids and rows, columns with the operators' names, an empty table."""
    long = " ".join("word%s" % "abcdefghij"[k % 10] * (k % 3 + 1) for k in range(60_000))
    rows = [(1, "alpha beta gamma delta one", "aa"), (1, "alpha beta gamma delta one", "aa"), (2, None, None), (3, "", "aa"), (4, "12 34", None), (None, "alpha tau rho sigma phi", "aa"), (5, long, "aa"), (6, "another text of its own", "aa"), (6, "and one more under that id", "aa")]
    docs = spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' as langid", "'y' as n_dropped", "'z' as n_lines", "1 as component_id", "'k' as kept", "2 as score", "3 as g_own", "4 as __again", "5 as rep")
    items = spark.createDataFrame([(1, "nothing that stands in any of these documents at all, not once"), (2, None), (None, "x y")], "item_id long, text string")
    for name, some in (("full", docs), ("none", docs.limit(0))):
        at = f"{tmp_path}/{name}"
        some.write.parquet(f"{at}/documents.parquet")
        items.write.parquet(f"{at}/benchmark.parquet")
        out = spark.read.parquet(f"{at}/documents.parquet")
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, out, at).write.parquet(f"{at}/{k}")
            out = spark.read.parquet(f"{at}/{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, stage
                assert out.where("langid <> 'x' or n_dropped <> 'y' or n_lines <> 'z' or kept <> 'k' or score <> 2").count() == 0
        got = sorted((r.doc_id for r in out.collect()), key=str)
        assert got == ([1, 5, 6, 6, None] if name == "full" else [])
