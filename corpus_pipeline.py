"""A training-corpus pipeline over ``documents``.

``STAGES`` are (name, function) pairs.  A function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but the last
return the columns of ``documents``:

language ID        drops documents without any letter of a known language
line dedup         takes out lines that an earlier document, or line, has, at most a word apart;
                   drops documents of which nothing is left
MinHash            keeps one document of each group of near copies
decontamination    drops documents that hold a passage of a benchmark item
BPE                the digest of each document's tokens and of the text decoded from them

Defined results: null and empty texts have no letter and go in the first stage, so do texts of
digits and signs alone.  Very long texts pass through every stage whole.  Ties: of equal lines
the earliest place stays, of a group of near copies the least doc_id; of rows that share doc_id
and text one stays, and rows that share an id alone stay or go together.  A null doc_id is an id
of its own: such rows are compared by line and by passage, but not as near copies.  Empty tables
give empty results at every stage.  Extra columns pass through all stages but the last, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import bpe, common, decontam, langid, linededup, minhash


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("language id", langid.stage),
    ("line dedup", linededup.stage),
    ("minhash near-dedup", minhash.stage),
    ("decontamination", decontam.stage),
    ("bpe", encode),
]

#: Language ID and the tokenizer have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each reads what the one before wrote."""
    ws = common.Workspace(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
