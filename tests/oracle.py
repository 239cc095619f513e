"""Compares a query's rows with those of its DuckDB form."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MISSING = not os.path.isdir(SF)


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    v = float(v)
    return "nan" if math.isnan(v) else round(v, 6)


def differ(spark, queries, oracles, name, sf=SF):
    """What only one side has; both empty if they agree."""
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = db.execute(oracles[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols, (names, cols)
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in rel.fetchall())
    return [x for x in got if x not in set(want)], [x for x in want if x not in set(got)], len(got) - len(want)
