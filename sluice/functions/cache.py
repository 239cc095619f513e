"""External replies by key: the engine never calls a service, it joins a table of replies (2.O)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def request_key(*parts: Column) -> Column:
    """SHA-256 of the request as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def replies(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests with the reply that the cache has, or null (O1, O2)."""
    return requests.join(cache.select(key, "reply"), key, "left")


def pending(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests still without a reply."""
    return requests.join(cache.select(key), key, "left_anti")


def repair(text: str | None) -> str | None:
    """The JSON in a reply: fences and talk around it go, trailing commas go, open ends are closed."""
    if not text:
        return None
    body = re.sub(r"```[a-zA-Z]*", "", text)
    starts = [k for k in (body.find("{"), body.find("[")) if k >= 0]
    if not starts:
        return None
    body, stack, quoted, k, good = body[min(starts) :], [], False, 0, 0
    out = []
    while k < len(body):
        c = body[k]
        if quoted:
            quoted = c != '"'
            if c == "\\":
                out.append(c)
                k += 1
                c = body[k] if k < len(body) else ""
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
        out.append(c)
        k += 1
        if not stack and not quoted:
            break
    whole = "".join(out) + ('"' if quoted else "")
    # a cut reply loses its unfinished last member
    for tail in (whole, *(whole[:m] for m in sorted((m.start() for m in re.finditer(",", whole)), reverse=True))):
        need, inside, at = [], False, 0
        while at < len(tail):
            c = tail[at]
            if inside and c == "\\":
                at += 1
            elif c == '"':
                inside = not inside
            elif not inside and c in "{[":
                need.append("}" if c == "{" else "]")
            elif not inside and c in "}]" and need:
                need.pop()
            at += 1
        if inside:
            continue
        try:
            return json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", tail.rstrip().rstrip(",") + "".join(reversed(need)))), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repaired(s: pd.Series) -> pd.Series:
    return s.map(repair)
