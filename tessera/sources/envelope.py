"""Typed envelopes of a data portal: values as ``__kind__payload`` strings, strings in base64, rows as key/value objects."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_flat(c: Column, kind: str) -> Column:
    """One envelope string to a column of type ``kind``, in built-in functions; ``__null__`` and other kinds give null."""
    tag, body = F.regexp_extract(c, "^__([a-z]+)__", 1), F.regexp_replace(c, "^__[a-z]+__", "")
    text = F.when(tag.isin("string", "longstring"), F.unbase64(body).cast("string")).when(tag.isin("number", "boolean"), body)
    return text.try_cast(kind)


def decode(node):
    """Recursive form for nested objects: dicts of ``{"key": ..., "value": ...}`` lists, lists and envelope strings."""
    if isinstance(node, dict):
        return {k: decode(v) for k, v in node.items()}
    if isinstance(node, list):
        if node and all(isinstance(x, dict) and x.keys() == {"key", "value"} for x in node):
            return {decode(x["key"]): decode(x["value"]) for x in node}
        return [decode(x) for x in node]
    if not isinstance(node, str) or not node.startswith("__"):
        return node
    kind, _, body = node[2:].partition("__")
    match kind:
        case "null":
            return None
        case "number":
            return float(body)
        case "boolean":
            return body == "true"
        case "string" | "longstring":
            return base64.b64decode(body).decode()
    return node


def decode_json(c: Column) -> Column:
    """Nested envelopes as JSON text (Arrow-batched)."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else json.dumps(decode(json.loads(s)), ensure_ascii=False))

    return run(c)


def encode(c: Column, kind: str) -> Column:
    """A column as envelope strings, for round trips."""
    text = c.cast("string")
    body = F.base64(text.cast("binary")) if kind == "string" else text
    return F.coalesce(F.concat(F.lit(f"__{kind}__"), body), F.lit("__null__"))
