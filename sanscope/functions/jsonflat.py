"""JSON flattening, per row and without a shuffle.

A document becomes ``array<struct<key, value>>``: paths joined by ``_``, list indexes as segments, a
prefix in front, null leaves kept, empty objects and lists vanish; paths come in the order of
their first appearance in the document and the last value of a repeated path wins. Spark's JSON
values sort object keys and refuse repeated ones, so the documents are read by a small Arrow-batched
function; everything around it stays in expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sanscope.session import share_code

FLAT_TYPE = "array<struct<key:string,value:string>>"
PARSED_TYPE = f"valid boolean, found boolean, flat {FLAT_TYPE}"


def flatten_value(value, prefix: str) -> dict[str, str | None]:
    """Path -> text of every leaf, in order of first appearance. Any depth: no recursion."""
    out: dict[str, str | None] = {}
    stack = [(prefix, value)]
    while stack:
        name, x = stack.pop()
        if isinstance(x, dict):
            stack.extend((f"{name}{k}_", v) for k, v in reversed(x.items()))
        elif isinstance(x, list):
            stack.extend((f"{name}{i}_", x[i]) for i in range(len(x) - 1, -1, -1))
        else:
            out[name[:-1]] = None if x is None else str(x)
    return out


def parsed(body: Column | str, prefix: str, response: bool = False) -> Column:
    """struct(valid, found, flat) of JSON text. ``found``: it is an object (with ``response``: it
    has a non-empty list ``response``, whose first element is flattened); else ``flat`` is null."""
    share_code(SparkSession.active())

    def read(text):
        try:
            doc = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return False, False, None
        if response:
            doc = doc.get("response") if isinstance(doc, dict) else None
            if not (isinstance(doc, list) and doc):
                return True, False, None
            doc = doc[0]
        elif not isinstance(doc, dict):
            return True, False, None
        return True, True, [{"key": k, "value": v} for k, v in flatten_value(doc, prefix).items()]

    @F.pandas_udf(PARSED_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([read(t) for t in texts], columns=["valid", "found", "flat"])

    return run(F.col(body) if isinstance(body, str) else body)


ELEMENTS_TYPE = f"array<{FLAT_TYPE}>"


def kind(body: Column | str) -> Column:
    """'object' / 'array' / 'scalar' for JSON text, null when it is not JSON. Repeated keys are JSON."""
    share_code(SparkSession.active())

    def read(text):
        try:
            doc = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None
        return "object" if isinstance(doc, dict) else "array" if isinstance(doc, list) else "scalar"

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([read(t) for t in texts], dtype=object)

    return run(F.col(body) if isinstance(body, str) else body)


def response_elements(body: Column | str) -> Column:
    """The list ``response`` of an answer: per element its top-level keys in order of first appearance with the
    text the original prints (``100.0`` stays, ``True``, nested values as Python shows them, null stays null;
    of a repeated key the last value). Elements that are no objects have no keys; null if there is no list."""
    share_code(SparkSession.active())

    def read(text):
        try:
            doc = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None
        found = doc.get("response") if isinstance(doc, dict) else None
        if not isinstance(found, list):
            return None
        return [[{"key": k, "value": None if v is None else str(v)} for k, v in x.items()] if isinstance(x, dict) else [] for x in found]

    @F.pandas_udf(ELEMENTS_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([read(t) for t in texts], dtype=object)

    return run(F.col(body) if isinstance(body, str) else body)


def explode_kv(df: DataFrame, flat_col: str, keys) -> DataFrame:
    """(keys..., key, value) rows of a flattened array. ``explode_outer`` + a null filter
    instead of ``explode``: the optimizer would otherwise infer a ``size > 0`` filter and
    push a second copy of the whole flatten computation below the projections."""
    ex = df.select(*keys, F.explode_outer(F.col(flat_col)).alias("_kv")).where(F.col("_kv").isNotNull())
    return ex.select(*keys, F.col("_kv.key").alias("key"), F.col("_kv.value").alias("value"))
