"""Page-rank lookups: target batches, stored answers, response rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanscope.functions import jsonflat as J
from sanscope.functions import names as N
from sanscope.operators import ordering


def batch_targets(domains: DataFrame, size: int, order_col: str = "target_seq") -> DataFrame:
    """Chunks of ``size`` domains in input order (distributed order numbers, no global window)."""
    return ordering.batch_number(domains, [order_col], size, "batch_no")


def explode_response(answers: DataFrame, keys=("target_seq",), body_col: str = "body") -> DataFrame:
    """All ``response`` elements of all stored answers, one row each (long key/value form)."""
    return answers.select(*keys, F.posexplode(J.response_elements(body_col)).alias("elem_pos", "_flat"))


def rank_rows(domains: DataFrame, answers: DataFrame, size: int, col: str = "dominio") -> DataFrame:
    """Domains in batches of ``size`` -> the response elements of their stored answers (the first one per domain text,
    only those with HTTP status 200), in long form. A domain that is listed twice has its elements twice."""
    found = first_answers(answers.where(F.col("http_status") == 200)).select(F.col("target").alias("_target"), "body")
    asked = batch_targets(domains, size)
    return explode_response(asked.join(found, asked[col] == found["_target"]), ("batch_no", "target_seq"))


def first_answers(snapshot: DataFrame, keys=("target",), order: str = "target_seq") -> DataFrame:
    """A snapshot with one answer per stripped target text (and further ``keys``): the first stored
    one. The minimum is a hash aggregate, the rows follow by a semi join."""
    s = snapshot.withColumn("target", N.py_strip("target"))
    return s.join(s.groupBy(*keys).agg(F.min(order).alias(order)), [*keys, order], "left_semi")


def enrich_rank(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """Target -> stored answer of its lookup (left join on the target text; a miss keeps the
    target with null answer fields)."""
    t = targets.select("target_seq", N.py_strip("target").alias("target"))
    # texts are larger than the estimate of the columns they are made of
    return t.join(first_answers(answers).select("target", "http_status", "body").hint("merge"), "target", "left")
