"""Fixtures and brute-force twins of the operators."""

from __future__ import annotations

import collections
import hashlib
import re

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType()),
                    # columns whose names operators use themselves
                    T.StructField("key", T.StringType()), T.StructField("name", T.StringType()),
                    T.StructField("h", T.LongType()), T.StructField("token_ids", T.StringType())])


def docs(spark, texts, slices=3):
    """Rows (id, text), or texts numbered from 0, with clashing extra columns."""
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    rows = [(i, t, None if k % 3 else "en", f"src{k % 2}" if k % 5 else None, None if t is None else len(t), "k", None, k, "x")
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, DOC).repartition(slices) if rows else spark.createDataFrame([], DOC)


def brute_exact(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def brute_suffix(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out
