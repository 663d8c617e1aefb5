import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from sanscope.llm import bpe

from .helpers import docs

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    import base64

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    al = "ab aA  \n\t'sé½²漢字🙂  _.,!?09़ा\x00\x7f­"
    return ["".join(r.choice(al) for _ in range(r.randrange(60))) for _ in range(400)] + [
        "<|endoftext|> x", " " * 300, "ah" * 3000, "", None, "plain words here", "plain words here"]


def test_ids_and_round_trip(spark, tik):
    ts = texts()
    coded = bpe.encode_documents(docs(spark, ts), RANKS, P.PATTERN)
    assert coded.schema["token_ids"].dataType.simpleString() == "array<int>"  # the input's column of that name is replaced
    back = bpe.decode_documents(coded, RANKS, P.PATTERN).collect()
    assert len(back) == len(ts)
    for r in back:
        t = ts[r.doc_id] or ""
        assert r.token_ids == tik.encode_ordinary(t) and bytes(r.decoded) == t.encode()
        assert len(r.starts) == len(r.ends) == len(r.token_ids)
        raw = 0
        for i, a, b in zip(r.token_ids, r.starts, r.ends):
            piece = tik.decode_single_token_bytes(i)
            assert piece in t[a:b].encode() and t.encode()[raw : raw + len(piece)] == piece
            raw += len(piece)


def test_split_characters(tik):
    t = "字🙂é"
    ids = tik.encode_ordinary(t)
    parts = bpe.token_strings(ids, RANKS, P.PATTERN)
    assert "".join(parts) == t and len(parts) == len(ids) > len(t)


def test_bounded_memory_of_pieces(tik, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    c = bpe.Codec(RANKS, P.PATTERN)
    for t in ("one two three four five six seven eight", "one two nine ten", "x" * 200, "one two"):
        assert c.encode_all([t]) == [tik.encode_ordinary(t)]
    assert len(c.pieces) < 20


def test_unknown_id_and_empty_table(spark):
    with pytest.raises(ValueError):
        bpe.codec(RANKS, P.PATTERN).decode([60_000])
    assert bpe.encode_documents(docs(spark, []), RANKS, P.PATTERN).count() == 0


def test_query_digests(spark, sf, tik):
    from sanscope.llm.queries import QUERIES

    got = {r[0]: tuple(r)[1:] for r in QUERIES["op6_bpe"](spark, sf).collect()}
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect():
        ids = tik.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
