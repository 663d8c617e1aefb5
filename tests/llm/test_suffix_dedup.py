import random

import pyarrow as pa
import pytest

from sanscope.llm import suffix_dedup as S

from .helpers import brute_suffix, docs


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9))) for _ in range(200)]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    passage = text(40)
    out = [text(r.randrange(5, 120)) for _ in range(30)]
    out += [text(r.randrange(0, 30)) + passage[r.randrange(0, 60) :] + text(r.randrange(0, 30)) for _ in range(25)]
    out += [out[3], out[3] + "!", "?" + out[3], out[5].replace("a", "b", 1), "aaaa" * 80, "aaaa" * 90, "ab" * 150, passage * 4,
            "", None, "short", passage[:100], passage[:99], passage[1:101]]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("kw", [{}, {"crowd": 2, "bucket_rows": 50}, {"length": 40, "anchor": 12}])
def test_matches_brute_force(spark, kw):
    texts = corpus(len(kw))
    got = {r[0]: tuple(r)[1:] for r in S.suffix_dedup(docs(spark, texts), **kw).collect()}
    assert got == brute_suffix(list(enumerate(texts)), kw.get("length", 100))


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE_BYTES", 150)
    texts = corpus(9)
    found = list(S._find_anchors(100, 32, 16)(iter([_batch(texts)])))
    assert sum(b.num_rows for b in found) > 0
    got = {r[0]: tuple(r)[1:] for r in S.suffix_dedup(docs(spark, texts)).collect()}
    assert got == brute_suffix(list(enumerate(texts)))


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t or "" for t in texts])], names=["doc_id", "text"])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_an_anchor_is_judged_as_a_stream(size):
    """However the sorted rows are cut into batches, and with an anchor of far more rows than a batch."""
    r = random.Random(size)
    token = (-(2**63), 0, S.TOKEN << 61)
    rows = set()
    for g in range(60):
        spans = r.choice([1, 1, 2, 5])
        for _ in range(400 if g == 30 else r.choice([1, 2, 9])):
            kind = S.SPREAD if g % 7 == 6 else S.SPAN
            rows.add((g, r.randrange(spans), r.randrange(9), (kind << 61) | (r.randrange(4) << 14) | 5))
        if g % 5 == 4:
            rows.add((g, *token))
        if g % 3 == 0:
            rows.add((g, r.randrange(1, 9), r.randrange(9), (S.REMOVED << 61) | (r.randrange(4) << 14)))
    rows = sorted(rows) + [(61, 1, 1, 5), (61, 1, 1, 5)]  # a repeated row is no copy
    want = []
    for g in range(62):
        live = [x[1:] for x in rows if x[0] == g and x[3] >> 61 in (S.SPAN, S.SPREAD)]
        crowd = any(x[3] >> 61 == S.TOKEN for x in rows if x[0] == g) or g % 7 == 6
        lead = {sh: min((d, p) for s, d, p in live if s == sh) for sh in {x[0] for x in live}}
        want += [(d, p & ((1 << 61) - 1) | (S.REMOVED << 61), 6) for sh, d, p in live if (d, p) != lead[sh]]
        if crowd or len(lead) > 1:
            want += [(d, p & ((1 << 61) - 1) | (int(crowd) << 61), g) for d, p in lead.values()]
        want += [(d, p, sh) for x, sh, d, p in rows if x == g and p >> 61 == S.REMOVED]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size])], names=["g", "sh", "doc_id", "p"])
               for k in range(0, len(rows), size)]
    got = [tuple(x.values()) for b in S._judge_sorted(iter(batches)) for x in b.to_pylist()]
    assert sorted(got) == sorted(want)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "the same long text " * 20
    got = S.suffix_dedup(docs(spark, [(1, t), (1, t), (2, t), (None, t)])).collect()
    want = brute_suffix([(1, t), (2, t)])
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    short = S.suffix_dedup(docs(spark, [(1, "abc"), (1, "abc"), (None, "abc"), (None, "abc"), (2, None)])).collect()
    assert sorted(str(r.doc_id) for r in short) == ["1", "2", "None", "None"]
    assert S.suffix_dedup(docs(spark, [])).count() == 0


def test_loser_tree_merges_without_known_prefixes():
    r = random.Random(3)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(0, 30))) for _ in range(7)]

    def coded(run):
        prev = b""
        for s in run:
            yield S.common_prefix(prev, s, 0), s, None
            prev = s

    got = list(S.LoserTree([coded(x) for x in runs]))
    assert [g[1] for g in got] == sorted(s for x in runs for s in x)
    assert all(g[0] == S.common_prefix(a[1], g[1], 0) for a, g in zip(got, got[1:]))
