import random

import numpy as np
import pytest

from sanscope.llm import decontaminate as D

from .helpers import docs


def bench(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, doc_id long")


def words(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def edited(r, item, k):
    out = list(item)
    for _ in range(k):
        at = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[at] = f"z{r.randrange(10**6)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"z{r.randrange(10**6)}")
    return out


def plain_distance(item, text):
    """Least edits between the item and any stretch of the text."""
    prev = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != w)))
        prev = cur
    return min(prev)


def test_exact_and_edited_copies(spark):
    r = random.Random(2)
    items = [words(r, r.randrange(5, 60)) for _ in range(30)]
    rows, texts = [], []
    for k in range(120):
        body, item = words(r, r.randrange(0, 80)), r.choice(items)
        at = r.randrange(len(body) + 1)
        how = r.randrange(4)
        part = [] if how == 0 else item if how == 1 else edited(r, item, r.randrange(1, max(2, D.allowed_edits(len(item), 0.8) // 2 + 1))) \
            if how == 2 else item[: len(item) // 2]
        body[at:at] = part
        texts.append(body)
        rows.append((k, r.choice([" ", "\n", ", "]).join(w.upper() if r.random() < 0.2 else w for w in body)))
    rows += [(200, ""), (201, None), (202, "...")]
    want = {}
    for k, body in enumerate(texts):
        for i, item in enumerate(items):
            e = plain_distance(item, body)
            if e <= D.allowed_edits(len(item), 0.8):
                want[k, i] = e
    b = bench(spark, [(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None), (98, "")])
    got = {(x.doc_id, x.item_id): x.edits for x in D.contaminated(docs(spark, rows + [(None, rows[0][1])]), b).collect()}
    assert set(got) <= set(want) and all(got[p] == want[p] for p in got)
    exact = {p for p, e in want.items() if e == 0}
    assert exact <= set(got) and len(got) >= 0.97 * len(want) and len(want) > len(exact) + 10
    # in several blocks of items the same
    cut = {(x.doc_id, x.item_id): x.edits for x in D.contaminated(docs(spark, rows), b, block_chars=2000).collect()}
    assert exact <= set(cut) and len(set(cut) ^ set(got)) <= 2
    d = docs(spark, rows)
    kept = D.drop_contaminated(d, b, block_chars=2000)
    assert kept.schema == d.schema
    assert {x.doc_id for x in kept.collect()} == {k for k, _ in rows} - {p[0] for p in cut}


def test_recall_at_the_limit():
    """Items with as many random word edits as are allowed are found in at least 90 of 100 cases."""
    r = random.Random(4)
    items = [words(r, r.randrange(15, 57)) for _ in range(150)]
    index = D.Items(list(range(150)), [" ".join(t).encode() for t in items], 0.8)
    hit = 0
    for k, item in enumerate(items):
        text = words(r, 30) + edited(r, item, D.allowed_edits(len(item), 0.8)) + words(r, 30)
        h = next(iter(D.document_words([" ".join(text).encode()])))
        hit += (0, k) in index.matches(h[1], h[2])
    assert hit >= 0.9 * len(items), hit


@pytest.mark.parametrize("n, count", [(300, 40), (600, 30), (1000, 20)])
def test_recall_of_long_items_at_the_limit(n, count):
    r = random.Random(n)
    hit = 0
    for _ in range(count):
        item = words(r, n)
        index = D.Items([0], [" ".join(item).encode()], 0.8)
        text = words(r, 30) + edited(r, item, D.allowed_edits(n, 0.8)) + words(r, 30)
        h = next(iter(D.document_words([" ".join(text).encode()])))
        hit += (0, 0) in index.matches(h[1], h[2])
    assert hit >= 0.9 * count, hit


@pytest.mark.parametrize("n", range(1, 60))
def test_no_edit_breaks_all_grams(n):
    e = D.allowed_edits(n, 0.8)
    assert n - D.gram_length(n, e) + 1 - D.gram_length(n, e) * e >= 1


def test_edit_distance_matches_plain():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 9))] for _ in range(2))
        e = plain_distance(a, b)
        for most in (0, 2, 9):
            assert D.edit_distance(np.array(a), np.array(b), most) == min(e, most + 1)


def test_repeated_items_are_read_once(spark):
    rows = [(1, "a b c d e f")] * 500 + [(k, f"item {k} of some words") for k in range(20)]
    blocks = list(D._blocks(bench(spark, rows), "item_id", "text", 200))
    assert sorted(x for ids, texts in blocks for x in zip(ids, texts)) == sorted((i, t.encode()) for i, t in set(rows))


def test_empty_tables(spark):
    b = bench(spark, [(1, "a b c d e f")])
    assert D.contaminated(docs(spark, []), b).count() == 0
    assert D.contaminated(docs(spark, ["a b c d e f"]), b.limit(0)).count() == 0
    assert D.drop_contaminated(docs(spark, ["a b c d e f", "x"]), b).count() == 1
