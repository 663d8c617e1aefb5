import random

import numpy as np
import pytest

from sanscope.llm import minhash
from sanscope.llm.hashing import shingle_sets, word_hashes

from .helpers import brute_near, docs, shingles


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([3, 5, 6, 40, 120]))] for _ in range(n // 4)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(3):
            c = list(b)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                c[r.randrange(len(c))] = r.choice(words)
            out.append(r.choice([" ", "\n", " \t"]).join(x.upper() if r.random() < 0.1 else x for x in c))
    return out + ["", None, "  \n", "one", "ONE", "one two", "É é é é é é", "é é é é é é"]


@pytest.mark.parametrize("few", [500, 0])
def test_components_match_brute_force(spark, few, monkeypatch):
    """By open pairs at once, and by further leaders first."""
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "LEADERS", 2)
    texts = corpus(few)
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_large_group_of_near_copies(spark):
    """A chain of copies that are not all linked with each other is one component."""
    r = random.Random(1)
    text, rows = [f"w{r.randrange(10**6)}" for _ in range(200)], []
    for i in range(80):
        text = list(text)
        text[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(3, rows[3][1]), (None, rows[3][1])]
    got = minhash.near_duplicates(docs(spark, rows)).collect()
    want = brute_near(rows[:80])
    assert len(got) == 82 and all((x.component_id, x.kept) == want[x.doc_id][1:] for x in got if x.doc_id is not None)
    assert [x.component_id for x in got if x.doc_id is None] == [None]


def test_few_texts_are_read_for_a_large_group(spark, monkeypatch):
    """Near copies of one text meet many leaders in their buckets; in the first turn each is confirmed against a few."""
    read, keep = [], minhash.Scratch.keep

    def kept(self, df, label, **kw):
        out = keep(self, df, label, **kw)
        if label == "pairs":
            read.append(out.count())
        return out

    monkeypatch.setattr(minhash.Scratch, "keep", kept)
    r = random.Random(3)
    base, texts = [f"w{k}" for k in range(300)], []
    for i in range(250):
        c = list(base)
        c[r.randrange(300)] = f"x{i}"
        texts.append(" ".join(c))
    got = minhash.near_duplicates(docs(spark, texts)).collect()
    assert {x.component_id for x in got} == {0} and read[0] <= minhash.NEAREST * 250


def test_recall_at_the_limit(spark):
    """Pairs of similarity 0.8507, from one changed word in 66 to ten in 624, and pairs just below the limit."""
    r = random.Random(5)
    rows, linked = [], []
    for n in range(200):
        k = (1, 2, 5, 10)[n % 4]
        a = [f"w{r.randrange(10**9)}" for _ in range(62 * k + 4)]
        b, over = list(a), n >= 160  # 62 * k shingles; every changed word, five or more apart from others and the ends, changes five
        places = r.sample(range(62 * k // 6), k + over)
        for at in places:
            b[5 + 6 * at if 5 + 6 * at < len(b) - 5 else len(b) // 2] = f"x{r.randrange(10**9)}"
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b))]
        x, y = shingles(rows[-2][1]), shingles(rows[-1][1])
        linked.append(100 * len(x & y) >= 85 * len(x | y))
        assert over or 85 * len(x | y) <= 100 * len(x & y) < 87 * len(x | y)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    together = [got[2 * n + 1] == 2 * n for n in range(200)]
    assert not any(t for t, y in zip(together, linked) if not y) and linked.count(False) >= 30
    assert sum(together) >= 0.9 * sum(linked)


def test_empty_table(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_odd_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    for shared in (100, 700, 900):  # the estimate is made for high similarities: low ones only come out low
        a = r.integers(0, 2**63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:shared], r.integers(0, 2**63, 1000 - shared, dtype=np.uint64)])
        _, odd = minhash.bands_and_sketches(np.array([minhash.samples(a), minhash.samples(b)]))
        z = int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum())  # of signed numbers it would count the absolute value
        n, k = minhash.SKETCH_BITS, minhash.SAMPLES
        estimate = 1 + n * np.log(1 - 2 * z / n) / (4 * k) if 2 * z < n else 0
        assert estimate < 0.5 if shared == 100 else abs(estimate - shared / (2000 - shared)) < 0.15


def test_words_cut_into_pieces(monkeypatch):
    from sanscope.llm import hashing

    data = ("alpha beta " * 50 + "g" * 500 + " delta").encode()
    whole = word_hashes(data)
    monkeypatch.setattr(hashing, "PIECE", 37)
    cut = hashing.word_hashes(data)
    assert all(np.array_equal(x, y) for x, y in zip(whole, cut))
    assert [len(s) for s in shingle_sets([b"a b c d e f", b"", b"a b"])] == [len(shingles(t)) for t in ("a b c d e f", "", "a b")]
