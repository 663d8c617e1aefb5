import random
import re

import numpy as np
import pytest
import xxhash

from sanscope.llm import simhash as S
from sanscope.llm.queries import op12_simhash

from .helpers import docs


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    """Components over (id, text): every pair of fingerprints compared."""
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    live = sorted({(i, f) for i, f in prints if i is not None})
    up = {i: i for i, _ in live}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, f) in enumerate(live):
        for b, g in live[:k]:
            if (f ^ g).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted(((i, f, None if i is None else find(i)) for i, f in prints), key=str)


def got(frame):
    return sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in frame.collect()), key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(n):
        base = [r.choice(words) for _ in range(r.choice([1, 3, 4, 30, 200]))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            c = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                c[r.randrange(len(c))] = r.choice(words)
            out.append(r.choice([" ", "\n", " \t"]).join(x.upper() if r.random() < 0.1 else x for x in c))
    return out + ["", None, " \n", "one", "ONE", "É é\x85x y z", "é é", "a " * 30_000]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"blocks": 7}), (3, {"tree": 2}), (4, {"tree": 4, "blocks": 5})])
def test_matches_brute_force(spark, seed, options):
    rows = list(enumerate(corpus(seed)))
    assert got(S.near_duplicates(docs(spark, rows), **options)) == brute(rows)


def test_null_repeated_and_shared_ids(spark):
    """An id with two texts joins both their components; null ids stay alone."""
    r = random.Random(5)
    a, b = (" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(99)) for _ in range(50)) for _ in range(2))
    rows = [(7, a), (3, a), (7, b), (9, b), (9, b), (None, a), (None, None), (4, ""), (12, None)]
    want = [tuple(x) for x in brute(rows)]
    assert got(S.near_duplicates(docs(spark, rows))) == want
    assert {i: c for i, _, c in want} == {3: 3, 7: 3, 9: 3, None: None, 4: 4, 12: 4}


def test_empty_table(spark):
    assert S.near_duplicates(docs(spark, [])).count() == 0


def test_fingerprints_of_long_texts():
    r = random.Random(6)
    for n in (1, 3, 4, 5, 20_000):
        t = " ".join(r.choice(["alpha", "beta", "gamma", "délta", "E", "f"]) + str(r.randrange(50)) for _ in range(n))
        assert S.fingerprint(t.encode()) == brute_fingerprint(t)


def shards(values, radius, groups=None):
    return list(S.shard_links(zip(values, range(len(values)), groups or range(len(values)), [True] * len(values)), radius))


def test_tree_links_span_the_components():
    """A dense ball and scattered fingerprints: the links join what brute force joins, without a link too many."""
    r = np.random.default_rng(7)
    ball = {int(x) for x in r.integers(0, 2**63, 300)}
    centre = int(r.integers(0, 2**63))
    for _ in range(400):
        x = centre
        for _ in range(int(r.integers(0, 6))):
            x ^= 1 << int(r.integers(0, 64))
        ball.add(x)
    values = list(ball)
    links = shards(values, 4)
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert (values[a] ^ values[b]).bit_count() <= 4 and find(a) != find(b)
        up[find(a)] = find(b)
    left = {find(k) for k in range(len(values))}
    assert all((values[a] ^ values[b]).bit_count() > 4 or find(a) == find(b) for a in range(len(values)) for b in range(a))
    assert len(left) + len(links) == len(values)


def test_subtrees_of_the_own_group_are_skipped():
    r = random.Random(8)
    values = list({sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(1500)})
    sets = S.Groups()
    tree = S.BKTree(4, sets)
    for v in values:
        m = sets.add()
        list(tree.links(v, m))
        tree.insert(v, m)
    assert tree.visited < 0.05 * len(values) ** 2 / 2


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    result = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in op12_simhash(spark, sf).collect()), key=str)
    assert result == brute(rows)
