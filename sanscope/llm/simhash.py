"""Near-duplicate components by SimHash fingerprints and BK-trees.

Two fingerprints with at most ``radius`` differing bits agree in all bits of some of the blocks that
the 64 bits are cut into. Every choice of so many blocks is a table; its shards are the distinct
fingerprints with the same bits there, so linked fingerprints meet in a shard. Each shard is one or
more BK-trees of bounded size: children keyed by their Hamming distance to the parent, of which a
search follows only those within the radius.

No pairs are written, only the links that join two groups of a tree. A node knows whether all below it are
one group already: a search skips such a subtree if it is the fingerprint's own. Shards larger than a tree
are cut into several; what those trees couldn't see, links between them, is searched afterwards by
the fingerprints that aren't of their shard's largest component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, text_or_empty
from .hashing import text_bytes

WORDS, RADIUS, SEED = 4, 4, 42
#: Blocks of the fingerprint. ``blocks - radius`` of them agree at least: 2 of 6 make 15 tables of 21 bits.
#: Shards should stay small: 7 blocks (35 tables of 27 bits) suit 100 million and more fingerprints.
BLOCKS = 6
#: Fingerprints of one tree.
TREE = 1024


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a text: a bit is 1 if set in over half the shingles' hashes. No words: 0."""
    parts = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    n = max(len(parts) - words + 1, 1)
    begins = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins, stops)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fps = np.array([fingerprint(t, words) for t in text_bytes(part.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


class Groups:
    """Disjoint sets of numbers 0, 1, ..."""

    def __init__(self):
        self.up: list[int] = []

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


class BKTree:
    """Fingerprints of one shard. ``mark`` of a node is a member of the only group below it, or -1."""

    def __init__(self, radius: int, groups: Groups):
        self.radius, self.groups = radius, groups
        self.value: list[int] = []
        self.member: list[int] = []
        self.children: list[dict[int, int]] = []
        self.mark: list[int] = []
        self.visited = 0

    def insert(self, value: int, member: int) -> None:
        node = len(self.value)
        self.value.append(value)
        self.member.append(member)
        self.children.append({})
        self.mark.append(member)
        at, find = 0, self.groups.find
        if not node:
            return
        while True:
            if self.mark[at] >= 0 and find(self.mark[at]) != find(member):
                self.mark[at] = -1
            d = (self.value[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = node
                return
            at = below

    def links(self, value: int, member: int) -> Iterator[int]:
        """Members within the radius, one of each group that is not yet ``member``'s; they are joined."""
        if not self.value:
            return
        radius, groups, stack = self.radius, self.groups, [0]
        while stack:
            at = stack.pop()
            if self.mark[at] >= 0 and groups.find(self.mark[at]) == groups.find(member):
                continue
            self.visited += 1
            d = (self.value[at] ^ value).bit_count()
            if d <= radius:
                a, b = groups.find(self.member[at]), groups.find(member)
                if a != b:
                    groups.join(a, b)
                    yield self.member[at]
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def shard_links(rows: Iterator[tuple[int, int, int, bool]], radius: int) -> Iterator[tuple[int, int]]:
    """Links (a, b) of one tree's rows (fingerprint, representative, group, own): a tree's own fingerprints
    come first, then those that only search it. Rows of the same group are connected already."""
    sets, known, owner = Groups(), {}, {}
    tree = BKTree(radius, sets)
    for value, rep, group, own in rows:
        member = sets.add()
        sets.join(member, sets.find(known.setdefault(group, member)))
        for other in tree.links(value, member):
            yield rep, owner[other]
        if own:
            tree.insert(value, member)
            owner[member] = rep


def _links(radius: int):
    """Rows key, tree, own, fp, rep, comp sorted by key, tree, own first -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)]
                held = [np.concatenate([h, c]) for h, c in zip(held, cols)] if held else cols
            if not held or not len(held[0]):
                continue
            key, tree = held[0], held[1]
            cut = np.flatnonzero((key[1:] != key[:-1]) | (tree[1:] != tree[:-1])) + 1
            bounds = np.concatenate([[0], cut, [len(key)]])
            whole = len(bounds) - 1 if batch is None else len(bounds) - 2  # the last group may go on
            a, b = [], []
            sizes = np.diff(bounds)[:whole]
            for g in np.flatnonzero(sizes > 1):
                part = slice(bounds[g], bounds[g + 1])
                comp = held[5][part]
                if (comp == comp[0]).all():
                    continue
                rows = zip(held[3][part].view(np.uint64).tolist(), held[4][part].tolist(), comp.tolist(), (held[2][part] == 0).tolist())
                for x, y in shard_links(rows, radius):
                    a.append(x)
                    b.append(y)
            rest = bounds[max(whole, 0)]
            held = [h[rest:] for h in held]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _tables(blocks: int, radius: int) -> list[tuple[int, int]]:
    """(number, bit mask) of every choice of ``blocks - radius`` blocks."""
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    return [(n, sum(masks[k] for k in chosen)) for n, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long), component_id of every row of ``docs``.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Rows with a null id
    are linked with nothing and keep a null component. Repeated rows share fingerprint and component;
    rows that share an id are one node. Other columns are ignored; an empty table gives no rows.
    """
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    scratch = Scratch(docs.sparkSession, "simhash")
    sig = scratch.keep(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
        .mapInArrow(_fingerprints(words), "doc_id bigint, fp bigint"), "fingerprints")
    classes = scratch.keep(sig.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes", narrow=True)

    # a shard's key: its table and the fingerprint's bits there, mixed (a clash of keys only adds company)
    tables = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(_signed(m)).cast("bigint").alias("m")) for n, m in _tables(blocks, radius)])
    placed = (classes.select("fp", "rep", F.explode(tables).alias("t"))
              .select(F.xxhash64("t.n", F.col("fp").bitwiseAND(F.col("t.m"))).alias("key"), "fp", "rep"))
    large = scratch.keep(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree)
                         .select(F.col("key").alias("k"), F.ceil(F.col("n") / tree).cast("int").alias("trees")), "large-shards", narrow=True)
    sharded = (placed.join(large, placed["key"] == large["k"], "left")
               .select("key", F.coalesce("trees", F.lit(1)).alias("trees"), "fp", "rep")
               .withColumn("tree", F.pmod(F.xxhash64("fp"), "trees").cast("int")))

    def links(rows: DataFrame) -> DataFrame:
        return (rows.select("key", "tree", "own", "fp", "rep", "comp").repartition("key", "tree")
                .sortWithinPartitions("key", "tree", "own").mapInArrow(_links(radius), "a bigint, b bigint"))

    first = links(sharded.select("*", F.lit(0).alias("own"), F.col("rep").alias("comp")))
    # an id with several texts is one node: it is linked with the representatives of all of them
    several = scratch.keep(sig.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                           .where("lo <> hi").select(F.col("doc_id").alias("a")), "several-texts", narrow=True)
    same = sig.join(several, sig["doc_id"] == several["a"]).join(classes, "fp").select("a", F.col("rep").alias("b"))
    edges = scratch.keep(first.unionByName(same), "links", narrow=True)
    found = scratch.keep(connected_components(edges, scratch), "components")

    # between the trees of one shard: who isn't of its largest component searches all of them
    cut = scratch.keep(sharded.where("trees > 1").join(found, sharded["rep"] == found["node"], "left")
                       .select("key", "tree", "trees", "fp", "rep", F.coalesce("component", "rep").alias("comp")), "cut-shards")
    parts = cut.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = scratch.keep(parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("c"))
                        .where("c > 1").select(F.col("key").alias("k"), "main"), "largest", narrow=True)
    open_rows = cut.join(main, cut["key"] == main["k"]).drop("k")
    search = open_rows.where("comp <> main").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    second = links(
        open_rows.select("key", "tree", F.lit(0).alias("own"), "fp", "rep", "comp")
        .unionByName(search.where("`to` <> tree").select("key", F.col("to").alias("tree"), F.lit(1).alias("own"), "fp", "rep", "comp")))
    more = scratch.keep(second, "further-links", narrow=True)
    if not more.isEmpty():
        found = scratch.keep(connected_components(
            more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch), "all-components")
    scratch.drop(cut)
    out = sig.join(classes, "fp", "left")
    return out.join(found, out["rep"] == found["node"], "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
