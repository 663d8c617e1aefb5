"""Hard-negative mining with cover trees over norm-augmented vectors.

Every vector gets one more component, the square root of what its squared norm lacks to its shard's largest,
so that all have the same length and inner products order like distances. The rows of a label are dealt
to shards of bounded size; each shard is a cover tree, built once by the task that holds it and written
as a row: nodes with a centre and a covering radius, children within ever smaller radii, rows at the leaves.

For an anchor q, a node with centre c and radius r holds only scores within q*c +- |q|*r. A search takes
nodes from the highest bound down. It follows those that can hold a score inside some window that is still
open and better than what was found, and verifies the rows of leaves by exact integer scores. The
anchors of one label and block go through a tree together, a node seeing those it matters to.

Anchors are a stated query set (ids divisible by 50), broadcast in blocks of bounded size against all shards.
First the shards of the anchors' own labels give the positives, whose scores set the windows; then
all shards give the negatives.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
LOW, HIGH = 50, 95
#: Rows of a shard, that is of one tree.
SHARD = 2048
#: Anchors of a block: what a task gets by broadcast beside its rows.
BLOCK = 4096
#: A node of so few rows is a leaf, and one that the next smaller radius would cut into more pieces than half of them.
LEAF, BASE = 48, 1.3
#: Scores are exact in 64 bits while components stay below this; larger ones aren't vectors of this scale.
LARGEST = 1 << 26


def covers(points: np.ndarray, rows: np.ndarray, radius: float, limit: int) -> list[np.ndarray] | None:
    """Parts of ``rows`` around centres further apart than ``radius`` (a part's first row); None if over ``limit``."""
    centres, distance, nearest = [], np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
    at = 0
    while distance[at] > radius:
        if len(centres) == limit:
            return None
        apart = np.sqrt(np.maximum(((points[rows] - points[rows[at]]) ** 2).sum(axis=1), 0))
        closer = apart < distance
        distance[closer], nearest[closer] = apart[closer], len(centres)
        centres.append(at)
        at = int(distance.argmax())
    parts = []
    for k, c in enumerate(centres):
        own = np.flatnonzero(nearest == k)
        parts.append(rows[np.concatenate([[c], own[own != c]])])
    return parts


class CoverTree:
    """``order``: rows so that each node's are consecutive, its centre first. Node k: rows
    ``first[k]:last[k]``, covering radius ``radius[k]``, children ``child[k]:child_end[k]`` (none: a leaf)."""

    def __init__(self, vectors: np.ndarray):
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        points = np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]) if len(vectors) else np.zeros((0, 1))
        self.order = np.arange(len(points))
        self.first, self.last, self.radius, self.child, self.child_end = [], [], [], [], []
        todo = [(0, len(points), self._node(points, 0, len(points)))]
        while todo:  # breadth first: a node's children are consecutive
            a, b, node = todo.pop(0)
            reach = self.radius[node]
            if b - a <= LEAF or reach <= 0:
                continue
            parts, level = None, reach
            while parts is None or len(parts) == 1:
                level /= BASE
                parts = covers(points, self.order[a:b], level, (b - a) // 2)
                if parts is None:
                    break
            if parts is None:
                continue
            self.order[a:b] = np.concatenate(parts)
            self.child[node] = len(self.first)
            at = a
            for part in parts:
                todo.append((at, at + len(part), self._node(points, at, at + len(part))))
                at += len(part)
            self.child_end[node] = len(self.first)

    def _node(self, points, a: int, b: int) -> int:
        rows = self.order[a:b]
        reach = float(np.sqrt(((points[rows] - points[rows[0]]) ** 2).sum(axis=1).max())) if b > a else 0.0
        self.first.append(a)
        self.last.append(b)
        # rounding must never make a bound too tight
        self.radius.append(reach * (1 + 1e-9))
        self.child.append(0)
        self.child_end.append(0)
        return len(self.first) - 1

    def nodes(self) -> np.ndarray:
        return np.array([self.first, self.last, self.child, self.child_end], np.int64)


class Best:
    """The ``keep`` best (score, least id) of every query, as columns sorted from the best."""

    def __init__(self, queries: int, keep: int):
        self.score = np.full((queries, keep), np.iinfo(np.int64).min)
        self.id = np.full((queries, keep), np.iinfo(np.int64).max)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        keep = self.score.shape[1]
        scores = np.where(allowed, scores, np.iinfo(np.int64).min)
        some = np.flatnonzero((scores >= self.score[query, -1][:, None]).any(axis=1) & allowed.any(axis=1))
        if not len(some):
            return
        query, scores = query[some], scores[some]
        if scores.shape[1] > 4 * keep:  # all that tie with the keep-th best stay in
            edge = np.partition(scores, -keep, axis=1)[:, -keep]
            wanted = np.flatnonzero((scores >= edge[:, None]).any(axis=0))
            if len(wanted) < scores.shape[1]:
                scores, ids = scores[:, wanted], ids[wanted]
        s = np.concatenate([self.score[query], scores], axis=1)
        i = np.concatenate([self.id[query], np.where(scores == np.iinfo(np.int64).min, np.iinfo(np.int64).max, ids[None, :])], axis=1)
        rank = np.lexsort((i, ~s), axis=1)[:, :keep]  # ~: the least number has no negative
        self.score[query] = np.take_along_axis(s, rank, axis=1)
        self.id[query] = np.take_along_axis(i, rank, axis=1)


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, held as doubles."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * np.abs(a).max() * np.abs(b).max() < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def search(order_vectors: np.ndarray, ids: np.ndarray, radius: np.ndarray, nodes: np.ndarray, anchors: np.ndarray,
           low: np.ndarray, high: np.ndarray, best: Best, query: np.ndarray, not_self: np.ndarray) -> int:
    """Offer each anchor's rows with low <= score <= high to ``best``; the number of scores verified.

    ``low``/``high``: anchors x windows, window w of anchor a is query ``query[a, w]``. Rows whose id is
    the anchor's own (``not_self``) are left out.
    """
    if not len(ids) or not len(anchors):
        return 0
    first, last, child, child_end = nodes
    length = np.sqrt((anchors**2).sum(axis=1)) * (1 + 1e-9)
    verified = 0

    def bounds(members: np.ndarray, which: np.ndarray):
        middle = anchors[members] @ order_vectors[first[which]].T
        spread = length[members][:, None] * radius[which][None, :]
        slack = 1e-6 * (1 + np.abs(middle))
        return middle - spread - slack, middle + spread + slack

    def open_for(members: np.ndarray, lo: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Anchors with a window that the node can still better."""
        need = np.maximum(low[members], best.worst()[query[members]])
        return ((up[:, None] >= need) & (lo[:, None] <= high[members])).any(axis=1)

    everyone = np.arange(len(anchors))
    lo, up = bounds(everyone, np.array([0]))
    heap, n = [(-up[:, 0].max(), 0, 0, everyone, lo[:, 0], up[:, 0])], 0
    while heap:
        _, _, node, members, lo, up = heapq.heappop(heap)
        alive = open_for(members, lo, up)
        if not alive.any():
            continue
        members = members[alive]
        if child_end[node] == child[node]:
            part = slice(first[node], last[node])
            scores = scores_of(anchors[members], order_vectors[part])
            verified += scores.size
            for w in range(low.shape[1]):
                fits = (scores >= low[members, w][:, None]) & (scores <= high[members, w][:, None])
                fits &= ids[part][None, :] != not_self[members][:, None]
                best.offer(query[members, w], scores, ids[part], fits)
            continue
        which = np.arange(child[node], child_end[node])
        lo, up = bounds(members, which)
        for k, c in enumerate(which):
            fits = open_for(members, lo[:, k], up[:, k])
            if fits.any():
                n += 1
                heapq.heappush(heap, (-up[fits, k].max(), n, int(c), members[fits], lo[fits, k], up[fits, k]))
    return verified


# -- tasks

def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are finite vectors, their floor(256 x) as whole numbers, padded with zeros to ``dim``)."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    bad = np.asarray(flat.is_null())
    value = np.asarray(flat.fill_null(0.0))
    bad = bad | ~np.isfinite(value)
    with np.errstate(invalid="ignore", over="ignore"):
        value = np.floor(256 * np.where(bad, 0, value))
    bad |= np.abs(value) >= LARGEST
    value[bad] = 0
    begin = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), dim), np.int64)
    out[row, np.arange(len(value)) - begin[row]] = value.astype(np.int64)
    good = np.asarray(column.is_valid()) & (np.bincount(row[bad], minlength=len(sizes)) == 0)
    return good, out


def _quantised(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                good, values = _vectors(part.column(2), dim)
                which = pa.array(np.flatnonzero(good))
                rows = values[good].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(which), part.column(1).take(which), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["vec_id", "label", "v"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int32).reshape(len(rows), dim) if dim else np.zeros((len(rows), 0), np.int32)


TREES = "label bigint, shard int, ids binary, vectors binary, radius binary, nodes binary"


def _trees(dim: int):
    """Rows label, shard, vec_id, v in order of label, shard -> one tree a shard."""

    def tree(label, shard, ids, vectors):
        t = CoverTree(vectors)
        return [label, shard, ids[t.order].tobytes(), np.ascontiguousarray(vectors[t.order]).tobytes(),
                np.array(t.radius).tobytes(), t.nodes().tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []

        def flushed():
            row = tree(*at, np.concatenate(ids), np.concatenate(vectors))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)],
                                              names=["label", "shard", "ids", "vectors", "radius", "nodes"])

        for batch in batches:
            label, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values, found = _matrix(batch.column(3), dim), batch.column(2).to_numpy()
            edge = np.flatnonzero((label[1:] != label[:-1]) | (shard[1:] != shard[:-1])) + 1
            for a, b in zip([0, *edge], [*edge, len(label)]):
                if a == b:
                    continue
                if at is not None and at != (label[a], shard[a]):
                    yield flushed()
                    ids, vectors = [], []
                at = (label[a], shard[a])
                ids.append(found[a:b])
                vectors.append(values[a:b])
        if at is not None:
            yield flushed()

    return run


def _read_tree(row: dict, dim: int):
    vectors = np.frombuffer(row["vectors"], np.int32)
    ids = np.frombuffer(row["ids"], np.int64)
    return (vectors.reshape(len(ids), dim).astype(np.float64), ids, np.frombuffer(row["radius"]),
            np.frombuffer(row["nodes"], np.int64).reshape(4, -1))


def _searches(anchors, dim: int, keep: int, windows: bool):
    """Trees -> best rows per query of the broadcast block: ids, labels, vectors, and with ``windows`` the
    positives' scores (anchors x windows, least long: none). Without, the rows of the anchors' own labels are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, positive = anchors.value
        vectors = vectors.astype(np.float64)
        n, w = positive.shape
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        if windows:  # 50 p <= 100 s <= 95 p, in whole numbers
            none = positive == least
            p = np.where(none, 0, positive)
            low, high = np.where(none, most, -((-LOW * p) // 100)), np.where(none, least, (HIGH * p) // 100)
        else:
            low, high = np.full((n, w), least), np.full((n, w), most)
        best, query = Best(n * w, keep), np.arange(n * w).reshape(n, w)
        order = {x: np.flatnonzero(labels == x) for x in np.unique(labels)}
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                tree = _read_tree(row, dim)
                for label, members in order.items():
                    if (label == row["label"]) != windows:
                        search(*tree, vectors[members], low[members], high[members], best, query[members], ids[members])
        found = best.id != most
        q, _ = np.nonzero(found)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q // w]), pa.array((q % w).astype(np.int32)), pa.array(best.id[found]),
                                              pa.array(best.score[found])], names=["anchor_id", "slot", "vec_id", "score"])

    return run


FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"


def hard_negatives(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(256 x). Anchors are the rows whose id is divisible by ``every``. An
    anchor's positives are its best other rows of its label, its negatives for each of them the best
    rows of other labels with 50 % to 95 % of the positive's score; ties go to the smaller id.

    Rows without an id, label or vector, with a component that is null or not finite, or of 2**26 or more
    after scaling, take no part. Shorter vectors are padded with zeros. Rows that repeat an id, label and
    vector count once; a row with the anchor's id is never its positive or negative, and of several anchors with
    one id the one with the least label and vector asks. Other columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                             F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and label is not null and v is not null")
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    vectors = scratch.keep(rows.mapInArrow(_quantised(dim), "vec_id bigint, label bigint, v binary").distinct(), "vectors")

    # a label's rows are dealt to as many shards as its number asks for
    shards = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    dealt = (vectors.join(scratch.keep(shards, "labels", narrow=True), "label")
             .select("label", F.pmod(F.xxhash64("vec_id", "v"), "shards").cast("int").alias("shard"), "vec_id", "v"))
    trees = scratch.keep(dealt.repartition("label", "shard").sortWithinPartitions("label", "shard").mapInArrow(_trees(dim), TREES), "trees")

    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v")
    blocks = -(-asked.count() // block)
    asked = scratch.keep(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))), "anchors")
    sc = spark.sparkContext
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    parts = []
    for k in range(blocks):  # a block of anchors is bounded; its number follows the table
        local = asked.where(F.col("block") == k).orderBy("label", "vec_id").collect()
        if not local:
            continue
        ids = np.array([r["vec_id"] for r in local], np.int64)
        labels = np.array([r["label"] for r in local], np.int64)
        matrix = _matrix(pa.array([r["v"] for r in local], pa.binary()), dim)
        none = np.full((len(ids), 1), np.iinfo(np.int64).min)
        shared = sc.broadcast((ids, labels, matrix, none))
        near = scratch.keep(
            trees.mapInArrow(_searches(shared, dim, positives, False), FOUND).withColumn("place", F.row_number().over(best))
            .where(F.col("place") <= positives).select("anchor_id", "place", F.col("vec_id").alias("positive_id"),
                                                       F.col("score").alias("positive_score")), f"positives-{k}", narrow=True)
        positive = np.full((len(ids), positives), np.iinfo(np.int64).min)
        at = {x: n for n, x in enumerate(ids.tolist())}
        for r in near.collect():  # at most ``positives`` rows an anchor of the block
            positive[at[r["anchor_id"]], r["place"] - 1] = r["positive_score"]
        asking = sc.broadcast((ids, labels, matrix, positive))
        far = (trees.mapInArrow(_searches(asking, dim, negatives, True), FOUND).withColumn("rank", F.row_number().over(best))
               .where(F.col("rank") <= negatives))
        slot = near.withColumn("slot", F.col("place") - 1).drop("place")
        parts.append(scratch.keep(far.join(slot, ["anchor_id", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), f"negatives-{k}", narrow=True))
        shared.unpersist()
        asking.unpersist()
    if not parts:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return spark.read.schema(parts[0].schema).parquet(*[p.scratch_path for p in parts])
