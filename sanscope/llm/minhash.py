"""Near-duplicate components by MinHash bands and odd sketches, links confirmed on full sets.

Each distinct shingle set gets MinHash samples. Bands of samples give bucket keys; the samples
are also folded into a parity bitmap (odd sketch) whose XOR with another bitmap counts the
samples that differ, so a candidate's similarity is known to about 0.02 before its text is read.

A bucket is never expanded into all pairs. First every member is compared with a few leaders of its
bucket, of all its buckets' leaders the nearest few are confirmed, and the links are merged; only members of buckets that still hold several
components are compared further, across components only. The bitmaps are compared within the
joins, so pairs that can't be links are never emitted. Every pair with a similarity of the threshold or more that shares a bucket (all but
about 3 in 10 million) and is not yet connected is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, connected_components, giving_back, slices, text_or_empty
from .hashing import U, constants, mix, shingle_sets, text_bytes

WORDS, PERCENT = 5, 85
ROWS, BANDS = 6, 32
#: The first ROWS * BANDS samples make the bands, all of them the bitmaps.
SAMPLES = 512
SKETCH_BITS = 1024
SKETCH = [f"o{k}" for k in range(SKETCH_BITS // 64)]
#: Leaders that a bucket has at most in one turn.
LEADERS = 8
#: Leaders of other components that a member is confirmed against in one turn, the nearest by sketch: the texts
#: read in a turn grow with the members. What is left open by that, later turns compare.
NEAREST = 3
#: Pairs still open per bucket member up to which they are all compared by sketch; with more, other
#: leaders are tried first. Either way every open pair is compared in the end.
FEW = 500
#: How far below the threshold an estimate may lie before a pair is dropped unread: four and a half
#: standard deviations of the estimate (0.016 by the samples, 0.007 by the bitmap).
SLACK = 0.08


def most_differing_bits(percent: int) -> int:
    """XOR population count expected at the threshold minus SLACK."""
    differing = 2 * SAMPLES * (1 - percent / 100 + SLACK)
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing))


_FACTORS = (constants(SAMPLES, 3) >> U(31)).astype(np.uint32) | np.uint32(1)
_PLACE = constants(SAMPLES, 4)
_BAND = constants(BANDS, 5)


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash: for each factor, the least product modulo 2**32."""
    x = (shingles ^ (shingles >> U(32))).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, np.multiply.outer(x[at : at + 512], _FACTORS).min(axis=0), out=out)
    return out


def bands_and_sketches(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (documents x bands) and odd sketches (documents x words of 64 bits)."""
    spread = mix(sig.astype(U) + _PLACE)
    keys = mix(spread[:, : ROWS * BANDS].reshape(len(sig), BANDS, ROWS).sum(axis=2, dtype=U) + _BAND).view(np.int64)
    bit = (spread % U(SKETCH_BITS)).astype(np.int64) + np.arange(len(sig))[:, None] * SKETCH_BITS
    odd = np.bincount(bit.ravel(), minlength=len(sig) * SKETCH_BITS).astype(np.uint8) & 1
    return keys, np.packbits(odd.reshape(len(sig), SKETCH_BITS), axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        part = [t.lower() for t in text_bytes(batch.column(1))]  # bytes: only A-Z change
        n, cls, sig = [], [], np.zeros((len(part), SAMPLES), np.uint32)
        for k, s in enumerate(shingle_sets(part, WORDS)):
            n.append(len(s))
            cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig[k] = samples(s)
        keys, odd = bands_and_sketches(sig)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), flat]
            + [pa.array(np.ascontiguousarray(odd[:, k])) for k in range(len(SKETCH))],
            names=["doc_id", "n_shingles", "cls", "bands", *SKETCH])


SIGNATURE = ("doc_id bigint, n_shingles bigint, cls binary, bands array<bigint>, "
             + ", ".join(f"{c} bigint" for c in SKETCH))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ta, tb = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            ok = np.zeros(len(a), bool)
            left = shingle_sets([t.lower() for t in ta], WORDS)
            right = shingle_sets([t.lower() for t in tb], WORDS)
            for k, (x, y) in enumerate(zip(left, right)):
                both = len(x) + len(y)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    union = len(np.union1d(x, y))
                    ok[k] = 100 * (both - union) >= percent * union
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return run


def _apart(left: str, right: str):
    """Differing bits of two sketches."""
    total = F.lit(0)
    for c in SKETCH:
        total = total + F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}")))
    return total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    A text's set is its distinct 5-word shingles (A-Z lower-cased, words split at white space);
    with fewer words the whole sequence is one shingle. Two documents are linked if
    100 * intersection >= percent * union. ``component_id`` is the least doc_id reachable.
    Null, empty and blank texts have an empty set and are linked with nothing. Rows with a null
    id are linked with nothing and keep a null component. Repeated rows share id and component;
    rows that share an id are one node. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sig = scratch.keep(texts.mapInArrow(giving_back(_signatures), SIGNATURE), "signatures")

    # texts with the same set are one class, represented by their least id
    live = sig.where("cls is not null and doc_id is not null")
    classes = scratch.keep(live.groupBy("cls").agg(F.min("doc_id").alias("rep")), "classes", narrow=True)
    reps = (live.join(classes.withColumn("doc_id", F.col("rep")), ["cls", "doc_id"])
            .dropDuplicates(["doc_id", "cls"]).select("rep", F.col("n_shingles").alias("n"), "bands", *SKETCH))
    reps = scratch.keep(reps, "representatives")
    placed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    # written first: a join of plain exchanges can split the rows of a hot bucket
    shared = scratch.keep(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-keys", narrow=True)
    # ``low``: 31 bits of each band's key, by which a pair of one bucket knows an earlier common one
    low = F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")).cast("int")).alias("low")
    members = scratch.keep(placed.join(shared, "key").join(reps.select("rep", "n", low, *SKETCH), "rep"), "members")
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    # the same plan at every size: the texts are shuffled once
    bodies = scratch.keep(texts.join(involved.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "bodies")
    limit = most_differing_bits(percent)

    def near(left: DataFrame, right: DataFrame, whole: bool = False) -> DataFrame:
        """Pairs (a, b) of one bucket but different components whose sketches agree well enough: the NEAREST on
        the right for each on the left. When ``whole`` buckets are compared, all pairs, each emitted in the
        first bucket it shares only."""
        x, y = left.alias("x"), right.alias("y")
        meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & (_apart("x", "y") <= limit)
        meet = meet & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))  # else no link, whatever they share
        if whole:
            meet = meet & (F.col("x.rep") < F.col("y.rep")) & F.expr(
                "forall(zip_with(slice(x.low, 1, x.band), slice(y.low, 1, x.band), (p, q) -> p <> q), t -> t)")
            return x.join(y, meet).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
        met = x.join(y, meet).select(F.col("x.rep").alias("rep"), F.col("y.rep").alias("leader"), _apart("x", "y").alias("apart")).distinct()
        place = F.row_number().over(Window.partitionBy("rep").orderBy("apart", "leader"))
        return met.withColumn("place", place).where(F.col("place") <= NEAREST).select(
            F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).where("a <> b").distinct()

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        x, y = bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), bodies.select(
            F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        return scratch.keep(pairs.join(y, "b").join(x, "a").select("a", "b", "ta", "tb")
                            .mapInArrow(giving_back(_confirm(percent)), "a bigint, b bigint"), label)

    state, groups, still_open, few = members.withColumn("comp", F.col("rep")), None, None, 0
    for turn in range(1000):
        if groups is not None:
            merged = scratch.keep(members.join(groups, members["rep"] == groups["node"], "left")
                                  .select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("comp"), "low", *SKETCH), "state")
            sizes = merged.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
            keys = scratch.keep(
                sizes.groupBy("key").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("same"),
                                         F.count(F.lit(1)).alias("c"))
                .where("c > 1").select("key", "m", ((F.col("m") * F.col("m") - F.col("same")) / 2).alias("pairs")), "open", narrow=True)
            rows, held = keys.agg(F.sum("pairs"), F.sum("m")).first()
            if not rows:
                break
            few = FEW * held
            state = scratch.keep(merged.join(keys.select("key"), "key", "left_semi"), "open-members")
        # all open pairs at once if they are few or leaders no longer help; else a few leaders per bucket
        last = groups is not None and (rows <= few or (still_open is not None and rows > still_open / 2))
        if last:
            pairs = near(state, state, whole=True)
        else:
            draw = F.xxhash64(F.lit(turn), "key", "rep")  # every bucket has leaders of its own
            drawn = scratch.keep(state.groupBy("key", F.pmod(draw, F.lit(LEADERS)).alias("slot")).agg(F.min(draw).alias("draw"))
                                 .select("key", "draw"), "drawn", narrow=True)
            leaders = scratch.keep(state.withColumn("draw", draw).join(drawn, ["key", "draw"], "left_semi"), "leaders")
            pairs = near(state, leaders)
        if groups is not None:
            still_open = rows
        links = confirmed(scratch.keep(pairs, "pairs", narrow=True), "links")
        if groups is None or not links.isEmpty():
            if groups is not None:
                links = links.unionByName(groups.select(F.col("component").alias("a"), F.col("node").alias("b")))
            groups = scratch.keep(connected_components(links, scratch), "components")
        if last:
            break
    scratch.drop(bodies, members)
    rep = sig.select("doc_id", "n_shingles", "cls").join(classes, "cls", "left")
    out = rep.join(groups, rep["rep"] == groups["node"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint"))
        .otherwise(F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))
