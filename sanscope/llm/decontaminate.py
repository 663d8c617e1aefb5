"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Texts and items are sequences of words (A-Z lower-cased, ASCII punctuation as white space). The CGK
walk reads a sequence with a pointer that moves on or stays by a random bit for (step, word); two
sequences at a small edit distance give outputs at a small Hamming distance. Each repetition
walks with its own bits and compares two sampled output places. The pointers drift apart with the
number of edits, so longer items get more repetitions: as many as the target recall takes.

Windows as long as an item start wherever the text holds word grams of items at their places. The
gram length is such that a text within the allowed edits keeps at least one gram whole; windows with
fewer grams than such a text must keep are left out, so no match is lost. Windows whose sampled places agree with an item are verified by edit distance.
Documents are only mapped, never shuffled; items come in blocks of bounded size.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanscope.session import share_code

from .common import slices, text_or_empty
from .hashing import U, constants, document_words, mix, text_bytes

SIMILARITY = 0.8
REPEATS, PLACES = 24, 2
#: Recall of copies at the limit, and the chance, times the item's words, that one repetition finds such a
#: copy: the measured means were 25 to 31 from 250 to 1,000 words; lower, as copies differ in it.
RECALL, CHANCE = 0.98, 16.0
#: Characters of item text per block; a larger benchmark takes several passes over the documents.
BLOCK_CHARS = 16 << 20
_WORDS = bytes.maketrans((string.ascii_uppercase + string.punctuation).encode(),
                         (string.ascii_lowercase + " " * len(string.punctuation)).encode())
_GRAM = constants(3, 7)


@lru_cache(maxsize=64)
def _steps(repeats: int) -> np.ndarray:
    return constants(repeats, 8)[:, None]


def repeats_of(n: int) -> int:
    """Repetitions for items of n words, REPEATS at least."""
    return max(REPEATS, math.ceil(math.log(1 - RECALL) / math.log(1 - min(CHANCE / n, 0.5))))


def allowed_edits(n: int, similarity: float) -> int:
    """Word edits that leave ``similarity`` of an item of n words."""
    return int(n * (1 - similarity) + 1e-9)


def gram_length(n: int, edits: int) -> int:
    """The longest gram (up to three words) of which ``edits`` edits cannot break all."""
    return max((q for q in (1, 2, 3) if n - q + 1 - q * edits >= 1), default=1)


def grams(h: np.ndarray, q: int) -> np.ndarray:
    if len(h) < q:
        return np.zeros(0, U)
    out = h[: len(h) - q + 1] * _GRAM[0]
    for k in range(1, q):
        out = out + h[k : len(h) - q + 1 + k] * _GRAM[k]
    return mix(out + U(q))


def embed_places(words: np.ndarray, lens: np.ndarray, repeats: int = REPEATS) -> np.ndarray:
    """Keys (repeats x rows): a hash of the sampled places of each repetition's CGK output.

    ``words`` has a row per sequence, zero beyond what it holds; ``lens`` are the nominal lengths. The
    pointer moves every other step on average, so the places are drawn from the first 2 * len steps.
    """
    rows = np.arange(len(words))[None, :]
    at = np.zeros((repeats, len(words)), np.int64)
    step = _steps(repeats)
    steps = np.maximum(2 * lens, 1).astype(U)[None, :]
    picks = [(mix(step + U(k + 1)) % steps).astype(np.int64) for k in range(PLACES)]
    found = [np.zeros((repeats, len(words)), U) for _ in picks]
    wide = np.concatenate([words, np.zeros((len(words), 1), U)], axis=1)
    last = np.minimum(lens, words.shape[1])[None, :]
    for j in range(int(2 * lens.max()) if len(lens) else 0):
        w = wide[rows, np.minimum(at, last)]
        for pick, out in zip(picks, found):
            np.copyto(out, w, where=pick == j)
        at += ((mix(w + step * U(2 * j + 1)) >> U(40)) & U(1)).astype(np.int64)
    key = lens.astype(U)[None, :] + step
    for out in found:
        key = mix(key + out)
    return key


class Items:
    """The items of one block: gram index and LSH tables."""

    def __init__(self, ids: list[int], texts: list[bytes], similarity: float):
        self.similarity = similarity
        self.ids, self.words = [], []
        for at, h, bound in document_words([t.translate(_WORDS) for t in texts]):
            for d in range(len(bound) - 1):
                if bound[d + 1] > bound[d]:
                    self.ids.append(ids[at + d])
                    self.words.append(h[bound[d] : bound[d + 1]])
        self.edits = [allowed_edits(len(w), similarity) for w in self.words]
        place: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for w, e in zip(self.words, self.edits):
            q = gram_length(len(w), e)
            for j, g in enumerate(grams(w, q).tolist()):
                place[q][g].add((j, len(w)))
        self.grams = {q: (np.array(sorted(x), U), x) for q, x in place.items()}
        self.maps = {}
        for q, (keys, _) in self.grams.items():
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> U(44)).astype(np.int64)] = True
            self.maps[q] = seen
        #: for each number of repetitions, the tables of the items that have so many
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for repeats, part in self._parts([len(w) for w in self.words]):
            tables = self.tables.setdefault(repeats, [{} for _ in range(repeats)])
            for table, keys in zip(tables, embed_places(*self._padded([self.words[k] for k in part]), repeats).tolist()):
                for k, key in zip(part, keys):
                    table.setdefault(key, []).append(k)

    @staticmethod
    def _parts(sizes: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(repetitions, places in ``sizes``) in parts of bounded size: up to 1,024 sequences of the least repetitions."""
        alike: dict[int, list[int]] = defaultdict(list)
        for k, n in enumerate(sizes):
            alike[repeats_of(n)].append(k)
        for repeats, ks in alike.items():
            rows = max(1, 1024 * REPEATS // repeats)
            for at in range(0, len(ks), rows):
                yield repeats, ks[at : at + rows]

    @staticmethod
    def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(r) for r in rows], np.int64)
        wide = np.zeros((len(rows), int(lens.max())), U)
        for k, r in enumerate(rows):
            wide[k, : len(r)] = r
        return wide, lens

    def windows(self, h: np.ndarray, bound: np.ndarray) -> set[tuple[int, int, int]]:
        """(document, first word, words) of the item-sized windows that hold enough grams at their places.

        A text within e edits of an item of n words keeps at least n - q + 1 - q * e of its grams of q
        words, and their places give window starts at most 2 * e apart.
        """
        starts: dict[int, list] = defaultdict(list)
        for q, (keys, places) in self.grams.items():
            g = grams(h, q)
            hit = np.flatnonzero(self.maps[q][(g >> U(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(keys, g[hit]), len(keys) - 1)
            hit = hit[keys[k] == g[hit]]
            doc = np.searchsorted(bound, hit, "right") - 1
            for p, d in zip(hit.tolist(), doc.tolist()):
                if p + q <= bound[d + 1]:
                    for j, n in places[int(g[p])]:
                        starts[n].append((d, p - j))
        found = set()
        for n, at in starts.items():
            e = allowed_edits(n, self.similarity)
            q = gram_length(n, e)
            d, s = np.array(sorted(at), np.int64).T
            order = s + d * (4 * e + 1)  # documents lie farther apart than windows of one match
            many = np.searchsorted(order, order + 2 * e, "right") - np.searchsorted(order, order - 2 * e) >= n - q + 1 - q * e
            found.update(zip(d[many].tolist(), np.maximum(s[many], bound[d[many]]).tolist(), [n] * int(many.sum())))
        return found

    def matches(self, h: np.ndarray, bound: np.ndarray) -> dict[tuple[int, int], int]:
        """(document, item) -> least edit distance, for distances that are allowed."""
        best: dict[tuple[int, int], int] = {}
        todo = sorted(self.windows(h, bound))
        for repeats, places in self._parts([n for _, _, n in todo]):
            part = [todo[k] for k in places]
            wide, _ = self._padded([h[s : min(s + n, int(bound[d + 1]))] for d, s, n in part])
            size = np.array([n for _, _, n in part], np.int64)  # the key holds the window's nominal size
            pairs = set()
            for keys, table in zip(embed_places(wide, size, repeats).tolist(), self.tables[repeats]):
                pairs.update((k, item) for k, key in enumerate(keys) for item in table.get(key, ()))
            for k, item in pairs:
                d, s, n = part[k]
                e, w = self.edits[item], self.words[item]
                if best.get((d, item), e + 1) == 0:
                    continue
                lo, hi = max(int(bound[d]), s - e), min(int(bound[d + 1]), s + n + e)
                dist = edit_distance(w, h[lo:hi], e)
                if dist <= min(e, best.get((d, item), e)):
                    best[d, item] = dist
        return best


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> int:
    """Least word edit distance between the item and any stretch of the text; above ``most``, most + 1."""
    n = len(item)
    if len(text) >= n:
        exact = np.flatnonzero(text[: len(text) - n + 1] == item[0])
        if any(np.array_equal(text[s : s + n], item) for s in exact.tolist()):
            return 0
    prev = np.zeros(len(text) + 1, np.int64)  # a match may begin anywhere
    steps = np.arange(len(text) + 1)
    for i in range(1, n + 1):
        cur = np.minimum(prev + 1, np.concatenate([[i], prev[:-1] + (text != item[i - 1])]))
        cur = np.minimum.accumulate(cur - steps) + steps  # insertions along the row
        if cur.min() > most:
            return most + 1
        prev = cur
    return int(min(prev.min(), most + 1))


def _find(items_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, similarity = items_of.value
        items = Items(ids, texts, similarity)
        for batch in batches:
            docs, out = batch.column(0).to_numpy(), []
            for at, h, bound in document_words([t.translate(_WORDS) for t in text_bytes(batch.column(1))]):
                out += [(int(docs[at + d]), items.ids[k], dist, len(items.words[k]))
                        for (d, k), dist in items.matches(h, bound).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)],
                                             names=["doc_id", "item_id", "edits", "words"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> Iterator[tuple[list, list]]:
    """Distinct item ids and texts in blocks of about ``block_chars`` characters: what one pass over the documents holds."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"),
                             text_or_empty(item_text_col).alias("text")).where("item_id is not null and text <> ''").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield [r[0] for r in rows], [r[1].encode() for r in rows]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, all columns as they are; no shuffle.

    Null, empty and wordless texts stay; repeated rows are judged alike.
    """
    spark = docs.sparkSession
    share_code(spark)

    def passing(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, similarity)
            for batch in slices(batches):
                texts = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
                clean = np.ones(len(texts), bool)
                for at, h, bound in document_words([t.translate(_WORDS) for t in texts]):
                    clean[[at + d for d, _ in items.matches(h, bound)]] = False
                yield batch.filter(pa.array(clean))

        return run

    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        docs = docs.mapInArrow(passing(spark.sparkContext.broadcast(block)), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, similarity: each item that a document holds a copy of.

    A copy is a stretch of the document at a word edit distance of at most (1 - similarity) times the
    item's words; ``edits`` is the least. Texts are read whole. Null, empty and wordless documents and
    items match nothing, as do rows with a null id; repeated rows and items are reported once per
    pair; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    share_code(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).where(
        "doc_id is not null")
    found = None
    for ids, words in _blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast((ids, words, similarity))
        part = texts.mapInArrow(_find(shared), "doc_id bigint, item_id bigint, edits bigint, words bigint")
        found = part if found is None else found.unionByName(part)
    return (found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.min("words").alias("words"))
            .select("doc_id", "item_id", "edits", F.round(1 - F.col("edits") / F.col("words"), 6).alias("similarity")))
