"""Removal of repeated byte strings by a distributed merge sort of sampled suffixes.

A byte is removed if a 100-byte string that covers it also starts earlier. Sorting the suffixes of
all positions would move about a hundred times the text. Instead the suffixes start at anchors: in
every 100-byte window the 32-byte string with the least hash (the leftmost of equal ones). Equal
windows have their anchor at the same place, so only windows with equal anchors can be equal.

1. Every map task finds the anchors of its texts. An anchor stands for a range of windows, its span.
   Spans that are repeated within the task are removed there but for the first.
2. Anchors meet by anchor hash (a hash of the span travels along, not the text): later copies of a
   whole span are removed; spans whose anchor also occurs with other contexts are contested.
   An anchor that has many contexts in one run is crowded: its spans go on as single windows,
   spread by their content, and only a token per run marks the anchor itself. Anchors are judged
   as a sorted stream that holds three rows of the current one.
3. The texts with contested spans are read once more. Every task sorts its contested suffixes and
   emits front-coded runs (common prefix length and rest). A bucket merges its runs with a loser tree
   that carries common prefix lengths, so no known prefix is compared again, and gets the suffixes
   in order with the lengths that neighbours share. Windows are equal if the suffixes share their
   part right of the anchor and the reversed texts share the part left of it; all but the earliest
   are removed.
4. Removed ranges are joined to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, giving_back, text_or_empty
from .hashing import _BYTE, Powers, U, mix, text_bytes

LENGTH, ANCHOR = 100, 32
#: Text per run, windows per piece of one long text: memory bounds, without effect on the result.
RUN_BYTES, PIECE_BYTES = 3 << 20, 1 << 20
#: Contexts of one anchor within one task from which the anchor is crowded (routing only).
CROWD = 16
#: Suffixes that one merging bucket is planned for.
BUCKET_ROWS = 40_000
SPAN, SPREAD, TOKEN, REMOVED = 0, 1, 2, 3
_POWERS = Powers(0xD6E8FEB86659FD93)
_C1, _C2 = U(0x9FB21C651E98DF25), U(0xA0761D6478BD642F)


def packed(kind, lo, left, width):
    """kind, first window, anchor minus first window, windows minus one; in one integer."""
    return (np.int64(kind) << 61) | (lo.astype(np.int64) << 14) | (left.astype(np.int64) << 7) | width.astype(np.int64)


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return p >> 61, (p >> 14) & ((1 << 47) - 1), (p >> 7) & 127, p & 127


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _POWERS.to(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return total, down


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[0::2], edge[1::2]


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, k: int):
    """(segment, first window, last window, anchor, anchor hash, span hash) of the segments
    data[begin:end]; places count from the start of ``data``."""
    n, w = len(data), length - k + 1
    total, down = _prefix_sums(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U), np.zeros(0, U))
    if n < length:
        return none
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    h *= _C1
    h ^= h >> U(32)
    h *= _C2
    # least hash of each window: prefix and suffix minima within blocks of w, the place in the low bits
    blocks = -(-len(h) // w) + 1
    v = np.full(blocks * w, ~U(127), U)
    v[: len(h)] = h & ~U(127)
    v = (v.reshape(blocks, w) | np.arange(w, dtype=U))
    before = np.minimum.accumulate(v, axis=1).ravel()
    after = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    s = np.arange(m)
    a, b = after[:m], before[w - 1 : w - 1 + m]
    at = np.where((a >> U(7)) <= (b >> U(7)), s // w * w + (a & U(127)).astype(np.int64),
                  (s + w - 1) // w * w + (b & U(127)).astype(np.int64))
    segment = np.repeat(np.arange(len(begin)), np.maximum(end - begin - length + 1, 0))
    windows = np.concatenate([np.arange(x, y - length + 1) for x, y in zip(begin, end)]) if len(begin) else s[:0]
    if not len(windows):
        return none
    at = at[windows]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (segment[1:] != segment[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    lo, hi, at, segment = windows[new], windows[last], at[new], segment[new]
    span = mix((total[hi + length] - total[lo]) * down[lo] + ((at - lo) * 131 + (hi - lo)).astype(U) * _C1)
    return segment, lo, hi, at, mix(h[at]), span


def _batches_of(texts: list[bytes], ids: np.ndarray, length: int) -> Iterator[tuple]:
    """Segments in document order, in chunks of bounded size: (data, begin, end, ids, offset in the text)."""
    parts, who, off, size = [], [], [], 0
    for k in np.argsort(ids, kind="stable"):
        t = texts[k]
        for at in range(0, max(len(t) - length + 1, 0), PIECE_BYTES):
            piece = t[at : at + PIECE_BYTES + length - 1]
            parts.append(piece)
            who.append(ids[k])
            off.append(at)
            size += len(piece)
            if size >= RUN_BYTES:
                yield _chunk(parts, who, off)
                parts, who, off, size = [], [], [], 0
    if parts:
        yield _chunk(parts, who, off)


def _chunk(parts, who, off):
    end = np.cumsum([len(p) for p in parts])
    return (np.frombuffer(b"".join(parts), np.uint8), end - [len(p) for p in parts], end,
            np.array(who, np.int64), np.array(off, np.int64))


def _find_anchors(length: int, k: int, crowd: int):
    """Task of step 1: rows (g, sh, doc_id, p), collapsed within each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), text_bytes(batch.column(1))
            for data, begin, end, who, off in _batches_of(texts, ids, length):
                seg, lo, hi, at, h, sh = anchors(data, begin, end, length, k)
                if not len(seg):
                    continue
                doc, shift = who[seg], off[seg] - begin[seg]
                left, width, lo = at - lo, hi - lo, lo + shift
                order = np.lexsort((np.arange(len(sh)), sh, h))
                same = np.concatenate([[False], (sh[order][1:] == sh[order][:-1]) & (h[order][1:] == h[order][:-1])])
                lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                later = same & ((doc[order] != doc[lead]) | (lo[order] != lo[lead]))
                gone = np.zeros(len(sh), bool)
                gone[order[later]] = True
                # removed ranges: neighbouring ranges of a document become one
                r = np.flatnonzero(gone)
                if len(r):
                    stop = lo[r] + width[r] + 1
                    fresh = np.concatenate([[True], (doc[r][1:] != doc[r][:-1]) | (lo[r][1:] != stop[:-1])])
                    f = np.flatnonzero(fresh)
                    tail = np.concatenate([f[1:], [len(r)]]) - 1
                    rd, rlo, rn = doc[r][f], lo[r][f], stop[tail] - lo[r][f]
                else:
                    rd = rlo = rn = np.zeros(0, np.int64)
                keep = order[~same]
                hk = h[keep]
                group = np.cumsum(np.concatenate([[True], hk[1:] != hk[:-1]])) - 1
                many = np.bincount(group)[group] >= crowd
                g = np.where(many, mix(hk + sh[keep]), hk).view(np.int64)
                p = packed(0, lo[keep], left[keep], width[keep]) | (many.astype(np.int64) << 61)
                tokens = np.unique(hk[many]).view(np.int64)
                zero = np.zeros(len(tokens), np.int64)
                first = np.full(len(tokens), np.iinfo(np.int64).min)  # a token is read before its anchor's spans
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([g, tokens, mix(rd.view(U)).view(np.int64)])),
                    pa.array(np.concatenate([sh[keep].view(np.int64), first, rn])),
                    pa.array(np.concatenate([doc[keep], zero, rd])),
                    pa.array(np.concatenate([p, zero + (TOKEN << 61), packed(REMOVED, rlo, rlo * 0, rlo * 0)])),
                ], names=["g", "sh", "doc_id", "p"])

    return run


def _judge(g: np.ndarray, sh: np.ndarray, doc: np.ndarray, p: np.ndarray, made: np.ndarray) -> pa.RecordBatch:
    """Step 2 for rows sorted by g, sh, doc_id, p: marks (doc_id, p, b); b is the number of
    windows of a removed range and the group of a contested one. ``made``: rows marked before."""
    kind, lo, _, width = unpacked(p)
    out = kind == REMOVED
    live = np.flatnonzero((kind == SPAN) | (kind == SPREAD))
    group = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1
    crowded = np.bincount(group[kind == TOKEN], minlength=group[-1] + 1 if len(group) else 0) > 0
    gl, sl = group[live], sh[live]
    same = np.concatenate([[False], (gl[1:] == gl[:-1]) & (sl[1:] == sl[:-1])]) if len(live) else np.zeros(0, bool)
    lead = live[np.maximum.accumulate(np.where(same, 0, np.arange(len(live))))] if len(live) else live
    later = live[same & ((doc[live] != doc[lead]) | (lo[live] != lo[lead]))]
    first = live[~same]
    several = np.bincount(group[first], minlength=len(crowded)) > 1
    spread = (kind[first] == SPREAD) | crowded[group[first]]
    fight = (spread | several[group[first]]) & ~made[first]
    first, spread = first[fight], spread[fight]
    base = p & ((1 << 61) - 1)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([doc[out], doc[later], doc[first]])),
        pa.array(np.concatenate([p[out], base[later] | (REMOVED << 61), base[first] | (spread.astype(np.int64) << 61)])),
        pa.array(np.concatenate([sh[out], width[later] + 1, g[first]])),
    ], names=["doc_id", "p", "b"])


def _open_end(g: np.ndarray, sh: np.ndarray, p: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the rows to come need of the last anchor: (places, marked before) of its token, its first span and
    the first row of its last span. Three rows stand for it, however often the anchor occurs."""
    last = np.arange(np.searchsorted(g, g[-1]), len(g))
    kind = p[last] >> 61
    token, live = last[kind == TOKEN][:1], last[(kind == SPAN) | (kind == SPREAD)]
    if not len(live):
        return token, made[token]
    ends = np.unique([live[0], live[np.searchsorted(sh[live], sh[live[-1]])]])
    contested = len(token) > 0 or len(ends) > 1 or (p[ends[0]] >> 61) == SPREAD
    return np.concatenate([token, ends]), np.concatenate([made[token], made[ends] | contested])


def _judge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest, marked = None, np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        made = np.zeros(len(cols[0]), bool)
        if rest is not None:
            cols, made = [np.concatenate([a, b]) for a, b in zip(rest, cols)], np.concatenate([marked, made])
        # a carried row has been counted: a removed range isn't carried, a span is marked once
        yield _judge(*cols, made)
        at, marked = _open_end(cols[0], cols[1], cols[3], made)
        rest = [c[at] for c in cols]


def removed_runs(lo: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows lo .. lo+n-1."""
    out: list[list[int]] = []
    order = np.argsort(lo, kind="stable")
    for a, b in zip(lo[order].tolist(), (lo + n - 1 + length)[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _verdict(text: bytes, lo: np.ndarray, n: np.ndarray, length: int) -> tuple[int, int, int, str]:
    runs, kept, at = removed_runs(lo, n, length), hashlib.sha256(), 0
    for a, b in runs:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    while start < n:
        stop = min(n, start + 16)
        x, y = a[start:stop], b[start:stop]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return start + len(x) - (differ.bit_length() + 7) // 8
        start = stop
    return n


class LoserTree:
    """Merges sorted runs of (common prefix with the run's previous string, string, tag).

    Every waiting string keeps the length it shares with the last winner on its path. Of two strings
    that share different lengths with it, the one that shares more comes first, without a look at
    the strings; with equal lengths they are compared from there on only.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.k = 1
        while self.k < len(runs):
            self.k *= 2
        self.head: list = [next(r, None) for r in runs] + [None] * (self.k - len(runs))
        self.same = [0] * self.k
        self.tree = [0] * self.k
        winner = self._build(1)
        self.tree[0] = winner

    def _play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        a, b = self.head[x], self.head[y]
        if a is None or b is None:
            return (x, y) if b is None else (y, x)
        p, q = self.same[x], self.same[y]
        if p != q:
            return (x, y) if p > q else (y, x)
        s, t = a[1], b[1]
        n = common_prefix(s, t, p)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            self.same[y] = n
            return x, y
        self.same[x] = n
        return y, x

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        win, self.tree[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while True:
            win = self.tree[0]
            item = self.head[win]
            if item is None:
                return
            yield self.same[win], item[1], item[2]
            nxt = next(self.runs[win], None)
            self.head[win] = nxt
            self.same[win] = nxt[0] if nxt else 0
            node = (win + self.k) // 2
            while node:
                win, self.tree[node] = self._play(win, self.tree[node])
                node //= 2
            self.tree[0] = win


RUN_COLUMNS = ("common", "rest_len", "rests", "left_len", "lefts", "docs", "ats", "nears", "widths")


def _front_coded(rows: list[tuple]) -> tuple:
    """Columns of a sorted run; a row is (right, left, doc_id, anchor, anchor minus last window, windows minus one)."""
    common, rests, prev = bytearray(), [], b""
    for r in rows:
        c = common_prefix(prev, r[0], 0)
        common.append(c)
        rests.append(r[0][c:])
        prev = r[0]
    lefts = [r[1] for r in rows]
    return (bytes(common), bytes(map(len, rests)), b"".join(rests), bytes(map(len, lefts)), b"".join(lefts),
            np.array([r[2] for r in rows], np.int64).tobytes(), np.array([r[3] for r in rows], np.int64).tobytes(),
            bytes(r[4] for r in rows), bytes(r[5] for r in rows))


def _read_run(cols: dict) -> Iterator[tuple[int, bytes, tuple]]:
    docs, ats = (np.frombuffer(cols[c], np.int64).tolist() for c in ("docs", "ats"))
    prev, at, la = b"", 0, 0
    for k, (c, n, ln) in enumerate(zip(cols["common"], cols["rest_len"], cols["left_len"])):
        prev = prev[:c] + cols["rests"][at : at + n]
        yield c, prev, (cols["lefts"][la : la + ln], docs[k], ats[k], cols["nears"][k], cols["widths"][k])
        at, la = at + n, la + ln


def later_windows(merged: list[tuple[int, bytes, tuple]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, first byte) of every window of the merged suffixes that also starts earlier."""
    n = len(merged)
    shared = np.array([m[0] for m in merged], np.int64)
    doc, at, near, width = (np.array([m[2][c] for m in merged], np.int64) for c in (1, 2, 3, 4))
    lefts = [m[2][0] for m in merged]
    by_left = np.array(sorted(range(n), key=lefts.__getitem__), np.int64)
    shared_left = np.zeros(n, np.int64)
    for i in range(1, n):
        shared_left[i] = common_prefix(lefts[by_left[i - 1]], lefts[by_left[i]], 0)
    age = np.lexsort((at, doc))
    found_doc, found_at = [], []
    for d in range(int(near.min()), int((near + width).max()) + 1):  # the anchor's distance from the window's start
        right = np.cumsum(shared < length - d)
        left = np.empty(n, np.int64)
        left[by_left] = np.cumsum(shared_left < d)
        rows = age[(near[age] <= d) & (d <= near[age] + width[age])]
        _, first, back = np.unique(right[rows] * (n + 1) + left[rows], return_index=True, return_inverse=True)
        lead = rows[first][back]
        late = rows[(doc[rows] != doc[lead]) | (at[rows] != at[lead])]
        found_doc.append(doc[late])
        found_at.append(at[late] - d)
    return np.concatenate(found_doc), np.concatenate(found_at)


def _ranges(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows as ranges (doc_id, first, number)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    f = np.flatnonzero(new)
    last = np.concatenate([f[1:], [len(at)]]).astype(np.int64) - 1
    return doc[f], at[f], at[last] - at[f] + 1 if len(at) else at


SORTED = ("kind int, doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, body binary, "
          "lo array<bigint>, n array<bigint>, bucket bigint, " + ", ".join(f"{c} binary" for c in RUN_COLUMNS))
FINAL, HELD, RUN, RANGE = 0, 1, 2, 3


def _sort_runs(length: int, buckets: int):
    """Task of step 3: final rows, held texts, front-coded runs, ranges removed within the task."""
    blank = {c: None for c in [f.split()[0] for f in SORTED.split(", ")]}
    kinds = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                       ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("body", pa.binary()),
                       ("lo", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("bucket", pa.int64()),
                       *[(c, pa.binary()) for c in RUN_COLUMNS]])

    def emit(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([blank | r for r in rows], schema=kinds)

    def close(todo: dict) -> Iterator[pa.RecordBatch]:
        out, late_doc, late_at = [], [], []
        for bucket, rows in todo.items():
            rows.sort()
            kept, prev = [], None
            for r in rows:  # equal suffixes with equal left parts: only the earliest goes on
                if prev is not None and r[:2] == prev[:2] and r[4:] == prev[4:]:
                    if r[2:4] != prev[2:4]:
                        for d in range(r[4], r[4] + r[5] + 1):
                            late_doc.append(r[2])
                            late_at.append(r[3] - d)
                    continue
                kept.append(r)
                prev = r
            out.append({"kind": RUN, "bucket": bucket, **dict(zip(RUN_COLUMNS, _front_coded(kept)))})
        for d, a, n in zip(*(x.tolist() for x in _ranges(np.array(late_doc, np.int64), np.array(late_at, np.int64)))):
            out.append({"kind": RANGE, "doc_id": d, "lo": [a], "n": [n]})
        if out:
            yield emit(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: dict[int, list] = {}
        size = 0
        for batch in batches:
            rows, held = [], 0
            for doc, text, marks in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2)):
                p, b = (marks.values.field(c).to_numpy() if marks.is_valid else np.zeros(0, np.int64) for c in (0, 1))
                kind, lo, left, width = unpacked(p)
                gone = kind == REMOVED
                if gone.all():
                    rows.append({"kind": FINAL, "doc_id": doc} | dict(zip(
                        ("n_bytes", "n_removed", "n_spans", "kept_sha256"), _verdict(text, lo, b, length))))
                else:
                    rows.append({"kind": HELD, "doc_id": doc, "body": text, "lo": lo[gone], "n": b[gone]})
                    held += len(text)
                    for k in np.flatnonzero(~gone).tolist():
                        a, x, y = int(lo[k] + left[k]), int(lo[k]), int(lo[k] + width[k])
                        if kind[k] == SPAN:
                            right, before, near = text[a : y + length], text[x:a][::-1], a - y
                            todo.setdefault(int(b[k]) % buckets, []).append((right, before, doc, a, near, int(width[k])))
                            size += 1
                        else:
                            for s in range(x, y + 1):
                                right = text[s : s + length]
                                place = int.from_bytes(hashlib.blake2b(right, digest_size=8).digest(), "big")
                                todo.setdefault(place % buckets, []).append((right, b"", doc, s, 0, 0))
                            size += y - x + 1
                if size > 4 * BUCKET_ROWS:
                    yield from close(todo)
                    todo, size = {}, 0
                if held > 2 * RUN_BYTES:
                    yield emit(rows)
                    rows, held = [], 0
            if rows:
                yield emit(rows)
        yield from close(todo)

    return run


def _merge_bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        merged = list(LoserTree([_read_run(r) for r in table.select(RUN_COLUMNS).to_pylist()]))
        doc, at, n = _ranges(*later_windows(merged, length)) if merged else (np.zeros(0, np.int64),) * 3
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "lo": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, lo, n, more in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2),
                                              batch.column(3), batch.column(4)):
                a, b = lo.values.to_numpy(), n.values.to_numpy()
                if more.is_valid:
                    a, b = (np.concatenate([x, more.values.field(c).to_numpy()]) for c, x in ((0, a), (1, b)))
                out.append((doc, *_verdict(text, a, b, length)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 4 + [pa.string()])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 anchor: int = ANCHOR, crowd: int = CROWD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``.

    A byte is removed if a ``length``-byte string covering it also starts earlier (smaller doc_id,
    or the same document and an earlier byte); strings are judged on the input and never cross
    documents. A null or empty text, like any text shorter than ``length``, loses nothing. Ids are
    unique: repeated rows are one document and come back once; rows with a null id are judged as one
    document each and lose nothing. Other columns are ignored; an empty table gives no rows.
    """
    if not 8 <= anchor <= length <= 127 or length - anchor > 100:
        raise ValueError("length and anchor out of range")
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = texts.where("doc_id is not null").mapInArrow(
        giving_back(_find_anchors(length, anchor, crowd)), "g bigint, sh bigint, doc_id bigint, p bigint")
    marks = scratch.keep(
        found.repartition("g").sortWithinPartitions("g", "sh", "doc_id", "p")
        .mapInArrow(giving_back(_judge_sorted), "doc_id bigint, p bigint, b bigint"), "marks")
    kind = F.shiftright("p", 61)
    fights = marks.agg(F.sum(F.when(kind == SPAN, F.lit(1)).when(kind == SPREAD, F.expr("(p & 127) + 1")).otherwise(0))).first()[0]
    buckets = max(1, -(-(fights or 0) // bucket_rows))
    per_doc = marks.groupBy("doc_id").agg(F.collect_list(F.struct("p", "b")).alias("marks"))
    once = texts.join(per_doc, "doc_id", "left").select("doc_id", "text", "marks")
    step = scratch.keep(once.mapInArrow(giving_back(_sort_runs(length, buckets)), SORTED), "sorted")
    merged = (step.where(F.col("kind") == RUN).select("bucket", *RUN_COLUMNS).groupBy("bucket")
              .applyInArrow(_merge_bucket(length), "doc_id bigint, lo bigint, n bigint"))
    local = step.where(F.col("kind") == RANGE).select(
        "doc_id", F.element_at("lo", 1).alias("lo"), F.element_at("n", 1).alias("n"))
    later = merged.unionByName(local).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("more"))
    held = step.where(F.col("kind") == HELD).select("doc_id", "body", "lo", "n").dropDuplicates(["doc_id"])
    done = step.where(F.col("kind") == FINAL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rest = held.join(later, "doc_id", "left").select("doc_id", "body", "lo", "n", "more").mapInArrow(
        giving_back(_finish(length)), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    # repeated rows are one document; rows without an id are one each (none of them is held)
    named = done.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(done.where("doc_id is null")).unionByName(rest)
