"""Repair of conversation structure: the cheapest edits, found once per shared ending.

Every conversation becomes a signature of one letter per row: the row's role initial and fault. What
the rest of a conversation costs depends on its remaining letters and on the grammar state only, so
equal endings share their work: the distinct signatures of all conversations, read from the end, are
the paths of an automaton whose nodes are the distinct endings. Spark sorts the reversed signatures
by range, so a task meets the nodes of its range depth first and computes cost and best edit once
per node and grammar state; only the path at a range's border is computed twice.

Costs of the four states relative to the least one take few values, so a node holds the number of
such a profile and a base cost, and the step from one profile over a letter to the next is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, slices

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar `(s?(ua)+)?`: 0 start, 1 after s, 2 after u, 3 after a. Complete in 0 and 3.
COMPLETE = (0, 3)
NEXT_ROLE = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
TAKES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Letters of a signature: role initial (o: another), upper case where truncated; x must be deleted.
MUST_GO = "x"
#: Repaired rows are emitted in batches of so many characters or rows.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 2000


class Automaton:
    """Costs and best edits of the nodes of one path, shared by all signatures with the same ending."""

    def __init__(self):
        self._profiles: dict[tuple, int] = {}
        self._steps: dict[tuple[int, str], tuple] = {}
        self._costs: list[tuple] = []
        end, letters = self._closed([(0, "") if q in COMPLETE else None for q in range(4)])
        self._path, self._letters = [(self._profile(end), 0)], [letters]
        self._ending = ""
        self.nodes = 0

    def _profile(self, costs: tuple) -> int:
        if costs not in self._profiles:
            self._profiles[costs] = len(self._costs)
            self._costs.append(costs)
        return self._profiles[costs]

    @staticmethod
    def _closed(best: list) -> tuple[tuple, str]:
        """Costs and first edits of the states when rows may be inserted first; ties: the least letter."""
        changed = True
        while changed:
            changed = False
            for q in range(4):
                after = best[AFTER[q]]
                if after and (best[q] is None or (after[0] + INSERT, "I") < best[q]):
                    best[q], changed = (after[0] + INSERT, "I"), True
        return tuple(c for c, _ in best), [x for _, x in best]

    def _step(self, profile: int, letter: str) -> tuple[int, int, list[str]]:
        """(profile, added base cost, edit per state) of the node that puts ``letter`` before ``profile``."""
        known = self._steps.get((profile, letter))
        if known is None:
            rest, best = self._costs[profile], []
            extra = TRUNCATED if letter.isupper() else 0
            for q in range(4):
                choices = [(DELETE + rest[q], "D")]
                if letter != MUST_GO:
                    choices.append((REROLE + extra + rest[AFTER[q]], "R"))
                    to = TAKES.get((q, letter.lower()))
                    if to is not None:
                        choices.append((KEEP + extra + rest[to], "K"))
                best.append(min(choices))
            costs, letters = self._closed(best)
            least = min(costs)
            known = self._steps[profile, letter] = (self._profile(tuple(c - least for c in costs)), least, letters)
        return known

    def audit(self, ending_first: str) -> tuple[int, str]:
        """(cost, edits) of the signature given in reverse. Nodes shared with the previous one are reused."""
        same, top = 0, min(len(ending_first), len(self._ending))
        while same < top and ending_first[same] == self._ending[same]:
            same += 1
        del self._path[same + 1 :], self._letters[same + 1 :]
        for letter in ending_first[same:]:
            profile, base = self._path[-1]
            profile, added, letters = self._step(profile, letter)
            self._path.append((profile, base + added))
            self._letters.append(letters)
            self.nodes += 1
        self._ending = ending_first
        edits, q, left = [], 0, len(ending_first)
        while True:
            edit = self._letters[left][q]
            if not edit:
                break
            edits.append(edit)
            if edit == "K":
                q = TAKES[q, ending_first[left - 1].lower()]
            elif edit != "D":
                q = AFTER[q]
            if edit != "I":
                left -= 1
        profile, base = self._path[-1]
        return base + self._costs[profile][0], "".join(edits)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted reversed signatures -> cost and edits."""
    automaton = Automaton()
    for batch in batches:
        found = [automaton.audit(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            names=["ending", "cost", "audit"])


REPORT = ("conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, ending string")
_LEGAL = {"su", "ua", "au"}


class _Report:
    """Counts and signature of one conversation, fed row by row: a byte a row is held."""

    def __init__(self, conv):
        self.conv, self.signature, self.last = conv, bytearray(), None
        self.least = self.most = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, fault: str) -> None:
        if turn is not None and turn != self.most:  # rows come by turn
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        if self.last is not None and self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        letter = initial if initial in ("s", "u", "a") else "o"
        if fault == "t":
            self.truncated, letter = self.truncated + 1, letter.upper()
        elif fault:
            letter = MUST_GO
            self.blank, self.duplicate = self.blank + (fault == "b"), self.duplicate + (fault == "d")
        self.signature += letter.encode()

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal,
                self.signature[::-1].decode())


def _reports(kind: str):
    schema = pa.schema([("conv_id", pa.string() if kind == "string" else pa.int64())]
                       + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")] + [("ending", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []
        for batch in batches:
            for conv, turn, initial, fault, gone in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.row())
                    current = _Report(conv)
                if not gone:
                    current.add(turn, initial, fault)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(current.row(), schema)], schema=schema)

    return run


def _repairs(kind: str):
    schema = pa.schema([("conv_id", pa.string() if kind == "string" else pa.int64()), ("pos", pa.int64()),
                        ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        audit, at, state, pos, conv, held = "", 0, 0, 0, None, 0

        def emit(edit, role, text):
            nonlocal pos, held
            out.append((conv, pos, edit, role, text))
            pos, held = pos + 1, held + len(text)

        def inserts():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                emit("I", NEXT_ROLE[state], "")
                at, state = at + 1, AFTER[state]

        def full():
            nonlocal out, held
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, held = [], 0
            return batch

        for batch in slices(batches):
            for c, is_row, edits, role, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not is_row:  # a conversation begins with its edits
                    inserts()  # what the one before still lacks
                    conv, audit, at, state, pos = c, edits, 0, 0, 0
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    emit(edit, role, text)
                    state = TAKES[state, role[:1]]
                elif edit == "R":
                    emit(edit, NEXT_ROLE[state], text)
                    state = AFTER[state]
                if len(out) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield full()
        inserts()
        if out:
            yield full()

    return run


def _digests(kind: str):
    """Consecutive repaired rows of a conversation -> digest of its lines."""
    schema = pa.schema([("conv_id", pa.string() if kind == "string" else pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, current, done = None, None, []

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        for batch in slices(batches):
            for conv, pos, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if pos == 0:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    digest, current = hashlib.sha256(), conv
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield flushed()
                done = []
        if digest is not None:
            done.append((current, digest.hexdigest()))
            yield flushed()

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """Planted damage: crc32 of `conv_id:turn` modulo 20 drops a row (0), empties its text (1), removes
    its full stops, exclamation and question marks (2), repeats it (3) or makes it the user's (4).
    A dropped row stays with ``gone`` set, so that its conversation is still known."""
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _plain(conversations: DataFrame) -> DataFrame:
    kind = "bigint" if conversations.schema["conv_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    return conversations.select(
        F.col("conv_id").cast(kind).alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _fault(seen: Column) -> Column:
    """First fault: b blank, d duplicate, t truncated."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", "b").when(seen > 1, "d").when(~last.isin(".", "!", "?"), "t").otherwise("")


def _order() -> tuple[Column, ...]:
    return F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")


def repair(conversations: DataFrame, damage: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired rows) of a table conv_id, turn, role, text.

    ``reports`` has a row per conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``repaired`` has conv_id, pos (from 0), edit (K, R or I), role, text; a conversation's rows are
    consecutive and in order within a partition.

    A null role or text counts as one blank. Rows are taken by turn, nulls first; rows of the same turn
    by role, text. A role with no letter at all can't be kept. Rows without a conv_id are one conversation.
    Repeated rows are duplicates of the first. A table without rows gives none; other columns are ignored.

    The digest and the edits of a conversation are one value each, so its rows meet in one task, however
    many they are: it sorts on disk, reads them as a stream and holds a byte for each. Everything else
    is spread by signature.
    """
    scratch = Scratch(conversations.sparkSession, "conversations")
    rows = _plain(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = damaged(rows) if damage else rows.select("*", F.lit(False).alias("gone"), F.lit(0).alias("copy"))
    # one exchange by conversation serves the window and the stream
    placed = rows.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    letters = (placed.withColumn("fault", _fault(seen)).sortWithinPartitions("conv_id", *_order())
               .select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "gone"))
    reports = scratch.keep(letters.mapInArrow(_reports(kind), REPORT.format(kind=kind)), "reports")
    audits = scratch.keep(reports.select("ending").distinct().repartitionByRange("ending").sortWithinPartitions("ending")
                          .mapInArrow(_audits, "ending string, cost bigint, audit string"), "audits")
    whole = scratch.keep(reports.join(audits, "ending").drop("ending"), "whole")

    begin = whole.select("conv_id", F.lit(False).alias("is_row"), "audit", F.lit(None).cast("bigint").alias("turn"),
                         F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copy"))
    body = rows.where(~F.col("gone")).select("conv_id", F.lit(True).alias("is_row"), F.lit("").alias("audit"),
                                             "turn", "role", "text", "copy")
    stream = (begin.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *_order())
              .select("conv_id", "is_row", "audit", "role", "text"))
    repaired = stream.mapInArrow(_repairs(kind), f"conv_id {kind}, pos bigint, edit string, role string, text string")
    return whole, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``repair``'s rows: SHA-256 of `role:text`, joined by line feeds."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.mapInArrow(_digests(kind), f"conv_id {kind}, repaired_sha256 string")
