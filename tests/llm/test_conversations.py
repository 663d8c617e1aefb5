import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from sanscope.llm import conversations as CV
from sanscope.llm.queries import op11_conversations

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       # columns whose names the operator uses itself
                       T.StructField("copy", T.StringType()), T.StructField("audit", T.StringType()), T.StructField("gone", T.StringType())])
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def frame(spark, rows, slices=3):
    rows = [(*r, "c", "a", None) for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(slices) if rows else spark.createDataFrame([], SCHEMA)


def brute_repair(rows):
    """Cheapest edits of (initial, must go, truncated) rows: every edit tried at every place and state."""
    initials = {0: "u", 1: "u", 2: "a", 3: "u"}
    takes = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def best(k, q, inserted):
        options = [(0, "")] if k == len(rows) and q in (0, 3) else []
        if k < len(rows):
            initial, must, trunc = rows[k]
            c, s = best(k + 1, q, 0)
            options.append((c + 3, "D" + s))
            if not must:
                c, s = best(k + 1, takes[q, initials[q]], 0)
                options.append((c + 2 + trunc, "R" + s))
                if (q, initial) in takes:
                    c, s = best(k + 1, takes[q, initial], 0)
                    options.append((c + trunc, "K" + s))
        if inserted < 4:
            c, s = best(k, takes[q, initials[q]], inserted + 1)
            options.append((c + 2, "I" + s))
        return min(options) if options else (10**9, "")

    return best(0, 0, 0)


def brute(rows, damage=True):
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        out += [] if k == 0 else [(turn, role, text)] * (2 if k == 3 else 1)
    result = {}
    for conv, rs in convs.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marks, faults = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, role, text in rs:
            bare = text.strip(SPACE)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marks.append((role[:1], fault in ("b", "d"), fault == "t"))
        turns = {r[0] for r in rs if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, audit = brute_repair(tuple(marks))
        lines, k, state = [], 0, ""
        for edit in audit:
            wanted = "assistant" if state == "u" else "user"
            if edit == "I":
                lines.append(f"{wanted}:")
            else:
                _, role, text = rs[k]
                k += 1
                if edit == "D":
                    continue
                wanted = role if edit == "K" else wanted
                lines.append(f"{wanted}:{text}")
            state = wanted[0]
        assert k == len(rs) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        result[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["b"], faults["d"], faults["t"], illegal,
                        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


def answers(reports, repaired):
    sha = {r[0]: r[1] for r in CV.digests(repaired).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return {r[0]: (*tuple(r)[1:], sha.get(r[0], nothing)) for r in
            reports.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").collect()}


def made(seed, convs=150):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n", None, "Yes.", "ünï?", "a.b c", "one. ", "two\x85"]
    rows = []
    for c in range(convs):
        n = r.choice([1, 2, 3, 5, 8, 13])
        for t in range(n):
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"])
            turn = None if r.random() < 0.05 else t + (r.random() < 0.1) * r.randrange(4)
            rows.append((c if c else None, turn, role, r.choice(texts)))
    return rows + rows[5:20]


@pytest.mark.parametrize("damage", [False, True])
def test_matches_brute_force(spark, damage):
    rows = made(7 + damage)
    got = answers(*CV.repair(frame(spark, rows), damage=damage))
    assert got == brute(rows, damage)


def test_every_short_signature(spark):
    """All role and fault sequences up to four rows, so that every tie is met."""
    kinds = [("system", "x."), ("user", "y."), ("assistant", "z."), ("tool", "v."), ("user", "cut"), ("assistant", ""), ("user", "y.")]
    rows = []
    for c, combo in enumerate(k for n in range(1, 5) for k in itertools.product(range(len(kinds)), repeat=n)):
        rows += [(c, t, kinds[k][0], kinds[k][1]) for t, k in enumerate(combo)]
    assert answers(*CV.repair(frame(spark, rows))) == brute(rows, damage=False)


def test_conversation_of_dropped_rows_stays(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    reports, repaired = CV.repair(frame(spark, [(5, turn, "user", "x.")]), damage=True)
    assert answers(reports, repaired) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired.count() == 0


def test_empty_table_and_text_ids(spark):
    reports, repaired = CV.repair(frame(spark, []), damage=True)
    assert reports.count() == 0 and repaired.count() == 0
    rows = [("a", 0, "user", "hi."), ("a", 1, "assistant", "yes."), ("b", 0, "assistant", "no.")]
    reports, repaired = CV.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert answers(reports, repaired) == brute(rows, damage=False)


def test_long_conversation_and_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "w" * 300_000 + "." if t == 3 else f"t{t}.") for t in range(5001)]
    reports, repaired = CV.repair(frame(spark, rows))
    r = reports.first()
    assert (r["cost"], len(r["audit"]), r["audit"][-3:]) == (2, 5002, "KKI")
    assert repaired.selectExpr("sum(length(text)) as n").first()[0] == sum(len(x[3]) for x in rows)


def test_endings_are_computed_once():
    r = random.Random(3)
    words = sorted({"".join(r.choice("suaoSUAOx") for _ in range(r.randrange(0, 9))) for _ in range(3000)})
    automaton = CV.Automaton()
    for w in words:
        automaton.audit(w)
    assert automaton.nodes == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_query(spark, sf):
    want = brute([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in op11_conversations(spark, sf).collect()} == want
