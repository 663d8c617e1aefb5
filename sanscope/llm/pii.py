"""Personal data by bootstrapped contextual extraction.

Regular expressions find emails, addresses of machines, card and phone numbers, and secrets (keys of a public
form, values that a name such as password or token is given): the seeds. Every
seed, and every other string that looks like an identifier, is a mention with lexical patterns: the
words before and after it. Spark scores the graph of patterns and mentioned strings in turns, until a turn
accepts no new string: a
pattern is as good as the share of its strings that are known to be of a kind; a string is
believed of a kind as far as its patterns are. Strings above the acceptance level become known and
count in the next turn. Seeds are never taken back.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanscope.session import share_code

from .common import Scratch, giving_back, slices, text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds of the base; the others are found by the method only.
BASE_KINDS, SECRET = KINDS[:4], 4
#: Strings a pattern needs to count, belief from which a string is accepted.
SUPPORT, ACCEPT = 5, 0.9
#: Strings of unknown kind that every pattern is taken to have beside its own.
DOUBT = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|AKIA|ASIA")
#: Strings that may be identifiers the seed patterns miss.
_LOOSE = re.compile(r"[^\s@<>()\[\]\",;:]+@[^\s@<>()\[\]\",;:]+|(?<![\w.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])"
                    r"|(?<![\w.])\+?\(?[0-9][0-9 ().:/-]{5,}[0-9](?!\w)")
#: Access keys of a public form, and values given to a name that says they are secret.
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_NAMED = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?([A-Za-z0-9+/_-]{12,})", re.I)
#: Strings that may be secrets; they hold letters and digits.
_CODE = re.compile(r"(?<![\w/.+-])[A-Za-z0-9_+-]{16,}(?![\w/])")
_CONTEXT = re.compile(r"[^\W\d_]+|[:=#]")
#: A word further than this from a mention is no context of it.
CONTEXT_CHARS = 60


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; kinds count from 0, ends are exclusive."""
    if not _ANY.search(text):
        return []
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def secret_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each seed of the kind secret, in order."""
    out = {m.span() for m in _KEY.finditer(text)} | {m.span(1) for m in _NAMED.finditer(text) if _mixed(m[1])}
    return sorted(out)


def looks_like(s: str) -> list[int]:
    """The kinds that an unknown string may be of."""
    digits = sum(c.isdigit() for c in s)
    kinds = [0] if "@" in s else []
    if "@" not in s and (s.count(".") == 3 or s.count(":") >= 2) and "(" not in s and " " not in s:
        kinds.append(1)
    if 12 <= digits <= 19 and not kinds:
        kinds.append(2)
    if 7 <= digits <= 15 and not kinds:
        kinds.append(3)
    return kinds


def patterns(text: str, start: int, end: int) -> list[str]:
    """The one and the two words before a mention, and the word after it."""
    before = [w.lower() for w in _CONTEXT.findall(text[max(0, start - CONTEXT_CHARS) : start])[-2:]]
    after = [w.lower() for w in _CONTEXT.findall(text[end : end + CONTEXT_CHARS])[:1]]
    out = ["1<" + before[-1]] if before else []
    if len(before) == 2:
        out.append("2<" + " ".join(before))
    return out + ["1>" + w for w in after]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same characters as spans in order that don't overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _meets(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the merged spans shares a character with [a, b)."""
    k = bisect_left(taken, (b, 0))
    return k > 0 and taken[k - 1][1] > a


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds (one kind, known) and loose strings outside them (a row for each possible kind)."""
    out = [{"kind": k, "a": a, "b": b, "known": True, "what": text[a:b].lower(), "patterns": patterns(text, a, b)}
           for k, a, b in base]
    if not _ANY.search(text):
        return out
    def add(kind: int, a: int, b: int, known: bool) -> None:
        out.append({"kind": kind, "a": a, "b": b, "known": known, "what": text[a:b].lower(), "patterns": patterns(text, a, b)})

    taken = _merged([(a, b) for _, a, b in base])
    i = 0
    secrets = [s for s in secret_spans(text) if not _meets(taken, *s)]
    for a, b in secrets:
        add(SECRET, a, b, True)
    taken = _merged(taken + secrets)
    for m in _CODE.finditer(text):
        if _mixed(m[0]) and not _meets(taken, *m.span()):
            add(SECRET, *m.span(), False)
    for m in _LOOSE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".-:/ ":
            b -= 1
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        for k in looks_like(text[a:b]):
            add(k, a, b, False)
    return out


SPAN = "struct<k:int,a:bigint,b:bigint>"
MENTION = "struct<kind:int,a:bigint,b:bigint,known:boolean,what:string,patterns:array<string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("k", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    mention = pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("known", pa.bool_()),
                         ("what", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in slices(batches):
        spans, found = [], []
        for text in batch.column(2).to_pylist():
            base = base_spans(text)
            spans.append([{"k": k, "a": a, "b": b} for k, a, b in base])
            found.append(mentions(text, base))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(mention))],
            names=["row", "doc_id", "base", "mentions"])


def believed_strings(found: DataFrame, scratch: Scratch, turns: int | None = None, support: int = SUPPORT,
                     accept: float = ACCEPT) -> DataFrame:
    """(what, kind) of the unknown strings that the scored graph accepts.

    ``found`` has one row per mention: what, kind, known, patterns. Edges are distinct pairs of a
    pattern and a string, so a string repeated in a third of all documents counts once; sums per
    pattern and per string are partial aggregates.
    """
    edges = scratch.keep(found.select("what", "kind", "known", F.explode("patterns").alias("pattern"))
                         .groupBy("pattern", "what", "kind").agg(F.max("known").alias("known")), "edges")
    known, accepted, turn = None, 0, 0
    while turns is None or turn < turns:
        e = edges.withColumn("belief", F.col("known").cast("double"))
        if known is not None:
            e = (edges.join(known, ["what", "kind"], "left")
                 .withColumn("belief", F.when(F.col("known"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0)))))
        # strings of a pattern: a string counts once, whatever kinds it may be of
        size = e.groupBy("pattern", "what").agg(F.max("belief").alias("x")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        good = e.groupBy("pattern", "kind").agg(F.sum("belief").alias("s"), F.sum((F.col("belief") > 0).cast("int")).alias("k")).where(
            F.col("k") >= support)
        scores = scratch.keep(good.join(size, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + DOUBT)).alias("w")), "patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("w"), F.lit(1e-9)))))
        known = scratch.keep(
            edges.where("not known").join(scores, ["pattern", "kind"]).groupBy("what", "kind").agg((1 - doubt).alias("belief"))
            .where(F.col("belief") >= accept), "known")
        turn += 1
        if turns is None:
            before, accepted = accepted, known.count()
            if accepted <= before:
                break
    return known.select("what", "kind")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", turns: int | None = None,
             support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base and spans of every row: arrays of (k, a, b), kind and code points, end exclusive.

    ``base`` holds the spans of the regular expressions for BASE_KINDS, ``spans`` also secrets and the discovered
    ones. Null and empty texts have none. Repeated rows and rows with a null id each get their spans; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    share_code(spark)
    scratch = Scratch(spark, "pii")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
                        text_or_empty(text_col).alias("text"))
    scanned = scratch.keep(texts.mapInArrow(giving_back(_scan), f"row bigint, doc_id bigint, base array<{SPAN}>, mentions array<{MENTION}>"), "scanned")
    found = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    accepted = believed_strings(found, scratch, turns, support, accept)
    # the least kind wins where a string is accepted as several
    accepted = accepted.groupBy("what").agg(F.min("kind").alias("k"))
    more = (found.where("not known").join(accepted, "what").where("kind = k").select("row", F.struct("k", "a", "b").alias("s"))
            .groupBy("row").agg(F.collect_list("s").alias("more")))
    seeds = F.expr(f"transform(filter(mentions, m -> m.known and m.kind = {SECRET}), m -> struct(m.kind as k, m.a as a, m.b as b))")
    return (scanned.withColumn("seeds", seeds).drop("mentions").join(more, "row", "left")
            .select("doc_id", "base", F.array_sort(F.concat("base", "seeds", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))).alias("spans")))


def span_text(col: str):
    """kind:start:end of every span, joined by commas."""
    return F.expr(f"""array_join(transform({col}, s -> concat(element_at(array({', '.join(f"'{k}'" for k in KINDS)}), s.k + 1),
        ':', cast(s.a as string), ':', cast(s.b as string))), ',')""")
