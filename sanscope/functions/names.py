"""Scalar name functions: ``Column -> Column`` built from JVM-side expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sanscope import constants as K

# Characters Python's str.strip() removes (Unicode White_Space plus \x1c-\x1f).
# Written with \x{..} escapes so the same class works in Java regex and RE2.
PY_SPACE = (
    r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
STRIP_RE = rf"\A[{PY_SPACE}]+|[{PY_SPACE}]+\z"
# str.splitlines() boundaries: \r\n first, then every single-char separator.
LINE_SPLIT_RE = r"\r\n|[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
EDGE_SPACE_RE = rf"\A[{PY_SPACE}]|[{PY_SPACE}]\z"
# space at both ends, a leading ``*.`` and dots at both ends stay outside the group, which is empty where nothing else is left
VALID_NAME_RE = rf"\A[{PY_SPACE}]*+(?:\*\.)?+\.*+([a-z0-9.*-]*[a-z0-9*-])?\.*+[{PY_SPACE}]*+\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The same characters as PY_SPACE, listed one by one for btrim (a set trim, no regex).
PY_SPACE_CHARS = "".join(
    chr(c) for c in [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def py_strip(col) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends), as a character-set trim."""
    return F.btrim(_c(col), F.lit(PY_SPACE_CHARS))


def normal_text(col) -> Column:
    """strip -> lower -> drop one leading ``*.`` -> strip dots -> must be ``[a-z0-9.*-]+``, else ``""``.

    Each step uses the previous one exactly once, so when the optimizer inlines the expression
    (a filter pushed below its projection) it grows linearly, not multiplicatively."""
    return F.regexp_extract(F.lower(_c(col)), VALID_NAME_RE, 1)


def normalize_domain(col) -> Column:
    """``normal_text``, null where the original returns ``""`` (invalid or blank name)."""
    v = normal_text(col)
    return F.when(v != "", v)


LINE_BREAK_RE = r"[\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def split_names(col) -> Column:
    """``str.splitlines()`` as an array; a trailing empty piece is dropped like Python does.

    ``\\r\\n`` becomes ``\\n``, every other line boundary is translated to ``\\n`` (where there is one: a look
    is cheaper than a translation), then a single-character split. Text and pieces are bound to lambda variables,
    so they are computed once also where no common expressions are shared (generators, filters)."""
    def pieces(text: Column) -> Column:
        plain = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), LINE_BREAKS, "\n" * len(LINE_BREAKS))
        return F.split(F.when(text.rlike(LINE_BREAK_RE), plain).otherwise(text), "\n", -1)

    def without_last_empty(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)

    text = F.array(F.coalesce(_c(col), F.lit("")))
    return F.flatten(F.transform(F.transform(text, pieces), without_last_empty))


def clean_name_basic(col) -> Column:
    """Toolkit variant of a name: stripped and lower-cased; blank -> null. Keeps ``*.``."""
    v = F.lower(py_strip(col))
    return F.when(v != "", v)


def cert_id(min_cert_id="min_cert_id", id_col="id") -> Column:
    """``min_cert_id or id``: 0 and null fall through to ``id``."""
    return F.coalesce(F.nullif(_c(min_cert_id), F.lit(0)), _c(id_col))


def domain_level(col) -> Column:
    """Number of dots in the name (``str.count('.')``)."""
    c = _c(col)
    return (F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))).cast("int")


raw_level = domain_level


#: ISO text that is read: a full date, optionally with a time to the minute, second or fraction and a zone.
ISO_TIME_RE = (r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?"
               r"(Z|[+-][0-9]{2}:?[0-9]{2})?)?\z")
ZONE_RE = r":[0-9]{2}.*(Z|[+-][0-9]{2}:?[0-9]{2})\z"


def utc_time(col) -> Column:
    """Text or a timestamp literal without zone -> the instant it names in UTC, whatever the session zone."""
    c = _c(col)
    return F.try_to_timestamp(F.concat(F.when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00"))).otherwise(c), F.lit("Z")))


def parse_cert_time(col) -> Column:
    """ISO-8601 text (optional ``Z``/offset) -> TIMESTAMP; anything else -> null.

    Naive values are UTC. The result does not depend on the session zone or the date of the run."""
    c = _c(col)
    zoned = F.regexp_replace(c, r"([+-][0-9]{2})([0-9]{2})\z", "$1:$2")
    return F.when(c.rlike(ISO_TIME_RE), F.when(c.rlike(ZONE_RE), F.try_to_timestamp(zoned)).otherwise(utc_time(c)))


def utc_text(col, fmt: str) -> Column:
    """A timestamp printed in UTC, whatever the session zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), _c(col).cast("timestamp_ntz")), fmt)


def iso_date(col) -> Column:
    """``ts.date().isoformat()`` in UTC, or ``""`` for null."""
    return F.coalesce(utc_text(col, "yyyy-MM-dd"), F.lit(""))


def is_active(last_seen, as_of) -> Column:
    """'Vigente' when last_seen is strictly after ``as_of``, else 'Expirado' (null too)."""
    as_of_col = as_of if isinstance(as_of, Column) else utc_time(F.lit(as_of))
    return F.when(_c(last_seen) > as_of_col, F.lit(K.ACTIVE)).otherwise(F.lit(K.EXPIRED))


def like_contains(term) -> Column:
    """``%kw%`` (no escaping: ``%`` and ``_`` in the term stay wildcards)."""
    return F.concat(F.lit("%"), _lit(term), F.lit("%"))


def like_subdomain(term) -> Column:
    """``%.domain``."""
    return F.concat(F.lit("%."), _lit(term))


def like_extended(term) -> Column:
    """``suffix.%.%`` used by the extended search."""
    return F.concat(_lit(term), F.lit(".%.%"))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def labels(col) -> Column:
    """Non-empty dot labels of a name."""
    return F.filter(F.split(_c(col), r"\.", -1), lambda x: x != "")


def has_label(col, label) -> Column:
    """``matches_private_suffix``: ``label`` equals one non-empty label of the name."""
    return F.array_contains(labels(col), _lit(label))


def fallback_private_suffix(col) -> Column:
    """Private part without a suffix list: drop the last label; one label stays as it is."""
    d = normalize_domain(col)
    return F.when(F.instr(d, ".") > 0, F.regexp_replace(d, r"\.[^.]*\z", "")).otherwise(d)


def root_label(col) -> Column:
    """``t.replace('.bo', '').split('.')[0]`` - every ``.bo`` goes, not only the last one."""
    return F.element_at(F.split(F.replace(_c(col), F.lit(".bo"), F.lit("")), r"\.", -1), 1)
