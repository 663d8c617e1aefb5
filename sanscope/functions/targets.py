"""Target checks and small per-target expressions (all ``Column -> Column``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sanscope import constants as K
from sanscope.functions.names import _c, py_strip

# FIXED VALUES: the host-name rule of the toolkit (Java regex has the look-arounds)
DOMAIN_RE = r"\A(?=.{1,253}\z)(?!-)([A-Za-z0-9-]{1,63}(?<!-)\.)+[A-Za-z0-9-]{1,63}(?<!-)\z"
ASN_RE = r"(?i)\AAS[0-9]+\z"
URL_PREFIXES = ("http://", "https://")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
IPV4_RE = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"
_H = r"[0-9A-Fa-f]{1,4}"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV6_RE = (
    r"\A(?:"
    rf"(?:{_H}:){{7}}{_H}"
    rf"|(?:{_H}:){{1,7}}:"
    rf"|(?:{_H}:){{1,6}}:{_H}"
    rf"|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}"
    rf"|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}"
    rf"|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}"
    rf"|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}"
    rf"|{_H}:(?::{_H}){{1,6}}"
    rf"|:(?:(?::{_H}){{1,7}}|:)"
    rf"|(?:{_H}:){{6}}{_V4}"
    rf"|::(?:{_H}:){{0,5}}{_V4}"
    rf"|(?:{_H}:){{1,5}}:(?:{_H}:){{0,4}}{_V4}"
    r")(?:%[0-9A-Za-z._~-]+)?\z"
)


def validate_target(col) -> Column:
    """struct(value, ok, target_class, error) following the toolkit's host check:
    strip; blank / URL / IP / ASN / host name / invalid, in that order."""
    v = py_strip(col)
    is_url = v.startswith(URL_PREFIXES[0]) | v.startswith(URL_PREFIXES[1])
    cls = (
        F.when(v == "", F.lit(None))
        .when(is_url, F.lit(None))
        .when(v.rlike(IPV4_RE) | v.rlike(IPV6_RE), F.lit("ip"))
        .when(v.rlike(ASN_RE), F.lit("asn"))
        .when(v.rlike(DOMAIN_RE), F.lit("domain"))
    )
    err = (
        F.when(v == "", F.lit(K.MSG_TARGET_REQUIRED))
        .when(is_url, F.lit(K.MSG_NO_URL))
        .when(cls.isNull(), F.lit(K.MSG_BAD_TARGET))
    )
    return F.struct(v.alias("value"), cls.isNotNull().alias("ok"), cls.alias("target_class"), err.alias("error"))


def record_type_ok(col) -> Column:
    """upper(strip(x)) is one of the allowed DNS record types."""
    return F.upper(py_strip(col)).isin(*K.ALLOWED_DNS_TYPES)


def normalize_record_type(col) -> Column:
    return F.upper(py_strip(col))


def target_url(col) -> Column:
    """curl URL: the target itself when it starts with ``http`` (so ``httpbin.org`` too),
    otherwise ``http://`` + target."""
    c = _c(col)
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("http://"), c))


def resolve_link(base, href) -> Column:
    """``urljoin(base, href)`` for the common reference forms: absolute, scheme-relative,
    query-only, fragment-only, empty, root-relative and relative paths with ``.``/``..``."""
    b, h = _c(base) if not isinstance(base, str) else F.lit(base), _c(href)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_nofrag = F.regexp_replace(b, r"#.*$", "")
    base_noquery = F.regexp_replace(base_nofrag, r"\?.*$", "")
    base_path = F.regexp_extract(base_noquery, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/.*)?$", 1)
    base_dir = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"[^/]*$", "")
    rel_path = F.regexp_extract(h, r"^([^?#]*)", 1)
    rel_rest = F.substring(h, F.length(rel_path) + 1, 1 << 30)
    merged = F.when(h.startswith("/"), rel_path).otherwise(F.concat(base_dir, rel_path))
    segs = F.split(F.substring(merged, 2, 1 << 30), "/", -1)
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    tail_dir = F.element_at(segs, -1).isin(".", "..")
    path = F.concat(F.lit("/"), F.array_join(folded, "/"), F.when(tail_dir & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit("")))
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h == "", b)
        .when(h.startswith("#"), F.concat(base_nofrag, h))
        .when(h.startswith("?"), F.concat(base_noquery, h))
        .otherwise(F.concat(origin, path, rel_rest))
    )
