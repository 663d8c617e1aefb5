"""URL filter with redirect equivalence (DataFrame operations only).

Pages that redirect to each other or name each other canonical are aliases. The links form a
graph over canonical URLs; its connected components carry rule verdicts to pages that no rule
fits. An explicit allow anywhere in a component outweighs its blocks.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanscope.functions.targets import resolve_link

from .common import Scratch, connected_components

ALLOW, BLOCK = "allow", "block"
#: (verdict, host and path) of the production rule set.
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """Canonical form: host, path and query without scheme, fragment and campaign parameters."""
    query = F.coalesce(F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, r"(?<=[?&])utm_[^&]*(&|$)", ""), r"[?&]$", "")
    return F.concat(url_host(url), url_path(url), query)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. A rule fits its host and
    all subdomains if the path starts with the rule's. Of equally long ones an allow comes first."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[0] == ALLOW)):
        rh, slash, rp = r.partition("/")
        fits = ((host == rh) | host.endswith("." + rh)) & path.startswith(slash + rp)
        rule = F.when(fits, F.lit(r)) if rule is None else F.when(fits, F.lit(r)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)) if verdict is None else F.when(fits, F.lit(v)).otherwise(verdict)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``, as the reference forms of URLs say; null if it is empty."""
    href = F.trim(F.regexp_replace(href, "&amp;", "&"))
    return F.when(href != "", resolve_link(base, href))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) for each canonical link and each refresh redirect in the page's own markup, read against its base element."""
    html = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<!--.*?-->|<script\b.*?</script>", "")
    value = r"""["']?([^"'\s>]*)"""
    pages = pages.select(F.col(url_col).alias("url"), html.alias("html"))
    html, its_base = F.col("html"), F.regexp_extract("html", r"(?i)<base\b[^>]*\bhref\s*=\s*" + value, 1)
    tags = pages.select(
        "url", F.coalesce(resolve(F.col("url"), its_base), F.col("url")).alias("base"),
        F.explode(F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"""(?i)^<link\b[^>]*\brel\s*=\s*(?:["'](?:[^"'>]*\s)?canonical[\s"']|canonical[\s>/])"""),
                       F.regexp_extract("tag", r"(?i)\bhref\s*=\s*" + value, 1))
    refresh = F.when(F.col("tag").rlike(r"""(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""),
                     F.regexp_extract("tag", r"""(?i)\burl\s*=\s*['"]?([^"'\s>;]+)""", 1))
    return (tags.select("url", "base", F.coalesce(canonical, refresh).alias("href")).where("href is not null")
            .select("url", resolve(F.col("base"), F.col("href")).alias("target")).where("target is not null"))


def url_verdicts(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id",
                 url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A page's own rule decides. Without one, its aliases do: pages and link targets in the same
    component of the graph of canonical links, refresh redirects and the optional ``redirects``
    (url, target); an allowed alias outweighs blocked ones; with no verdict anywhere, allow.
    Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed.
    Repeated rows each get their row; a null html has no links; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    base = own.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                      F.when(_rest(F.col("url")).isNotNull(), url_key(F.col("url"))).alias("key"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("own"))

    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    links = scratch.keep(
        links.where(_rest(F.col("url")).isNotNull() & _rest(F.col("target")).isNotNull())
        .select(F.struct(url_key(F.col("url")).alias("key"), url_host(F.col("url")).alias("host"),
                         url_path(F.col("url")).alias("path")).alias("a"),
                F.struct(url_key(F.col("target")).alias("key"), url_host(F.col("target")).alias("host"),
                         url_path(F.col("target")).alias("path")).alias("b")).distinct(), "links")
    member = connected_components(links.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")), scratch)
    ends = links.select("a.*").unionByName(links.select("b.*")).distinct()
    _, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ends = ends.select("key", verdict.alias("v"))
    group = (member.join(ends, member["node"] == ends["key"]).groupBy("component")
             .agg(F.max(F.expr(f"v <=> '{ALLOW}'")).alias("allowed"), F.max(F.expr(f"v <=> '{BLOCK}'")).alias("blocked"))
             .where("blocked and not allowed"))
    blocked = scratch.keep(member.join(group, "component").select(F.col("node").alias("key"), F.lit(True).alias("hit")), "blocked")
    return base.join(blocked, "key", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("hit"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"))
