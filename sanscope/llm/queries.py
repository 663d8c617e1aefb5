"""Registered queries opN_<name> with production parameters, and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanscope.sources.tables import table

from . import bpe, conversations, decontaminate, exact_dedup, hard_negatives, html_text, minhash, pii, quality, simhash, suffix_dedup, toxicity, url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, offsets=False).drop("text")
    return bpe.decode_documents(coded, RANKS, public_tokenizers.PATTERN).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, s -> s.k = {k})")).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_text("base").cast("binary"), 256).alias("base_sha256"),
                        pii.span_text("spans").alias("spans"),
                        F.size(F.expr(f"filter(spans, s -> s.k = {pii.SECRET})")).cast("long").alias("n_secret"),
                        F.size("spans").cast("long").alias("n_spans"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, repaired = conversations.repair(table(spark, sf_dir, "conversations"), damage=True)
    sha = conversations.digests(repaired).select(F.col("conv_id").alias("its_id"), "repaired_sha256")
    return reports.join(sha, reports["conv_id"].eqNullSafe(sha["its_id"]), "left").drop("its_id").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_decontamination, op3_exact_dedup, op4_toxicity, op5_html_text, op6_bpe, op7_pii, op8_url_filter,
    op9_near_dedup, op10_suffix_dedup, op11_conversations, op12_simhash, op13_hard_negatives)}

#: Runs of white space, words and the letters that count as upper case, as the statements below state them.
_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REST = "case when instr({u}, '://') > 0 then substr({u}, instr({u}, '://') + 3) end"
_HOST = "coalesce(translate(regexp_extract({r}, '^([^/?#]*)', 1), '" + _UPPER + "', '" + _LOWER + "'), '')"
_PATH = "coalesce(regexp_extract({r}, '^[^/?#]*([^?#]*)', 1), '')"
# rules from the longest to the shortest: (rule, host, path, verdict)
_RULES = (("example.org/en/1", "example.org", "/en/1", "block"), ("example.org/es/", "example.org", "/es/", "block"),
          ("com/fr/", "com", "/fr/", "allow"), ("com/de/", "com", "/de/", "block"), ("org/", "org", "/", "allow"))


def _rule_sql(host: str, path: str, column: int) -> str:
    return "case " + " ".join(
        f"when ({host} = '{r[1]}' or ends_with({host}, '.{r[1]}')) and starts_with({path}, '{r[2]}') then '{r[column]}'"
        for r in _RULES) + " end"


def _key_sql(url: str) -> str:
    """Host, path and query without campaign parameters."""
    rest = _REST.format(u=url)
    query = f"coalesce(regexp_extract({rest}, '^[^?#]*([?][^#]*)', 1), '')"
    query = f"regexp_replace(regexp_replace({query}, '([?&])utm_[^&]*(&|$)', '\\1', 'g'), '[?&]+$', '')"
    return f"{_HOST.format(r=rest)} || {_PATH.format(r=rest)} || {query}"


ORACLE = {
    "op3_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS x FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
    "op8_url_filter": rf"""
        WITH RECURSIVE base AS (
          SELECT page_id, url, {_HOST.format(r=_REST.format(u='url'))} AS host, {_PATH.format(r=_REST.format(u='url'))} AS path,
                 regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<script\b.*?</script>', '', 'g') AS html FROM pages),
        tag AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS t FROM base),
        link AS (SELECT url, replace(CASE
            WHEN regexp_matches(t, '(?i)^<link\b[^>]*\brel\s*=\s*(["'']([^"''>]*\s)?canonical[\s"'']|canonical[\s>/])') THEN regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)
            WHEN regexp_matches(t, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)
            END, '&amp;', '&') AS h FROM tag),
        goal AS (SELECT url, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
            WHEN starts_with(h, '//') THEN regexp_extract(url, '^([^:/?#]*):', 1) || ':' || h
            WHEN starts_with(h, '/') THEN regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) || h
            WHEN starts_with(h, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || h
            WHEN starts_with(h, '#') THEN regexp_extract(url, '^([^#]*)', 1) || h
            ELSE regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) ||
              coalesce(nullif(regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*/)', 1), ''), '/') || h END AS target FROM link WHERE h <> ''),
        edge AS (SELECT DISTINCT {_key_sql('url')} AS a, {_key_sql('target')} AS b FROM goal WHERE instr(url, '://') > 0 AND instr(target, '://') > 0),
        node AS (SELECT {_key_sql('url')} AS k, {_rule_sql(_HOST.format(r=_REST.format(u='url')), _PATH.format(r=_REST.format(u='url')), 3)} AS v FROM goal
          UNION SELECT {_key_sql('target')}, {_rule_sql(_HOST.format(r=_REST.format(u='target')), _PATH.format(r=_REST.format(u='target')), 3)} FROM goal),
        reach AS (SELECT k, k AS m FROM node UNION
          SELECT r.k, CASE WHEN e.a = r.m THEN e.b ELSE e.a END FROM reach r JOIN edge e ON e.a = r.m OR e.b = r.m),
        word AS (SELECT r.k, bool_or(n.v = 'allow') AS allowed, bool_or(n.v = 'block') AS blocked FROM reach r JOIN node n ON n.k = r.m GROUP BY r.k)
        SELECT page_id, host, path, {_rule_sql('host', 'path', 0)} AS rule,
               coalesce({_rule_sql('host', 'path', 3)}, CASE WHEN w.blocked AND NOT coalesce(w.allowed, false) THEN 'block' END, 'allow') AS verdict
        FROM base LEFT JOIN word w ON instr(url, '://') > 0 AND w.k = {_key_sql('url')}""",
    "op9_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS l FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(l[i:least(i + 4, len(l))], ' ') AS x
          FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0) z),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.m)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.m) AS component_id, d.doc_id = min(r.m) AS kept
        FROM documents d JOIN r ON r.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_suffix_dedup": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s
          FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 99, 0))) AS p FROM t) z),
        later AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
        marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER o <= 100 THEN 0 ELSE 1 END AS fresh FROM later
          WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        run AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
          SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked) z GROUP BY doc_id, g),
        gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS k FROM run),
        cut AS (SELECT g.doc_id, count(*) AS n_spans, sum(b - a)::bigint AS n_removed, max(b) AS last,
            string_agg(substr(t.x, 2 * k + 1, 2 * (a - k)), '' ORDER BY a) AS kept FROM gap g JOIN t ON t.doc_id = g.doc_id GROUP BY g.doc_id)
        SELECT t.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM t LEFT JOIN cut ON cut.doc_id = t.doc_id""",
    "op13_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.v, b.v)::bigint AS score
          FROM e a JOIN e b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::int AS rank
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own
            AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
