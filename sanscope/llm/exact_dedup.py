"""Exact deduplication by deterministic block naming (DataFrame operations only).

Every document becomes a row of fixed-size byte blocks. The distinct blocks are sorted and
each gets an integer name; then adjacent names are paired, the distinct pairs get new names,
and so on, until one name per document is left. Two documents of equal length have equal
names exactly when they have equal bytes: names are given to distinct contents, never to hashes.

Cost: the text is shuffled once (distinct blocks, combined before the shuffle). The join that
carries names back uses a 64-bit hash of the block; hashes that two different blocks share are
found and those blocks are joined by content. All later levels move integers only, half as
many each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, text_or_empty

BLOCK_BYTES = 4096
NO_NAME = -(2**63)


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names: the place in sorted order within the partition, behind the partition's number."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def document_names(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per distinct (id, normalised text): doc_id, th, n_bytes, sha, n_rows, name.

    ``(n_bytes, name)`` is equal for two rows exactly when their normalised texts are.
    ``hash_bits`` below 64 makes block hashes collide (for tests).
    """
    body = docs.select(
        F.col(id_col).alias("doc_id"),
        F.encode(F.regexp_replace(text_or_empty(text_col), SPACE_CLASS, " "), "UTF-8").alias("bin"))
    # hashed here, below the explode: once per text, not once per block
    sized = body.select("doc_id", "bin", F.length("bin").cast("long").alias("n_bytes"), F.xxhash64("bin").alias("th"))
    last = F.greatest(F.ceil(F.col("n_bytes") / block_bytes) - 1, F.lit(0)).cast("long")
    placed = sized.select("doc_id", "bin", "th", "n_bytes", last.alias("last"),
                          F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pos"))
    block = F.expr(f"substring(bin, cast(pos * {block_bytes} + 1 as int), {block_bytes})")
    blocks = placed.select("doc_id", "bin", "th", "n_bytes", "last", "pos", block.alias("block"))
    h = F.xxhash64("block") if hash_bits >= 64 else F.pmod(F.xxhash64("block"), F.lit(2**hash_bits))

    named = scratch.keep(_numbered(blocks.select(h.alias("h"), "block").distinct(), ["h", "block"])
                         .select("h", "name"), "block-names")
    occ = blocks.select("doc_id", "th", "n_bytes", "last", "pos", h.alias("h"),
                        F.when(F.col("pos") == 0, F.sha2("bin", 256)).alias("sha"), "block")
    clash = scratch.keep(named.groupBy("h").count().where("count > 1").select("h"), "clashes")
    cols = ["doc_id", "th", "n_bytes", "last", "pos", "sha", "name"]
    if clash.isEmpty():
        level = occ.drop("block").join(named, "h").select(*cols)
    else:  # different blocks with one hash: these, and only these, are joined by content
        odd = scratch.keep(occ.join(clash, "h", "left_semi"), "clashing")
        odd_names = scratch.keep(_numbered(odd.select("h", "block").distinct(), ["h", "block"])
                                 .withColumn("name", -F.col("name") - 1), "clashing-names")
        level = (occ.drop("block").join(named.join(clash, "h", "left_anti"), "h").select(*cols)
                 .unionByName(odd.join(odd_names, ["h", "block"]).select(*cols)))
    level = scratch.keep(
        level.groupBy("doc_id", "th", "n_bytes", "last", "pos")
        .agg(F.max("name").alias("name"), F.max("sha").alias("sha"), F.count(F.lit(1)).alias("n_rows")),
        "level")
    facts = level.where("pos = 0").select("doc_id", "th", "n_bytes", "sha", "n_rows")
    first = level
    done = [level.where("last = 0").select("doc_id", "th", "n_bytes", "name")]
    longest = level.agg(F.max("last")).first()[0] or 0
    while longest > 0:
        pairs = scratch.keep(
            level.where("last > 0")
            .groupBy("doc_id", "th", "n_bytes", F.expr("last div 2").alias("last"), F.expr("pos div 2").alias("pos"))
            .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
                 F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(NO_NAME)).alias("b")), "pairs")
        names = scratch.keep(_numbered(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        level = scratch.keep(pairs.join(names, ["a", "b"])
                             .select("doc_id", "th", "n_bytes", "last", "pos", "name"), "level")
        scratch.drop(pairs, names)
        done.append(level.where("last = 0").select("doc_id", "th", "n_bytes", "name"))
        longest //= 2
    names = done[0]
    for d in done[1:]:
        names = names.unionByName(d)
    if len(done) == 1:
        return first.where("pos = 0").select("doc_id", "th", "n_bytes", "sha", "n_rows", "name")
    # null-safe keys: a null id is an id like any other
    f, n = facts.alias("f"), names.alias("n")
    return f.join(n, F.expr("f.doc_id <=> n.doc_id and f.th = n.th and f.n_bytes = n.n_bytes")).select(
        "f.doc_id", "f.th", "f.n_bytes", "sha", "n_rows", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document.

    Texts are compared after each run of white space became one blank; a null text counts as
    empty, and all empty texts form one group. Rows that repeat both id and text are one
    document (one result row) and each counts in ``group_size``; rows that share an id but not
    the text are separate documents. A null id is kept only if its group has no other id.
    Other columns are ignored whatever their names. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    names = scratch.keep(document_names(docs, scratch, id_col, text_col, block_bytes, hash_bits), "identities")
    # written, so that the join below has plain exchanges on both sides and a hot group can be split
    groups = scratch.keep(names.groupBy("n_bytes", "name").agg(
        F.min("doc_id").alias("keep_id"), F.sum("n_rows").cast("long").alias("group_size")), "groups")
    return names.join(groups, ["n_bytes", "name"]).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"),
        F.col("sha").alias("text_sha256"))
