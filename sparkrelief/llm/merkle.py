"""Operator 5: document fingerprints as Merkle trees over sections, paragraphs and sentences.

Leaves are hashes of sentences; a paragraph (a line) hashes its leaves, a section
its paragraphs, the root its sections. A section ends at a paragraph whose hash
is divisible by ``SECTION``, so an inserted paragraph moves no later boundary. A
fingerprint has the root, and the branches under it: equal roots mean equal
texts, and differing branches show where an edit is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, read

#: On average so many paragraphs make a section.
SECTION = 4
_SENTENCE = "(?<=[.!?]) "


def leaves(text: Column) -> Column:
    """Hashes of the sentences of each paragraph: array<array<long>>."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.split(p, _SENTENCE, -1), lambda s: F.xxhash64(s)))


def fingerprint(tree: Column) -> Column:
    """The tree as text: ``root:section=leaf,leaf;leaf/section=...``; paragraphs end at ``;``, leaves have 8 hex digits."""
    marked = F.transform(
        tree,
        lambda p: F.concat(F.array_join(F.transform(p, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), ","), F.when(F.pmod(F.xxhash64(p), F.lit(SECTION)) == 0, F.lit("/")).otherwise(F.lit(";"))),
    )
    sections = F.split(F.array_join(marked, ""), "/", -1)
    hashed = F.transform(sections, lambda s: F.sha2(s, 256))
    shown = F.zip_with(sections, hashed, lambda s, h: F.concat(h.substr(1, 16), F.lit("="), F.regexp_replace(s, "([0-9a-f]{8})[0-9a-f]{8}", "$1")))
    return F.concat(F.sha2(F.array_join(hashed, "/"), 256), F.lit(":"), F.array_join(shown, "/"))


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct leaves that two trees have in common: twice the common ones by the sum of both."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def differing_sections(a: Column, b: Column) -> Column:
    """Branches of the first fingerprint that the second lacks, as text; empty if the roots are equal."""
    branches = lambda x: F.split(F.substring_index(x, ":", -1), "/")
    return F.array_except(branches(a), branches(b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text ends with the start of the next row's text, in the order of doc_id (null ids first), then
    text. A null text counts as empty. A single row is its own next. Rows are dealt by ranges of ids, of bounded
    number, and each range also gets the first row of the range after it; no task orders the whole table.
    Extra columns are not read.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    # the number of cuts below the id, by bisection
    sorted_cuts = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]) if cuts else F.array().cast("array<int>")
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(sorted_cuts, at + s - 1) < F.col("doc_id"), at + s).otherwise(at))
    block = F.when(F.col("doc_id").isNull(), 0).otherwise(below + 1)
    ranged = rows.withColumn("block", block)
    # the first id of each block that has rows goes to the block with rows before it (of the first: the last)
    firsts = sorted((r["block"], r["least"]) for r in ranged.groupBy("block").agg(F.min("doc_id").alias("least")).collect())
    if not firsts:
        firsts = [(0, None)]
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    pairs = spark.createDataFrame([(b, least, before[b]) for b, least in firsts], "b int, least long, before int")
    starts = ranged.join(F.broadcast(pairs), (F.col("block") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("least")))
    # of rows that share the first id, the one with the smallest text
    ghosts = starts.groupBy("before").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("block"))
    both = ranged.withColumn("last", F.lit(0)).unionByName(ghosts.withColumn("last", F.lit(1))).withColumn("tree", leaves(F.col("text"))).withColumn("flat", F.array_distinct(F.flatten("tree")))
    order = Window.partitionBy("block").orderBy("last", "doc_id", "text")
    seen = both.select("doc_id", "text", "last", "flat", F.lead("text").over(order).alias("next"), F.lead("flat").over(order).alias("next_flat")).where("last = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next").substr(F.lit(1), half))
    tree = seen.select("doc_id", "text", "flat", "next_flat", edited.alias("edited")).withColumn("edited_tree", leaves(F.col("edited")))
    return tree.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(leaves(F.col("text"))).alias("fingerprint"), fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("flat"), F.array_distinct(F.flatten("edited_tree"))).alias("near_edited"), likeness(F.col("flat"), F.col("next_flat")).alias("near_next"),
    )


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents", "doc_id", "text"))
