"""Document fingerprints: Merkle trees over sections, paragraphs and pieces, in built-in expressions alone.

A text is cut at blank lines into sections, a section at line ends into paragraphs, a paragraph into pieces of at most
four words that end early where a sentence does. Nothing is dropped: the pieces of a paragraph, put together, are the
paragraph. A leaf is the hash of a piece, a paragraph's node the hash of its leaves, a section's the hash of its
paragraphs', and the root the SHA-256 of all sections' nodes.

The fingerprint is the tree; its printed form is the root, then the nodes of the paragraphs by section. Equal texts have
equal fingerprints, equal roots mean equal texts, and where roots differ the branches that differ locate the edits
(:func:`differing`). The likeness of two fingerprints is twice the leaves they share over the leaves of both, each
distinct leaf once; it is 1 for equal fingerprints.

Nulls: a null text is empty; the fingerprint of an empty text is its root alone. Documents are put in order of id,
rows that repeat an id in order of their text, null ids first. A table of one row has itself as the next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertweave.llm.common import read

#: Up to three words that end no sentence and one more, with the blanks after them; or blanks before the first word.
PIECE = r"[\x20\x09-\x0D]+|(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09-\x0D]+){0,3}[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def leaves(text: Column) -> Column:
    """Sections of paragraphs of leaf hashes, as nested arrays."""
    sections = F.split(text, "\n(?=\n)")
    return F.transform(
        sections,
        lambda s: F.transform(
            F.split(s, "\n"),
            lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x)),
        ),
    )


def tree(nested: Column) -> Column:
    """sections (node and paragraph nodes) and leaves of a tree, from nested leaf hashes."""
    return F.struct(
        F.transform(nested, lambda s: F.xxhash64(F.transform(s, lambda p: F.xxhash64(p)))).alias("sections"),
        F.transform(nested, lambda s: F.transform(s, lambda p: F.xxhash64(p))).alias("paragraphs"),
        F.array_distinct(F.flatten(F.flatten(nested))).alias("leaves"),
    )


def fingerprint(text: Column, made: Column) -> Column:
    """Root, a colon, and the nodes: paragraphs in hexadecimal, joined by dots, sections by slashes."""
    sections = F.transform(
        made["paragraphs"], lambda s: F.array_join(F.transform(s, lambda p: F.hex(p)), ".")
    )
    root = F.sha2(F.concat_ws("|", F.array_join(F.transform(made["sections"], lambda s: F.hex(s)), "."), F.sha2(text, 256)), 256)
    return F.concat(root, F.lit(":"), F.array_join(sections, "/"))


def likeness(one: Column, two: Column) -> Column:
    """Shared leaves of two trees, from 0 to 1; two trees without leaves are alike."""
    total = F.size(one) + F.size(two)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(one, two)) / total)


def differing(one: Column, two: Column) -> Column:
    """Sections (from 0) whose node is not the same in both trees, those that only one of them has included."""
    n = F.greatest(F.size(one["sections"]), F.size(two["sections"]))
    return F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: ~F.get(one["sections"], i).eqNullSafe(F.get(two["sections"], i))
    )


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document with the text of the next one by id, as next_text; after the last comes the first.

    Ids are cut into ranges at approximate quantiles, so each range is one window group and no task sees the whole
    table. What follows the last row of a range is the first row of the next range that has any, one row a range.
    """
    n = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)})
    # Null ids come first.
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    keyed = keyed.withColumn("range", _range(F.col("key"), bounds))
    order = Window.partitionBy("range").orderBy("key", "text")
    row = keyed.withColumns({"next_text": F.lead("text").over(order), "last": F.lead(F.lit(1)).over(order).isNull()})
    # One row a range from here on, so no more than the ranges asked for.
    heads = keyed.groupBy("range").agg(F.min("key").alias("key"))
    first = keyed.drop("range").join(F.broadcast(heads), "key").groupBy("range").agg(F.min("text").alias("text"))
    follow = Window.orderBy("range")
    whole = follow.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follower = F.coalesce(F.lead("text").over(follow), F.first("text").over(whole))
    out = row.join(first.select("range", follower.alias("first_text")), "range", "left")
    text = F.when(F.col("last"), F.col("first_text")).otherwise(F.col("next_text"))
    return out.select(*docs.columns, text.alias("next_text"))


def _range(key: Column, bounds: list[int], step: int = 64) -> Column:
    """How many of the sorted bounds are at most ``key``, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    high = F.size(F.filter(F.lit(bounds[::step]), lambda b: key >= b))
    start = F.greatest(high - 1, F.lit(0)) * step
    return start + F.size(F.filter(F.slice(F.lit(bounds), start + 1, F.lit(step)), lambda b: key >= b))


def edited(text: Column, follower: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many code points of the next one, or all it has."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(follower, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and likenesses of each document."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    # Each text is cut and hashed once, in a column of its own that the later ones read.
    rows = rows.withColumns({f"{c}_nodes": leaves(F.col(c)) for c in ("text", "edited", "next_text")})
    rows = rows.withColumns({f"{c}_tree": tree(F.col(f"{c}_nodes")) for c in ("text", "edited")})
    next_leaves = F.array_distinct(F.flatten(F.flatten("next_text_nodes")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("text_tree")).alias("fingerprint"),
        fingerprint(F.col("edited"), F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("text_tree.leaves"), F.col("edited_tree.leaves")).alias("near_edited"),
        likeness(F.col("text_tree.leaves"), next_leaves).alias("near_next"),
    )


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
