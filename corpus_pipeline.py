"""From raw documents to packed training sequences: rules, classifier, near-dedup, substring dedup, packing.

Each stage reads the table that the one before wrote, works on all of it, and all but the last return the columns of
``documents``. Columns that a stage adds for itself do not leave it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm import minhash_dedup, packing, quality_classifier, quality_rules, substring_dedup
from alertweave.llm.common import packed_away, read, unpacked
from alertweave.session import fresh_path, materialise


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the learned decision list."""
    needs = ("doc_id", "text")
    judged = quality_rules.judged(packed_away(docs, *needs), read(spark, sf_dir, "labels"))
    return judged.where("kept").select(*unpacked(docs, needs))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, given their own evidence and their site's."""
    needs = ("doc_id", "text", "source", "lang")
    judged = quality_classifier.classified(packed_away(docs, *needs), read(spark, sf_dir, "labels"))
    return judged.where("kept").select(*unpacked(docs, needs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id.

    Rows with one id and unlike texts are documents of their own, and stay unless they are near copies of another id's.
    Of rows that repeat both id and text one stays. Documents without id all stay.
    """
    found = minhash_dedup.near_duplicates(docs.select("doc_id", "text")).where("doc_id is not null")
    rows = found.groupBy("doc_id", "text_key").agg(F.min("text_kept").alias("keeps"), F.count(F.lit(1)).alias("copies"))
    # Slim, and usually few: the documents of which some row goes.
    marks = materialise(rows.where("not keeps or copies > 1").toDF("_id", "_key", "_keeps", "_copies"), "near-copies")
    key = minhash_dedup.text_key()
    marked = docs.join(marks, (docs["doc_id"] == F.col("_id")) & (key == F.col("_key")), "left")
    single = marked.where("_keeps is null").select(*docs.columns)
    repeated = marked.where("_keeps").dropDuplicates(["_id", "_key"]).select(*docs.columns)
    return single.unionByName(repeated)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier one has; texts left without a word go.

    A text that loses nothing stays as it is, line ends and all; a cut text is its kept words joined by spaces.
    """
    needs = ("doc_id", "text")
    cut = substring_dedup.cut(packed_away(docs, *needs)).where("n_removed = 0 or n_removed < n_words")
    whole = F.col("n_removed") == 0
    changed = {"text": F.when(whole, F.col("text")).otherwise(F.col("kept_text"))}
    columns = dict(zip(docs.columns, unpacked(docs, needs)))
    if "n_chars" in columns:
        length = F.when(whole, columns["n_chars"]).otherwise(F.length("kept_text"))
        changed["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return cut.select(*[changed.get(name, column).alias(name) for name, column in columns.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substrings),
    ("best-fit packing", pack),
]

#: Stages are learned or iterative, which SQL does not express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
