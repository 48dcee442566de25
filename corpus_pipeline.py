"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

Toxic documents go; later copies of repeated line runs are deleted, and with them documents that lose every word; one
document of each group of near-duplicates stays; sources are mixed to their target weights; what is left is packed
into training windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import lines, mixing, neardup, packing, toxicity
from lethe.llm.common import SPACE, stored
from lethe.llm.queries import WORD_VOCABULARY


def _with_length(docs: DataFrame) -> DataFrame:
    """Bring n_chars, where there is such a column, up to date with the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that lose all their words go.

    Columns of any name go along untouched.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("document")
    plain = docs.select("doc_id", "text", others)
    rows = lines.drop_copied_lines(plain)
    word = F.col("text").rlike(f"[^{SPACE[1:-1]}]")
    kept = rows.where((F.size("deleted") == 0) | word)
    return _with_length(kept.select(*["text" if c == "text" else f"document.`{c}`" for c in docs.columns]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near-duplicates: that of the smallest doc_id, null last.

    Rows are told apart by a number that is stored with them, so that doc_id may be null or repeated. Texts without
    words are each a group of their own.
    """
    document = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), document), "near-rows")
    plain = rows.select("row", F.col("document.doc_id").alias("doc_id"), F.col("document.text").alias("text"))
    classes = neardup.near_duplicates(plain, key="row").select("row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"), F.col("row"))
    named = plain.select("row", "doc_id", F.xxhash64("text").alias("mark")).join(classes, "row")
    kept = named.groupBy("component_id").agg(F.min_by("row", order).alias("row"))
    return rows.join(kept, "row", "left_semi").select("document.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the text that the mix takes of them, repeats included; those of which it takes nothing go.

    doc_id may be null or repeated: each row gets its own share.
    """
    return _with_length(mixing.mixed_texts(docs, mixing.mix(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed training windows, with their ids."""
    return packing.pack(docs, WORD_VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]
# Classifier, components and tokenizer have no SQL form; tests compare their operators with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name.replace(' ', '-')}")
    return docs
