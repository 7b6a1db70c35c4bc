"""A corpus pipeline of five stages over documents, each one operator applied to all that the stage before kept.

Every stage but the last returns the columns of documents. Decisions take effect: rejected documents go, one document
of each near-duplicate class stays, contaminated documents go, found secrets are masked in the text, and what is left
is encoded to token ids. Near duplicates and contamination are decided by row (id and text), so rows without an id and
different texts that share one are judged by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import bpe, jaccard_join, quality, secrets, tiling
from crestline.llm.common import cut


def row_hash():
    """What a row is known by: a 64-bit hash of its id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model, keep=tuple(c for c in docs.columns if c != "doc_id"))
    return scored.where("predicted = 1").select(*docs.columns)


def jaccard_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each class of linked shingle sets (null ids last); texts without words have classes of their own.

    Rows go by a list of those that give way, which holds members of larger classes only, so a text that is alone in its
    class meets nothing but that list. Repeated rows (of one id and text) are told apart by nothing: one of them stays.
    """
    worded = F.coalesce("text", F.lit("")).rlike("[^ \\t-\\r]")
    rows = docs.where(worded).withColumn("_row", row_hash())
    classes = cut(jaccard_join.join(rows, id_col="_row").groupBy("_row", "component_id").agg(F.count("*").alias("copies")))
    larger = classes.groupBy("component_id").agg(F.sum("copies").alias("size")).where("size > 1").select("component_id")
    members = cut(classes.join(larger, "component_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    least = rows.select("doc_id", "_row").join(members, "_row").groupBy("component_id").agg(F.min(order).alias("least")).select(F.col("least._row").alias("_row"))
    least = cut(members.select("_row", "copies").join(least, "_row", "left_semi"))
    repeated = least.where("copies > 1").select("_row")
    gone = members.select("_row").join(least.where("copies = 1"), "_row", "left_anti")
    one = rows.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])
    return rows.join(cut(gone), "_row", "left_anti").unionAll(one).select(*docs.columns).unionAll(docs.where(~worded))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover no benchmark item up to the threshold."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.withColumn("_row", row_hash())
    found = cut(tiling.contaminated(rows, benchmark, id_col="_row").select("_row").distinct())
    return rows.join(found, "_row", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found span masked, and n_chars to match."""
    return secrets.masked(docs).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids, their number, and whether they decode to the text's own bytes."""
    import public_tokenizers

    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_classes),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_bpe),
]

# Kernel ridge scores and BPE merges have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
