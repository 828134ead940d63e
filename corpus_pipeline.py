"""A training corpus from `documents`: quality rules, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. Nulls,
empty and repeated rows go through as the stages' operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelake.llm import ngramjoin, packing, quality, secrets, toxicity
from rulelake.llm.common import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; those without text are rejected, repeated rows are judged each for itself."""
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    judged = quality.judge(named, text_col=f"_c{docs.columns.index('text')}")
    # written before the filter, which would otherwise work the measures out a second time below the projection
    kept = materialize(judged.drop("quality_measures", "quality_failed"), "judged").where("quality_kept")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity; the model learns from this stage's labelled rows, held-out ids aside.

    A text without words scores the labels' base rate; repeated rows score alike; where no feature was learned, as
    without labelled rows, nothing tells documents apart and all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.train(docs.where(toxicity.bucket("doc_id", 5) != 0), labels)
    if not scorer.names:
        return docs
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    scored = toxicity.score_documents(named, scorer, text_col=f"_c{docs.columns.index('text')}").where("toxicity < 0.5")
    return scored.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates; of exact repeats of a row one; texts without words stay."""
    return ngramjoin.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows the text where there is such a column (null for null texts)."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths; one row per sequence. A null or empty text is the end id alone."""
    return packing.pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", keep_civil),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: Toxicity and tokens are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
