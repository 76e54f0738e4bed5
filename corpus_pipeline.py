"""A corpus from raw documents to tokens: stages that each work on all rows the one before has kept."""

import public_tokenizers
from pyspark.sql import functions as F

from rulelens.llm.bpe import encode_decode
from rulelens.llm.decontaminate import drop_contaminated
from rulelens.llm.jaccard import one_per_component
from rulelens.llm.quality import keep_good
from rulelens.llm.queries import rank_file
from rulelens.llm.substrings import cut_duplicates
from rulelens.plans.storage import run_dir, run_scope


def quality_stage(spark, docs, sf_dir):
    """Documents that pass the quality rules."""
    return keep_good(docs)


def near_duplicate_stage(spark, docs, sf_dir):
    """Of the documents that share four fifths of their five-word shingles, directly or over others, the smallest id."""
    return one_per_component(docs)


def substring_stage(spark, docs, sf_dir):
    """Texts without the passages that documents of smaller ids have too, and without documents that are nothing else."""
    return cut_duplicates(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def contamination_stage(spark, docs, sf_dir):
    """Documents that do not hold benchmark text."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark, docs, sf_dir):
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    coded = encode_decode(docs, rank_file(), public_tokenizers.PATTERN, cut_at_spaces=True)
    return coded.select(
        "doc_id",
        F.col("decoded").alias("text"),
        "ids",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", contamination_stage),
    ("byte-level BPE", token_stage),
]

# Byte-level BPE cannot be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the documents; each reads what the one before has written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = run_dir(spark, name.replace(" ", "-"))
        with run_scope(spark):  # what a stage stores on its way goes with it
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
