"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns the columns of ``documents`` (the last one packed pieces).
``run`` writes every stage as Parquet into a folder of its own under the
session's shared checkpoint folder and reads it again for the next one, so a
lost executor costs at most its own tasks of one stage.

1. ``toxicity`` drops documents whose nearest labelled examples vote toxic.
2. ``near_duplicates`` keeps the least document of each class of near-duplicates.
3. ``decontamination`` drops documents that hold a benchmark window.
4. ``personal_data`` replaces personal data by its kind in the text.
5. ``packing`` packs the remaining documents into sequences.

Defined results: stages inherit the rules of their operators; rows with a null
doc_id are kept by stages 1 to 4; an empty table gives no rows.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetline.llm import decontaminate, near_dup, packing, pii, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score_toxicity(docs, toxicity.training_labels(labels), keep=COLUMNS)
    return scored.where(F.col("score") < 0.5).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = near_dup.near_duplicates(docs)
    later = classes.where("class_id <> doc_id").select("doc_id").distinct()
    first = docs.select(*COLUMNS).join(later, "doc_id", "left_anti")
    # rows that repeat a doc_id are copies of one another as well
    numbered = first.where("doc_id is not null").dropDuplicates(["doc_id"])
    return numbered.unionAll(first.where("doc_id is null")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.find_contamination(docs, bench, keep=COLUMNS).where("n_hit = 0").select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(docs, "doc_id", "lang", "source")
    return pii.redacted(found, "doc_id", "lang", "source").select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

# The stages' models and signatures are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    shared = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) \
        or tempfile.mkdtemp(prefix="fleetline-pipeline-")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
