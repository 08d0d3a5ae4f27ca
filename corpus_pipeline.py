"""From raw documents to a training mix, in five stages; each works on what the one before kept.

All stages but the last return the columns of documents.  SQL can't express the learned
score, the fingerprints or the cube method, so ORACLE_SQL is None.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import decontamination, line_dedup, mixing, near_dedup, simhash_dedup, toxicity
from sensorloom.llm._spark import shared_folder


#: Rows in an Arrow batch: whole texts go to Python and back, so batches are kept small.
BATCH = 1_000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the model learns from the labelled ones among them that are not held out."""
    _bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(toxicity.fold("doc_id", 4) != 2))
    return toxicity.keep_clean(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on five sources or more stay once; n_chars follows the text."""
    _bounded(spark)
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; two link if their five-word shingles have a Jaccard similarity of 0.8 or more."""
    _bounded(spark)
    return simhash_dedup.keep_one(docs, grouped=near_dedup.groups, shingle=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    _bounded(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies."""
    _bounded(spark)
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage keeps is written to the shared folder, read by the next and then deleted.

    The session's batch size is as before when all stages have run.  If a stage fails, nothing that was written stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"

    def delete(name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete(f"{folder}/{k - 1}")
    except BaseException:
        delete(folder)
        raise
    finally:
        spark.conf.set(key, before)
    return docs
