"""From raw documents to token digests: five stages, each the input of the next.

1. toxic documents go, 2. one document of each near-duplicate group stays (five-word shingles,
similarity 0.8), 3. documents that hold a benchmark item go, 4. personal data is masked,
5. texts are encoded into pieces and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineaudit.llm import decontamination, near_dedup, pieces, pii, toxicity
from lineaudit.llm.common import shared_folder, table


def piece_model() -> str:
    """Path of the vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, piece_model())


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("personal_data", _personal_data),
    ("encoding", _encode),
]

#: Learned models and similarity components are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
