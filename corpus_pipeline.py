"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor wrote and returns those that it keeps with
their columns; the last returns the places of their pieces in training sequences. What a stage read
is deleted when its successor is written.

1. language_id: texts that no language model codes well, and texts without bytes, go.
2. near_duplicates: of each group of near duplicates the document of lowest id stays.
3. secret_scan: confirmed secrets are replaced by their kind.
4. mixing: documents are drawn to the target weights of their sources, some of them repeatedly.
5. packing: pieces are packed into sequences of balanced cost.

Cases, as the operators state them: null and empty texts are rejected by the first stage, a null
id, lang or source is carried through, null lengths count as 1; very long texts are read whole;
rows that repeat id and text are one document from the second stage on, until mixing repeats it;
further columns, also of clashing names, are carried up to the last stage. An empty table, or one
without labels to learn from, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matrixloom.llm import langid, mixing, packing, secrets, superminhash
from matrixloom.llm.common import cut, drop_cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return superminhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixing", mix), ("packing", pack)]

#: The trees, sketches and parsers of the first three stages are beyond SQL; run() is tested
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if written is not None:
            drop_cut(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
