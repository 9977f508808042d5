"""A training-data pipeline over the documents table.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the next stage's documents.  All stages but the last return the
columns of their input:

* quality: documents that fail the base rules or are depleted go; lines above
  their host's limit are cut out of the texts that stay.
* near_duplicates: one document of each class of Jaccard-linked texts stays,
  that with the least doc_id.
* decontaminate: documents with a benchmark window go.
* secrets: secret values in the texts are masked.
* pieces: texts are encoded to piece ids and decoded again; the result has
  doc_id, ids and decoded.

Defined cases: null and empty texts fail the base rules and go in the first
stage; null ids, sources and languages are values like others; of rows that repeat an
id and a text one stays, of equal texts under several ids that of the least id (a null id
is least); extra columns pass through every stage but the last; an empty table gives an empty
result with the same columns; a text of any length is read whole.

:func:`run` writes each stage as Parquet under the shared checkpoint folder
and hands the reread table to the next, so a lost executor repeats a stage
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.decontaminate import drop_contaminated
from corpusmill.llm.jaccard import one_of_each
from corpusmill.llm.pieces import encode_decode
from corpusmill.llm.quality import apply_quality
from corpusmill.llm.secrets import redact
from corpusmill.session import materialize, ship_package
from corpusmill.sources.io import table

PIECE_MODEL = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    import public_tokenizers
    got = encode_decode(docs, public_tokenizers.path(PIECE_MODEL))
    return got.select(F.col("id").alias("doc_id"), "ids", "decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("secrets", secrets), ("pieces", pieces)]

# Near duplicates, inferred grammars and the piece model have no SQL form; the
# stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
