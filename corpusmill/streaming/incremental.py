"""Incremental index maintenance as a Structured Streaming job.

The reference adds documents later by merging new postings into the old
ones (postings and document frequencies are sums).  Here new documents
arrive as files in a folder; a streaming query reads them with a declared
schema, and ``foreachBatch`` writes each micro-batch's postings and the document
frequencies that it adds under its epoch number, then a commit file.  Document
frequencies are the sum of those small tables, so reading them never scans the postings, and
nothing is kept in streaming state (state would grow with the vocabulary).

:func:`compact` merges the committed epochs into a new generation; its manifest says up to which epoch it
holds all.  Readers take the newest generation and the epochs after it.

Exactly once: a retried epoch overwrites its own folders; an epoch without commit file is not
read; one that is already in a generation is skipped, so a batch that is repeated after a restart
behind a compaction adds nothing; a generation's manifest is written last and only if absent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.postings import build_postings, doc_freq
from corpusmill.sources.stages import delete, names, read_json, write_once

DOC_SCHEMA = "doc_id long, text string"
POSTINGS = "term string, doc_id long, tf long"
DFREQ = "term string, df long"


def generation(spark: SparkSession, index_path: str) -> dict:
    """The newest generation: number, covered (last epoch that is in it) and its data folder."""
    found = [int(n.removesuffix(".json")) for n in names(spark, f"{index_path}/generations")]
    return read_json(spark, f"{index_path}/generations/{max(found)}.json") if found else {"number": 0, "covered": -1, "data": None}


def committed(spark: SparkSession, index_path: str) -> list[int]:
    """Committed epochs, those in generations included as long as they are not removed."""
    return sorted(int(n) for n in names(spark, f"{index_path}/commits"))


def add_batch(batch: DataFrame, epoch: int, index_path: str) -> None:
    """Write one epoch: its postings, the document frequencies that it adds, the commit file."""
    spark = batch.sparkSession
    if epoch <= generation(spark, index_path)["covered"] or epoch in committed(spark, index_path):
        return
    folder = f"{index_path}/epochs/{epoch}"
    # dealt by document, so that the texts are shuffled and not the postings
    docs = batch.select("doc_id", "text").repartition(2 * spark.sparkContext.defaultParallelism, "doc_id")
    build_postings(docs).write.mode("overwrite").parquet(f"{folder}/postings")
    post = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    doc_freq(post).write.mode("overwrite").parquet(f"{folder}/df")
    write_once(spark, f"{index_path}/commits/{epoch}", {"epoch": epoch})


def start_ingest(spark: SparkSession, source_dir: str, index_path: str,
                 checkpoint: str, available_now: bool = True,
                 schema: str = DOC_SCHEMA, max_files: int | None = None):
    """Start the stream; returns the StreamingQuery.  ``checkpoint`` belongs to
    ``index_path`` and must stay the same over restarts: the epoch
    numbers continue from it.  ``max_files`` bounds the files of one epoch."""
    reader = spark.readStream.schema(schema)
    docs = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source_dir)
    writer = docs.writeStream.foreachBatch(lambda batch, epoch: add_batch(batch, epoch, index_path)) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def _parts(spark: SparkSession, index_path: str, what: str, schema: str) -> tuple[DataFrame, dict, list[int]]:
    g = generation(spark, index_path)
    later = [e for e in committed(spark, index_path) if e > g["covered"]]
    paths = ([f"{g['data']}/{what}"] if g["data"] else []) + [f"{index_path}/epochs/{e}/{what}" for e in later]
    df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return df, g, later


def read_postings(spark: SparkSession, index_path: str) -> DataFrame:
    """Postings of everything ingested so far.  A document arrives
    once, so postings of different epochs never share a (term, doc)."""
    return _parts(spark, index_path, "postings", POSTINGS)[0]


def read_df(spark: SparkSession, index_path: str) -> DataFrame:
    """(term, df) from the epochs' document frequencies alone."""
    return _parts(spark, index_path, "df", DFREQ)[0].groupBy("term").agg(F.sum("df").alias("df"))


def read_index(spark: SparkSession, index_path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, df) of everything ingested so far."""
    return read_postings(spark, index_path), read_df(spark, index_path)


def compact(spark: SparkSession, index_path: str) -> int:
    """Merge the committed epochs without a gap after the newest generation into the next one; returns how many.  The
    epochs' own folders stay for readers that have begun; :func:`vacuum` removes them."""
    _, g, later = _parts(spark, index_path, "df", DFREQ)
    run = [e for i, e in enumerate(later) if e == g["covered"] + 1 + i]
    if not run:
        return 0
    data = f"{index_path}/data/{uuid.uuid4().hex}"
    for what, schema in (("postings", POSTINGS), ("df", DFREQ)):
        paths = ([f"{g['data']}/{what}"] if g["data"] else []) + [f"{index_path}/epochs/{e}/{what}" for e in run]
        df = spark.read.schema(schema).parquet(*paths)
        if what == "df":
            df = df.groupBy("term").agg(F.sum("df").alias("df"))
        df.write.parquet(f"{data}/{what}")
    number = g["number"] + 1
    write_once(spark, f"{index_path}/generations/{number}.json", {"number": number, "covered": run[-1], "data": data})
    return len(run)


def vacuum(spark: SparkSession, index_path: str) -> None:
    """Remove what the newest generation has replaced; call it when no reader is at work."""
    g = generation(spark, index_path)
    for e in committed(spark, index_path):
        if e <= g["covered"]:
            delete(spark, f"{index_path}/epochs/{e}")
            delete(spark, f"{index_path}/commits/{e}")
    for n in names(spark, f"{index_path}/data"):
        if not (g["data"] or "").endswith(n):
            delete(spark, f"{index_path}/data/{n}")
