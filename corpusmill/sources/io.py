"""Scans and sinks (operators S1-S14).

Parquet is the interchange format between stages; JSON and text forms exist
for the reference's file layouts.  All readers take an explicit schema so no
inference pass runs over the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events "
                 "documents embeddings pages benchmark labels conversations").split()

# Patent JSON-lines record.
PATENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("classification-ipc", T.ArrayType(T.StructType([
        T.StructField("section", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("subclass", T.StringType()),
    ]))),
    T.StructField("description", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("claims", T.StringType()),
    T.StructField("invention-title", T.StringType()),
    T.StructField("patent-date", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_patents_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a declared schema (no inference scan)."""
    return spark.read.schema(PATENT_SCHEMA).json(path)


def read_tuple_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines holding a literal ``(doc_id, text)`` pair.

    Parsed with a pattern, never evaluated: the quoted text is rewritten as a
    JSON string (``\\xNN`` becomes ``\\u00NN``, quotes are adjusted) and read as
    such, which undoes all escapes.  Lines that are no such pair are left
    out; :func:`tuple_text_rejects` returns them.
    """
    parsed = _tuple_text(spark.read.text(path))
    return parsed.filter("text is not null").select("doc_id", "text")


def tuple_text_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines (column ``value``) that :func:`read_tuple_text` leaves out."""
    return _tuple_text(spark.read.text(path)).filter("text is null").select("value")


def _tuple_text(raw: DataFrame) -> DataFrame:
    pat = r"""^\(\s*[uU]?(['"])(.*?)\1\s*,\s*[uU]?(['"])(.*)\3\s*\)\s*$"""
    body = F.regexp_extract("value", pat, 4)
    even = r"(?<!\\)((?:\\\\)*)"           # an even number of backslashes before
    body = F.regexp_replace(body, even + r"\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    body = F.regexp_replace(body, even + r"\\'", "$1'")
    body = F.regexp_replace(body, even + '"', r'$1\\"')
    text = F.from_json(F.concat(F.lit('["'), body, F.lit('"]')), "array<string>",
                       {"allowUnquotedControlChars": "true"})[0]
    ok = F.col("value").rlike(pat)
    return raw.select("value", F.regexp_extract("value", pat, 2).alias("doc_id"), F.when(ok, text).alias("text"))


def tuple_text_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """S2 sink: ``('id', 'text')`` lines with backslash escapes, the layout
    :func:`read_tuple_text` parses."""
    t = F.col(text_col)
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return df.select(F.format_string("('%s', '%s')", F.col(id_col).cast("string"), t).alias("value"))


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``entity_id tok tok ...``: the first space separates the id."""
    parts = F.split(F.col("value"), " ", 2)
    return spark.read.text(path).select(
        parts[0].alias("entity_id"),
        F.filter(F.split(F.coalesce(parts[1], F.lit("")), " "),
                 lambda t: t != "").alias("tokens"))


def read_connector(spark: SparkSession, fmt: str, resource: str,
                   options: dict | None = None) -> DataFrame:
    """A search-index scan through its Spark connector, when the
    connector jar is on the classpath (``format`` name is the connector's)."""
    reader = spark.read.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.load(resource)


def write_long_json(df: DataFrame, path: str, key: str, map_key: str,
                    map_value: str, partitions: int | None = None,
                    max_entries: int = 100_000, compression: str = "gzip") -> None:
    """S6 sink: JSON lines ``{key, chunk, postings: {k: v}}``.

    The map is only assembled here at export time; inside the engine the
    table stays long.  Every key is written in the same layout: its entries
    are dealt to chunks by a hash of the entry, the number of chunks being
    that of ``max_entries`` rows each in the whole table.  So no line and no
    task holds more than about ``max_entries`` entries, whatever a key's share,
    and the reader merges the lines back (it explodes every line)."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    chunks = F.greatest(F.ceil(rows / F.lit(max_entries)), F.lit(1))
    keyed = df.withColumn("chunk", F.pmod(F.xxhash64(F.col(map_key)), chunks.cast("long")))
    out = (keyed.groupBy(key, "chunk")
           .agg(F.map_from_entries(F.collect_list(
               F.struct(F.col(map_key), F.col(map_value)))).alias("postings")))
    if partitions:
        out = out.repartition(partitions, key)
    out.select(F.to_json(F.struct(key, "chunk", "postings")).alias("value")) \
        .write.mode("overwrite").option("compression", compression).text(path)


def read_long_json(spark: SparkSession, path: str, key: str, key_type: str,
                   map_key: str, map_key_type: str, map_value: str) -> DataFrame:
    """S6 source: reload the export above back into a long table."""
    # JSON object keys are strings; they are cast to the key type after
    # the map is exploded back into rows
    schema = f"{key} {key_type}, postings map<string,double>"
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("r"))
    return parsed.select(F.col(f"r.{key}").alias(key),
                         F.explode("r.postings").alias(map_key, map_value)) \
        .withColumn(map_key, F.col(map_key).cast(map_key_type))


def write_parquet(df: DataFrame, path: str, partition_by=None,
                  max_records_per_file: int | None = None,
                  compression: str = "zstd") -> None:
    """S7/S12/S13 sink: Parquet with optional partition columns, file size
    cap and compression."""
    w = df.write.mode("overwrite").option("compression", compression)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def dense_text(df: DataFrame, vector_col: str, id_col: str | None = None,
               decimals: int = 3) -> DataFrame:
    """Vector as space-separated fixed-point text (``%.3f``)."""
    txt = F.array_join(F.transform(F.col(vector_col),
                                   lambda x: F.format_string(f"%.{decimals}f", x)), " ")
    cols = ([F.col(id_col)] if id_col else []) + [txt.alias("line")]
    return df.select(*cols)


def row_blocks(df: DataFrame, row_index_col: str, block_rows: int = 100_000) -> DataFrame:
    """Block number of a row from its 0-based global index."""
    return df.withColumn("block", F.floor(F.col(row_index_col) / block_rows).cast("long"))


def write_row_blocks(df: DataFrame, order_cols, path: str, block_rows: int = 100_000, index_col: str = "row_idx") -> None:
    """S13 sink: the rows with their payload, numbered in this order and written in one folder for each block of
    ``block_rows`` rows.  Every block is one task's, so it is one file, and no task holds more than
    the blocks that are hashed to it."""
    from corpusmill.operators.select import global_rank
    ranked = row_blocks(global_rank(df, order_cols, index_col, start=0), index_col, block_rows)
    ranked.repartition("block").sortWithinPartitions("block", index_col) \
        .write.mode("overwrite").partitionBy("block").parquet(path)


def read_row_blocks(spark: SparkSession, path: str, first: int, last: int | None = None) -> DataFrame:
    """S13 source: the rows of a range of blocks; only their folders are listed and read."""
    return spark.read.parquet(path).filter(F.col("block").between(first, first if last is None else last))


# Fixed value: distance written for an unreachable point by the reference.
UNREACHABLE_DISTANCE = 100.0


def parse_reachability(lines: DataFrame, col: str = "value") -> DataFrame:
    """``ID=<n> ... reachdist=<x | Infinity>`` lines of an external
    clustering tool's output -> (elem_id, reachdist), Infinity mapped to the
    fixed distance 100."""
    raw = F.regexp_extract(F.col(col), r"reachdist=([^ ]+)", 1)
    dist = F.when(raw.isin("Infinity", "inf", "Inf"), F.lit(UNREACHABLE_DISTANCE)) \
        .otherwise(F.expr(f"try_cast(regexp_extract({col}, 'reachdist=([^ ]+)', 1) AS DOUBLE)"))
    return lines.select(F.regexp_extract(F.col(col), r"ID=([^ ]+)", 1).alias("elem_id"),
                        dist.alias("reachdist"))
