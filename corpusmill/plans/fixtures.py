"""Concept tables built from the driver's tables (FIXTURES.md section 3).

| concept                       | built from                                         |
| ----------------------------- | -------------------------------------------------- |
| corpus (doc_id, text)         | documents                                          |
| single-path labels            | documents.lang / lang-source / lang-source-q<quality> (labels, 'qx' when absent) |
| multi-label labels            | order = document, one IPC-like path per lineitem: p_type / p_type-p_brand / p_type-p_brand-p_size |
| sparse predictions            | per order: true sections plus distractor sections (part keyed by l_suppkey), integer score |
| metric history                | events: run = user_id, metric = event_type, epoch = day of month |
| vectors                       | embeddings (vec_id, embedding, label)              |

Each builder is a plain DataFrame expression, so the queries that use it
read the driver tables and grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.io import table


PART_BYTES = 4 << 20        # of Parquet a task
TERM_BYTES = 16 << 20       # of texts whose postings a task holds when they are dealt by term


def parts(df: DataFrame, part_bytes: int | None = None) -> int:
    """Tasks over ``df``: twice as many as cores, so that documents of very different lengths balance, and one for
    each ``PART_BYTES`` (or ``part_bytes``) of its files, so that a task's groups stay in memory however large the table is."""
    sc = df.sparkSession.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return max(2 * sc.defaultParallelism, -(-size // (part_bytes or PART_BYTES)))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by ``key`` into :func:`parts` partitions.

    A scan of many splits is dealt too: a split without a row group of its own
    is empty, and what is grouped by (key, ...) later needs no other
    shuffle.  So the texts are shuffled once, not the postings, which are
    several times as large."""
    return df.repartition(parts(df), key)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) dealt by document for per-document work."""
    return spread(documents(spark, sf_dir), "doc_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) as scanned: for corpus-wide scalars (N, average
    length), which need no spreading and so no text shuffle."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def doc_labels_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, level, label, section): one path per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    sec = F.col("lang")
    cls = F.concat(sec, F.lit("-"), F.col("source"))
    sub = F.concat(cls, F.lit("-q"), F.coalesce(F.col("quality").cast("string"), F.lit("x")))
    levels = F.explode(F.array(
        F.struct(F.lit(1).alias("level"), sec.alias("label")),
        F.struct(F.lit(2).alias("level"), cls.alias("label")),
        F.struct(F.lit(3).alias("level"), sub.alias("label"))))
    return j.select("doc_id", sec.alias("section"), levels.alias("l")) \
        .select("doc_id", "l.level", "l.label", "section")


def label_paths_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, section, class, subclass) distinct, one per lineitem path."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey)
    cls = F.concat(F.col("p_type"), F.lit("-"), F.col("p_brand"))
    return j.select(F.col("l_orderkey").alias("doc_id"), F.col("p_type").alias("section"),
                    cls.alias("class"),
                    F.concat(cls, F.lit("-"), F.col("p_size").cast("string")).alias("subclass")
                    ).distinct()


def doc_labels_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, level, label, section), distinct."""
    paths = label_paths_multi(spark, sf_dir)
    levels = F.explode(F.array(
        F.struct(F.lit(1).alias("level"), F.col("section").alias("label")),
        F.struct(F.lit(2).alias("level"), F.col("class").alias("label")),
        F.struct(F.lit(3).alias("level"), F.col("subclass").alias("label"))))
    return paths.select("doc_id", "section", levels.alias("l")) \
        .select("doc_id", "l.level", "l.label", "section").distinct()


def label_code(label: F.Column) -> F.Column:
    """Small integer derived from a label's characters (same in SQL)."""
    return F.ascii(label) + F.lit(3) * F.ascii(F.substring(label, 2, 1)) + F.length(label)


def predictions_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse section predictions per order: (doc_id, label, y_true, score).

    Candidates are the order's true sections plus distractor sections taken
    from the part whose key equals the line's supplier key.  The score is
    integer arithmetic ((37 doc + 11 code) mod 13 - 6 + 5 y_true) so SQL
    reproduces it bit for bit."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    true_s = li.join(p, li.l_partkey == p.p_partkey) \
        .select(F.col("l_orderkey").alias("doc_id"), F.col("p_type").alias("label")).distinct()
    distract = li.join(p, li.l_suppkey == p.p_partkey) \
        .select(F.col("l_orderkey").alias("doc_id"), F.col("p_type").alias("label"))
    cand = true_s.unionByName(distract).distinct()
    t = true_s.withColumn("y_true", F.lit(1))
    j = cand.join(t, ["doc_id", "label"], "left").fillna(0, ["y_true"])
    score = (F.pmod(F.col("doc_id") * 37 + label_code(F.col("label")) * 11, F.lit(13))
             - 6 + 5 * F.col("y_true")).cast("double")
    return j.select("doc_id", "label", F.col("y_true").cast("int").alias("y_true"),
                    score.alias("score"))


def section_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct()


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, metric, epoch, ts, value) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"),
                    F.dayofmonth("ts").alias("epoch"), "ts", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
