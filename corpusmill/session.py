"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job here relies on: AQE for runtime re-planning (partition
# coalescing, skew-join splitting, broadcast conversion from measured sizes),
# UTC session time, no UI server.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "corpusmill",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster pass ``master=None`` and let spark-submit decide; in tests
    pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring it if needed.

    The cluster names its shared folder in ``spark.checkpoint.dir``; that
    value always wins.  Only when it is unset (local runs and tests) a fresh
    scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.environ.get("TMPDIR", "/tmp")
        configured = tempfile.mkdtemp(prefix="corpusmill-ckpt-", dir=base)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per context,
    so that functions in tasks import it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusmill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="corpusmill-src-"), "corpusmill.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "corpusmill")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._corpusmill_shipped = True


def temporary_paths(spark: SparkSession) -> list[str]:
    """Where :func:`materialize` has written in this session;
    :func:`corpusmill.sources.stages.release_temporary` removes them."""
    sc = spark.sparkContext
    if not hasattr(sc, "_corpusmill_temporary"):
        sc._corpusmill_temporary = []
    return sc._corpusmill_temporary


def materialize(df, name: str = "stage", partition_by: str | None = None):
    """Compute ``df`` once and cut its lineage by writing it as a Parquet
    table under the shared checkpoint folder (``spark.checkpoint.dir``), then
    reading it back.

    This is the "written table" form of a checkpoint: one columnar write
    (``Dataset.checkpoint`` would compute the plan twice and store
    row-serialized blocks), later reads get column pruning, and a lost
    executor re-reads the files instead of recomputing the stage."""
    import uuid
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/corpusmill-{name}-{uuid.uuid4().hex}"
    temporary_paths(spark).append(path)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    # with the schema given, a table without rows or partitions is read all the same
    return spark.read.schema(df.schema).parquet(path) if partition_by else spark.read.parquet(path)
