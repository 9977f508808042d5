"""Stage store (S14, S7): finished stages reused by later queries and sessions.

A stage is a Parquet table under the shared checkpoint folder.  Its manifest
names the stage, its parameters, a digest of this package's sources and, per input
path, the number of files, their bytes and a digest of their names, sizes and
times (a listing that Spark's ``binaryFile`` source spreads over the tasks; no content is read).
A stage is reused only if its manifest is equal; a changed input has another
manifest and so another folder.  The data are written first and the manifest last,
created only if absent, so a failed or concurrent build is never read and the
loser of a race takes the winner's table.

:func:`release` removes stages whose inputs have changed or gone, and
:func:`release_temporary` the unnamed tables of this session
(:func:`corpusmill.session.materialize`); call them when no query is running on them.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import checkpoint_dir, temporary_paths

FOLDER = "corpusmill-stages"
MANIFEST = "manifest.json"


@lru_cache(maxsize=1)
def code_digest() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for folder, _, names in sorted(os.walk(root)):
        if os.path.basename(folder) == "llm":       # nothing else depends on it
            continue
        for n in sorted(names):
            if n.endswith(".py"):
                with open(os.path.join(folder, n), "rb") as f:
                    h.update(n.encode() + f.read())
    return h.hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, path: str) -> list:
    """[files, bytes, digest] of a file or folder; zeros if it does not exist."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return [0, 0, 0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return list(files.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)),
        F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0))).first())


def manifest(spark: SparkSession, name: str, inputs: list[str], params: dict) -> dict:
    return {"stage": name, "params": params, "code": code_digest(),
            "inputs": {p: listing(spark, p) for p in sorted(inputs)}}


def _folder(spark: SparkSession) -> str:
    """Under the configured folder itself: Spark gives each session a folder of its own in there."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{(shared or checkpoint_dir(spark)).rstrip('/')}/{FOLDER}"


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The contents of a small JSON file, None if there is none."""
    p, fs = _fs(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(p) else None


def write_once(spark: SparkSession, path: str, content: dict) -> None:
    """Write a small JSON file unless there is one; the first writer wins."""
    p, fs = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception:       # noqa: BLE001 - another session was first
        if not fs.exists(p):
            raise
        return
    out.write(json.dumps(content, sort_keys=True).encode())
    out.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it does not exist."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _table(data: str) -> str:
    return f"corpusmill_{data.rsplit('/', 1)[-1]}"


def _bucketed(spark: SparkSession, data: str, n: int, column: str) -> DataFrame:
    """The bucketed table at ``data``, registered in this session's catalog if another one wrote it."""
    if not spark.catalog.tableExists(_table(data)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(data).schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(data)} ({columns}) USING parquet CLUSTERED BY ({column}) INTO {n} BUCKETS LOCATION '{data}'")
    return spark.table(_table(data))


def stage(spark: SparkSession, name: str, inputs: list[str], builder: Callable[[], DataFrame], params: dict | None = None,
          partition_by=None, buckets: tuple[int, str] | None = None) -> DataFrame:
    """The stored table of this stage if its manifest matches, else ``builder()`` written and reread.

    ``buckets`` (number, column): the table is written in buckets, so that what groups or joins by the column later
    needs no shuffle; the rows should come dealt to that many tasks by the column, each of which then writes one file."""
    want = manifest(spark, name, inputs, params or {})
    folder = f"{_folder(spark)}/{name}-{hashlib.sha1(json.dumps(want, sort_keys=True).encode()).hexdigest()}"
    at = f"{folder}/{MANIFEST}"
    found = read_json(spark, at)
    if found is None or {k: v for k, v in found.items() if k not in ("data", "buckets")} != want:
        data = f"{folder}/{uuid.uuid4().hex}"
        writer = builder().write.mode("errorifexists")
        if buckets:
            writer.format("parquet").bucketBy(*buckets).option("path", data).saveAsTable(_table(data))
        else:
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(data)
        write_once(spark, at, {**want, "data": data, **({"buckets": buckets} if buckets else {})})
        found = read_json(spark, at)
    return _bucketed(spark, found["data"], *found["buckets"]) if "buckets" in found else spark.read.parquet(found["data"])


def stages(spark: SparkSession) -> list[dict]:
    """The manifests of all finished stages, each with its ``folder``."""
    out = []
    for n in names(spark, _folder(spark)):
        at = f"{_folder(spark)}/{n}"
        found = read_json(spark, f"{at}/{MANIFEST}")
        if found is not None:
            out.append({**found, "folder": at})
    return out


def release(spark: SparkSession, everything: bool = False) -> list[str]:
    """Remove the stages whose inputs or code differ from now (or all); returns their names."""
    gone = []
    for s in stages(spark):
        if everything or s["code"] != code_digest() or any(listing(spark, p) != list(v) for p, v in s["inputs"].items()):
            delete(spark, s["folder"])
            gone.append(s["stage"])
    return sorted(gone)


def release_temporary(spark: SparkSession) -> int:
    """Remove the tables that :func:`corpusmill.session.materialize` wrote in this session; returns their number."""
    paths = temporary_paths(spark)
    for path in paths:
        delete(spark, path)
    n = len(paths)
    paths.clear()
    return n
