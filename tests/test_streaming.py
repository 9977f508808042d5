"""2.13: new documents into the index; a batch counts once whatever is repeated."""
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from corpusmill.operators.postings import build_postings, doc_freq
from corpusmill.sources.io import table
from corpusmill.streaming import incremental as inc
from tests.conftest import ROOT, SF_SMALL


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ingest_compact_and_repeat_equal_batch(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    base = tempfile.mkdtemp(prefix="cm-stream-")
    src, out, ckpt = f"{base}/src", f"{base}/index", f"{base}/ckpt"

    def ingest(part, rest):
        docs.filter(F.col("doc_id") % 3 == rest).coalesce(1).write.parquet(f"{src}/{part}")
        inc.start_ingest(spark, f"{src}/*", out, ckpt, max_files=1).awaitTermination(120)

    def expect(*rests):
        want = build_postings(docs.filter((F.col("doc_id") % 3).isin(*rests)))
        post, df = inc.read_index(spark, out)
        return same(post, want) and same(df, doc_freq(want))
    ingest("p0", 0)
    assert expect(0) and inc.committed(spark, out) == [0]
    ingest("p1", 1)
    assert expect(0, 1)
    assert inc.compact(spark, out) == 2 and inc.compact(spark, out) == 0
    assert expect(0, 1) and inc.generation(spark, out)["covered"] == 1
    # a batch that is repeated behind the compaction adds nothing
    inc.add_batch(docs.filter(F.col("doc_id") % 3 == 1), 1, out)
    assert expect(0, 1)
    inc.vacuum(spark, out)
    assert expect(0, 1) and inc.committed(spark, out) == []
    ingest("p2", 2)
    assert expect(0, 1, 2) and inc.committed(spark, out) == [2]
    assert inc.compact(spark, out) == 1 and expect(0, 1, 2)
    inc.vacuum(spark, out)
    assert expect(0, 1, 2)


def test_an_epoch_without_commit_is_not_read(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    out = f"{tempfile.mkdtemp(prefix='cm-stream-')}/index"
    inc.add_batch(docs.limit(5), 0, out)
    build_postings(docs).write.parquet(f"{out}/epochs/1/postings")      # lost before its df and commit
    assert same(inc.read_df(spark, out), doc_freq(build_postings(docs.limit(5))))
    inc.add_batch(docs.limit(9), 1, out)                                 # the retry overwrites
    assert inc.read_postings(spark, out).select("doc_id").distinct().count() <= 14


def test_df_does_not_read_the_postings(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    out = f"{tempfile.mkdtemp(prefix='cm-stream-')}/index"
    inc.add_batch(docs.limit(5), 0, out)
    assert all("/df/" in f for f in inc.read_df(spark, out).inputFiles())


RUN = """
import sys
sys.path.insert(0, {root!r})
from corpusmill.session import get_spark
from corpusmill.streaming import incremental as inc
spark = get_spark("local[2]", shuffle_partitions=2)
inc.start_ingest(spark, {src!r}, {out!r}, {ckpt!r}, max_files=1).awaitTermination(120)
spark.stop()
"""


def test_restart_in_another_process_goes_on(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text").limit(40)
    base = tempfile.mkdtemp(prefix="cm-stream-")
    src, out, ckpt = f"{base}/src", f"{base}/index", f"{base}/ckpt"
    docs.filter("doc_id % 2 = 0").coalesce(1).write.parquet(f"{src}/a")
    inc.start_ingest(spark, f"{src}/*", out, ckpt, max_files=1).awaitTermination(120)
    docs.filter("doc_id % 2 = 1").coalesce(1).write.parquet(f"{src}/b")
    subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, src=f"{src}/*", out=out, ckpt=ckpt)], check=True, timeout=200)
    assert inc.committed(spark, out) == [0, 1]
    post, df = inc.read_index(spark, out)
    assert same(post, build_postings(docs)) and same(df, doc_freq(build_postings(docs)))


def test_nothing_ingested(spark):
    out = f"{tempfile.mkdtemp(prefix='cm-stream-')}/index"
    assert inc.read_df(spark, out).count() == 0 and inc.compact(spark, out) == 0
