"""The stage store."""
import pytest

from corpusmill.session import materialize
from corpusmill.sources import stages as St


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(St, "_folder", lambda s: str(tmp_path / "stages"))
    path = str(tmp_path / "in.parquet")
    spark.range(5).coalesce(1).write.parquet(path)
    return path


def test_reused_only_on_a_matching_manifest(spark, store):
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(store).withColumnRenamed("id", "x")

    def get(**params):
        return St.stage(spark, "twice", [store], build, params).count()
    assert get(a=1) == get(a=1) == 5 and len(calls) == 1
    assert get(a=2) == 5 and len(calls) == 2                  # another parameter
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(store)
    assert get(a=1) == 8 and len(calls) == 3                  # another file in the input
    assert get(a=1) == 8 and len(calls) == 3


def test_same_size_but_rewritten_input_is_noticed(spark, store):
    before = St.listing(spark, store)
    spark.range(5, 10).coalesce(1).write.mode("overwrite").parquet(store)
    after = St.listing(spark, store)
    assert before[0] == after[0] and before != after
    assert St.listing(spark, store + "-absent") == [0, 0, 0]


def test_unfinished_build_is_not_read(spark, store):
    def fail():
        raise RuntimeError("stop")
    with pytest.raises(RuntimeError):
        St.stage(spark, "s", [store], fail)
    assert St.stages(spark) == []
    assert St.stage(spark, "s", [store], lambda: spark.range(3)).count() == 3


def test_loser_of_a_race_takes_the_winners_table(spark, store):
    def late():
        St.stage(spark, "race", [store], lambda: spark.range(7))      # another session finishes first
        return spark.range(2)
    assert St.stage(spark, "race", [store], late).count() == 7


def test_release(spark, store):
    St.stage(spark, "kept", [], lambda: spark.range(1))
    St.stage(spark, "old", [store], lambda: spark.range(1))
    assert St.release(spark) == []
    spark.range(1).write.mode("append").parquet(store)
    assert St.release(spark) == ["old"] and [s["stage"] for s in St.stages(spark)] == ["kept"]
    assert St.release(spark, everything=True) == ["kept"] and St.stages(spark) == []


def test_release_temporary(spark):
    St.release_temporary(spark)
    df = materialize(spark.range(3), "t")
    path = df.inputFiles()[0]
    assert St.release_temporary(spark) == 1
    p, fs = St._fs(spark, path)
    assert not fs.exists(p)


def test_row_blocks_are_pruned(spark, tmp_path):
    from pyspark.sql import functions as F
    from corpusmill.sources import io
    path = str(tmp_path / "blocks")
    df = spark.range(0, 1050, 1, 7).select((1050 - F.col("id")).alias("k"), F.hash("id").alias("payload"))
    io.write_row_blocks(df, [F.asc("k")], path, block_rows=100)
    got = io.read_row_blocks(spark, path, 3)
    assert [r["row_idx"] for r in got.orderBy("row_idx").collect()] == list(range(300, 400))
    assert got.filter("k = row_idx + 1").count() == 100
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(block" in plan
    assert io.read_row_blocks(spark, path, 9, 10).count() == 150
