"""L1: a label that has converged is left out of the passes; splits and labels are joined by kinds, so no entries are shuffled for them."""
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.operators import linear as Ln
from corpusmill.plans import q_models as QM


def test_converged_labels_get_no_gradient():
    rng = np.random.default_rng(3)
    w, live = rng.standard_normal((20, 4)).astype(np.float32), np.array([0, 1, 3])
    batch = pa.RecordBatch.from_pydict({"indices": pa.array([[1, 4], [2], []], pa.list_(pa.int32())), "values": [[0.5, 2.0], [1.0], []],
                                        "labels": pa.array([[10, 12], [13], [11]], pa.list_(pa.int32()))})

    def gradient(on):
        out = next(Ln._gradients(SimpleNamespace(value=(w[:, on], on)), 10)([batch]))
        return np.frombuffer(dict(zip(out["piece"].to_pylist(), out["g"].to_pylist(), strict=True))[0], np.float32).reshape(20, len(on))
    assert np.allclose(gradient(live), gradient(np.arange(4))[:, live], atol=1e-6) and gradient(live).any()


def test_predictions_shuffle_no_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(QM, "SVM_ITERATIONS", 3)
    rows = [(i, f"alpha beta word{i % 4} alpha", "en" if i % 3 else "de", f"s{i % 2}") for i in range(60)]
    rows += [(3, "alpha beta", "en", "s1"), (None, "alpha beta", "en", "s0"), (61, None, "de", None), (62, "alpha word1", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 3) for i in range(40)] + [(5, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = QM._svm_predictions(spark, str(tmp_path), "train")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Exchange hashpartitioning\(doc_id", plan)
    from corpusmill.plans import fixtures as fx
    from corpusmill.plans import q_splits as QS
    dl, sp = fx.doc_labels_single(spark, str(tmp_path)), QS.stored_splits(spark, str(tmp_path)).filter("split = 'train'")
    true = {tuple(r) for r in dl.join(sp.select("doc_id"), "doc_id").filter("label is not null").select("doc_id", "level", "label").collect()}
    got = out.collect()
    assert {(r["doc_id"], r["level"], r["label"]) for r in got if r["y_true"]} == true
    times = dict(map(tuple, fx.documents(spark, str(tmp_path)).join(sp, "doc_id").groupBy("doc_id").count().collect()))
    labels = dl.select("level", "label").distinct().count()
    assert len(got) == labels * sum(times.values())
    assert QM._entries(spark, str(tmp_path)).filter(F.col("doc_id").isNull()).select("kind").first()[0] is None
