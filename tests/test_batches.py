"""Documents without a token have one empty batch."""
import pyarrow as pa
import pyarrow.parquet as pq

from corpusmill.plans import q_parts as QP


def test_texts_without_tokens(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array([1, 2, 3, 4, 5], pa.int64()), "text": ["", " ... ", None, "one", "a b c"]}),
                   str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QP.token_batches(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 0, None, None), (2, 1, 0, None, None), (3, 1, None, None, None), (4, 1, 1, "one", "one"), (5, 1, 3, "a", "c")]
