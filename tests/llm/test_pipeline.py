import corpus_pipeline
import public_tokenizers
import sentencepiece
from corpusmill.llm.quality import quality
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import shingle_set
from tests.llm.test_secrets import base_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "secrets", "pieces"]
    kept = {r["id"] for r in quality(docs).filter("kept").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL).cache()
        assert docs.columns == COLUMNS
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(now) and set(now) <= set(before)
        if name == "quality":
            assert set(now) == kept
        if name == "near_duplicates":
            sets = {i: shingle_set(t) for i, t in before.items()}
            for i in set(before) - set(now):            # what went has a kept partner, in these shallow groups
                assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in now)
            left = [sets[j] for j in now]
            assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(left) for b in left[:k])
        if name == "decontaminate":
            dirty = {i for i, _, n, _ in leaks(before.items(), items) if n}
            assert dirty and set(now) == set(before) - dirty
        if name == "secrets":
            changed = {i for i in now if now[i] != before[i]}
            assert set(now) == set(before) and changed >= {i for i, t in before.items() if base_spans(t)}
        before = now
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECE_MODEL))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r["doc_id"] for r in out} == set(before)
    for r in out:
        assert r["ids"] == lib.encode(before[r["doc_id"]]) and r["decoded"] == lib.decode(r["ids"])


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF_SMALL).columns == ["doc_id", "ids", "decoded"]


def test_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, kept boolean"
    prose = " ".join(f"word{i % 97} and{i}" for i in range(60)) + "."
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, prose, None, None, None), (4, prose, "en", "a", 5),
            (4, prose, "en", "a", 5), (5, prose[::-1], "en", "a", 5)]
    for name, part in (("none", []), ("odd", rows)):
        at = str(tmp_path / name)
        spark.createDataFrame([(*r, "x", True) for r in part], schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, None), (2, "not in there at all")], "item_id long, text string") \
            .write.parquet(f"{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        assert [r["doc_id"] for r in sorted(out, key=lambda r: r["doc_id"] or 0)] == ([None, 5] if part else [])
        if part:
            assert out[0]["decoded"] and {r["decoded"] for r in out} == {prose, prose[::-1]}
