import pytest

import corpus_pipeline
from panelspark.llm import mixing, pieces, secrets, simhash, toxicity


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) <= 2 * before and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert len({r.doc_id for r in out}) < before


EXTRA = "row spans key digest least same nth lo hi place start node _text".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, empty):
    """Nulls, empty texts, copies, repeated rows and columns named like those that stages make."""
    long = "plain words of a text that goes on and on. " * 3000
    rows = [(1, "one two three four five six", "s"), (2, "one two three four five six", "t"), (2, "one two three four five six", "t"), (3, "", None), (4, None, "s"), (None, "no id at all here my friend", "s"), (5, long, "u"), (6, "token = abcdefgh12 and more words", "")]
    docs = spark.createDataFrame([] if empty else [(i, t, "en", s, len(t or ""), *[7] * len(EXTRA)) for i, t, s in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(1, 0), (5, 1), (6, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in out) and (not out if empty else {r.doc_id for r in out} <= {1, 2, 5, 6, None} and out)
    kept = toxicity.drop_toxic(docs, toxicity.Model())
    assert kept.columns == docs.columns and kept.count() == docs.count()
    distinct = simhash.drop_near_duplicates(docs)
    assert distinct.columns == docs.columns and distinct.count() == (0 if empty else 5)
    masked = secrets.mask_secrets(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and pieces.encoded_documents(mixed).count() == mixed.count()
