"""The pipeline's stages take dirty tables, keep clean documents and carry their decisions on."""

import corpus_pipeline

from test_operators import DOCS, words


def test_stages_on_dirty_rows(spark, tmp_path):
    base = words(1, 80)
    bench = words(2, 30)
    texts = [base, base, base + " more", words(3, 60), words(4, 30) + " " + bench, 'words with token = "abcdef123456"', None, "", "123 456", words(5, 3000)]
    rows = [(i, t, "en" if i % 2 else None, None, None, "x") for i, t in enumerate(texts)] + [(None, words(6, 50), "en", "s", 1, "x")] * 2
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame([(0, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"s{i}")
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {0, 3, 5, 9, None} and docs.count() == 5
    assert "abcdef123456" not in got[5].text and got[5].text.startswith("words with ")
    assert all(r.roundtrip for r in got.values())
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, docs.collect()))


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
