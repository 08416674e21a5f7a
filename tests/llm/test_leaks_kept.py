from quernstone.llm.queries import QUERIES


def test_leaking_documents_are_removed(spark, tmp_path):
    docs = [(1, "we saw the secret item today"), (2, "nothing here"), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "The secret item")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(tuple(r) for r in QUERIES["p8_kept"](spark, str(tmp_path)).collect()) == docs[1:]
