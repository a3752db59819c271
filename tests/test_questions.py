from sparkwell.plans import retrieval


def test_questions_of_every_language_are_asked(spark, tmp_path):
    texts = ["The platform lifts steel pallets near the northern gate.", "阿特拉斯平台的安全标准规定了最大载荷。", "ضع الصندوق الأخضر فوق الرف الحديدي ثم ارجع.", "Die Prüfgeräte hängen über dem Förderband der Halle."]
    asked = ["Which platform lifts steel pallets?", "阿特拉斯平台的最大载荷？", "أين الصندوق الأخضر؟", "Wo hängen die Prüfgeräte?"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(asked), (0, asked[0]), (9, None)], "item_id long, question string").write.parquet(f"{tmp_path}/golden_items.parquet")
    for query in (retrieval.bm25_topk_all, retrieval.bm25_normalised_all, retrieval.hashed_search, retrieval.hybrid_rrf):
        best = {}
        for r in query(spark, str(tmp_path)).orderBy("qid", "score").collect():
            best[r["qid"]] = r["doc_id"]
        assert best == {k: k for k in range(4)}, query.__name__
    assert {r["qid"] for r in retrieval.retrieved_answers(spark, str(tmp_path)).collect()} == {0, 1, 2, 3}
