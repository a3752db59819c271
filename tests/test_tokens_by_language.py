import hashlib

from sparkwell.plans import text


def test_each_document_loses_the_stop_words_of_its_language(spark, tmp_path):
    rows = [(1, "Der Roboter und die Plattform sind in der Halle", None, None), (2, "The robot and the platform are in the hall", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, title string, path string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["n_distinct"], r["digest"]) for r in text.QUERIES["tokens_by_language"](spark, str(tmp_path)).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert got == {1: (3, 3, md5("roboter plattform halle")), 2: (3, 3, md5("robot platform hall"))}
