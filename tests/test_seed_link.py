from sparkwell.operators import graph
from sparkwell.plans import graph as plans


def test_names_link_wherever_they_stand(spark, tmp_path):
    text = "# Title\none\ntwo\nthree\nThe cart of ZEGUVAN works waits."
    docs = [(1, text), (2, "Jutasum的样机在这里。"), (3, "The Old Tegeson waits; Tegeso waits."), (4, None), (5, ""), (6, "x9 stands")]
    entities = [("COMPANY:zeguvan works", "Zeguvan Works"), ("PRODUCT:jutasum", "Jutasum"), ("COMPANY:tegeson ag", "Tegeson AG"), ("PRODUCT:x9", "X9"), ("PRODUCT:none", None), ("PRODUCT:blank", " ")]
    mentions = [("COMPANY: Tegeson  AG. ", " old tegeson"), ("COMPANY:unknown", "cart"), (None, "waits"), ("PRODUCT:x9", None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(entities, "id string, name string").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame(mentions, "entity_id string, surface string").write.parquet(f"{tmp_path}/mentions.parquet")
    spark.createDataFrame([(7, "关于Jutasum的问题"), (8, None)], "item_id long, question string").write.parquet(f"{tmp_path}/golden_items.parquet")
    got = sorted(tuple(r) for r in plans.seed_link(spark, str(tmp_path)).collect())
    assert got == [(1, "COMPANY:zeguvan works"), (2, "PRODUCT:jutasum"), (3, "COMPANY:tegeson ag"), (6, "PRODUCT:x9")]
    assert [tuple(r) for r in plans.QUERIES["seed_link_questions"](spark, str(tmp_path)).collect()] == [(7, "PRODUCT:jutasum")]
    names = plans._names(spark, str(tmp_path))
    again = graph.link_names(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text", names, shard_names=1)
    assert sorted(tuple(r) for r in again.collect()) == got
