from pyspark.sql import functions as F

import corpus_pipeline
from palaver.llm import queries
from palaver.llm.mixing import memberships
from palaver.llm.toxicity import classify_toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NICE = "the committee met again on tuesday to talk about the new bridge over the river"


def through(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, s, "x", 1) for s, (i, t) in enumerate(rows)], SCHEMA.replace("lang string", "lang int"))
    return docs, sorted(stage(spark, docs, SF).select("lang", "doc_id", "text").collect())


def test_toxic_rows_alone_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = classify_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).join(docs.select("doc_id", "text"), "doc_id")
    rude = scored.where("predicted = 1").orderBy("score", ascending=False).first().text
    rows = [(None, rude), (None, NICE), (7_000_001, rude), (7_000_001, NICE), (7_000_002, NICE), (None, None)]
    more = spark.createDataFrame([(i, t, "en", f"own{k}", 1) for k, (i, t) in enumerate(rows)], SCHEMA).select(*docs.columns)
    got = corpus_pipeline.drop_toxic(spark, docs.unionByName(more), SF)
    assert got.columns == docs.columns
    assert sorted(r.source for r in got.where("source like 'own%'").collect()) == ["own1", "own3", "own4", "own5"]


def test_one_row_of_equal_texts_stays(spark):
    rows = [(5, "a b"), (5, "a b"), (5, "other"), (3, "o t h e r"), (None, "a  b"), (None, "alone"), (None, "twice"), (None, "twice"), (9, "same"), (4, "same"), (None, "same"), (6, None), (2, "")]
    _, got = through(spark, corpus_pipeline.drop_copies, rows)
    assert {r.lang for r in got} - {6, 7} == {3, 4, 5, 9, 12} and len(got) == 6


def test_one_row_of_near_copies_stays(spark):
    far = "quite another text about the price of apples in the town market last winter"
    rows = [(8, NICE), (8, NICE), (2, NICE + " today"), (None, NICE + " now"), (8, far), (None, far + " too"), (None, "lone words of one row"), (None, None), (1, ""), (1, "")]
    _, got = through(spark, corpus_pipeline.drop_near_copies, rows)
    assert [r.lang for r in got] == [2, 4, 6, 7, 8, 9]


def test_mix_meets_the_targets(spark):
    dir_ = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{dir_}/documents.parquet")
    domains = sorted(queries.TARGETS)
    members = memberships(docs, queries.labelled_domains(spark, dir_), domains).withColumnRenamed("doc_id", "id")
    mixed = corpus_pipeline.mix(spark, docs, dir_).join(members, F.col("doc_id").eqNullSafe(F.col("id")))
    sums = mixed.agg(*[F.sum(F.col("n_tokens") * F.col("p")[k]) for k in range(len(domains))], F.countDistinct("doc_id")).first()
    for d, x in zip(domains, sums, strict=False):
        assert abs(x / sum(sums[: len(domains)]) - queries.TARGETS[d]) < 0.02
    assert sums[-1] == docs.where("doc_id is not null").select("doc_id").distinct().count()


def test_names_that_the_mixture_uses_itself(spark):
    from palaver.llm.mixing import apply_copies

    names = ["doc_id", "__id", "__copies", "__copy", "id", "row", "copies", "col", "a.b"]
    docs = spark.createDataFrame([(1, *"abcdefgh"), (None, *"ijklmnop"), (2, *"qrstuvwx")], "doc_id long, " + ", ".join(f"`{n}` string" for n in names[1:]))
    plan = spark.createDataFrame([(1, 2), (None, 1), (2, 0)], "doc_id long, copies long")
    got = apply_copies(docs, plan)
    assert got.columns == names and sorted(map(tuple, got.collect()), key=repr) == sorted([(1, *"abcdefgh")] * 2 + [(None, *"ijklmnop")], key=repr)


def test_the_pipeline_of_no_rows_and_of_no_texts(spark, tmp_path):
    import pyarrow.parquet as pq

    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)], "doc_id long, quality int, toxic int")
    for name, rows in (("none", []), ("nulls", [(k, None, "en", None, None, "x") for k in range(4)] + [(None, None, None, None, None, None)])):
        (tmp_path / name).mkdir()
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{tmp_path}/{name}/documents.parquet")  # a file, also without rows
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").select("doc_id").distinct().collect()
        assert [r.doc_id for r in got] == ([] if name == "none" else [0])  # all empty texts are copies of the first
