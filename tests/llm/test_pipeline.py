import pytest
from pyspark.sql import functions as F

from ringfold.llm import mixing, quality, toxicity
from tests.llm.test_documents import brute_components, labelled

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_order(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    docs = docs.unionByName(docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 5000))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert not any(i >= 5000 for i in ids["near_duplicates"] if i)  # copies of smaller ids
    assert ids["toxicity"] > ids["quality"] > ids["near_duplicates"] >= ids["mixing"] == ids["bpe"]
    assert now.where("not decodes").count() == 0
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.place for r in done.select("place").collect()) == list(range(now.count()))


def test_training_order_survives_the_files(spark, tmp_path):
    """Rows come back in any order; their place is that of the curriculum, over several files."""
    docs = labelled(spark, 500)[0].withColumn("copy", F.lit("own"))
    ordered = mixing.curriculum(docs, mixing.plan(docs))
    assert ordered.columns == ["doc_id", "text", "source", "lang", "copy_before", "copy", "position"]
    ordered.write.option("maxRecordsPerFile", 40).parquet(f"{tmp_path}/mixed")
    assert len(list((tmp_path / "mixed").glob("*.parquet"))) > 5
    rows = mixing.stored_order(spark.read.parquet(f"{tmp_path}/mixed")).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(len(rows)))
    assert [r.position for r in rows] == sorted(r.position for r in rows) and {r.copy_before for r in rows} == {"own"}


def test_pipeline_of_empty_and_null_rows(spark, tmp_path):
    docs, labels = labelled(spark, 60)
    for name, rows in (("none", docs.limit(0)), ("nulls", docs.withColumn("text", F.lit(None).cast("string")))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").where("n_tokens > 0").count() == 0


def test_pipeline_is_its_stages_by_hand(spark, tmp_path):
    """Against plain Python on what each operator decides: who goes, who stays, how often, and the ids."""
    docs, labels = labelled(spark, 300)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.collect()
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    rows = [r for r in rows if r.doc_id not in toxic]
    clean = spark.createDataFrame(rows, docs.schema)
    good = {r.doc_id for r in quality.quality(clean, labels).collect() if r.kept}
    rows = [r for r in rows if r.doc_id in good]
    texts = [r.text for r in rows]
    groups = brute_components(texts)
    first = {}
    for r, (_, n, group, _) in zip(rows, groups):
        if n and (group not in first or (r.doc_id is None, r.doc_id or 0) < (first[group].doc_id is None, first[group].doc_id or 0)):
            first[group] = r
    kept = [*first.values(), *{(r.doc_id, r.text): r for r, (_, n, _, _) in zip(rows, groups) if not n}.values()]
    mixed = {r.doc_id: r.taken // r["size"] for r in mixing.taken(spark.createDataFrame(kept, docs.schema)).collect() if r["size"]}
    expected = sorted((str(r.doc_id), mixed[r.doc_id]) for r in kept if mixed.get(r.doc_id))
    found = corpus_pipeline.run(spark, str(tmp_path)).where("n_tokens > 0").groupBy("doc_id").count().collect()
    assert sorted((str(r.doc_id), r["count"]) for r in found) == expected
