"""What the pipeline's filters leave on disk when their rows are asked for."""

import pytest

from ringfold import storage
from ringfold.llm import minhash, quality
from tests.llm.test_documents import labelled, near_texts


@pytest.fixture
def left(tmp_path, monkeypatch):
    """A function that gives the columns of each stored table that has files, by name."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")

    def of(spark):
        folders = [p for p in (tmp_path / "ringfold").iterdir() if p.is_dir()]
        return {p.name.rsplit("-", 1)[0]: spark.read.parquet(str(p)).columns for p in folders if list(p.glob("*.parquet"))}

    return of


def test_keep_one_leaves_no_sketches_and_sets(spark, left):
    docs = spark.createDataFrame(list(enumerate(near_texts())), "doc_id long, text string")
    kept = minhash.keep_one(docs)
    found = left(spark)
    assert not {"sketch", "classes", "sets", "known", "members", "buckets", "hubs", "groups"} & found.keys()
    assert "dropped" in found
    expected = minhash.near_duplicates(docs).where("kept or n_shingles = 0").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in expected)


def test_keep_good_stores_no_texts(spark, left):
    docs, labels = labelled(spark, 200)
    kept = quality.keep_good(docs, labels)
    found = left(spark)
    assert "priors" in found and "bins" not in found
    assert not any({"row", "text"} & set(columns) for columns in found.values())
    expected = quality.quality(docs, labels).where("kept").select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(r.doc_id) for r in expected)


def test_keep_good_bins_texts_once_in_a_task(spark, left):
    """No filter that Spark infers from the join bins them before, by Python workers of its own."""
    kept = quality.keep_good(*labelled(spark, 200))
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
