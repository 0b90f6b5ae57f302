"""Tables by id range: what an update touches, and what is left of one that dies."""

from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.sources import store as S
from ringfold.sources.store import BucketedTable, RangedTable

ROWS = "subscriber_id long, calls long"


def table(spark, tmp_path, n=100):
    made = RangedTable(str(tmp_path / "t"), 10)
    made.upsert(spark.range(n).select(F.col("id").alias("subscriber_id"), F.lit(0).cast("long").alias("calls")))
    return made


def files(tmp_path):
    """The Parquet files of each range, by name and time."""
    found = {}
    for f in Path(tmp_path / "t" / "rows").glob("id_range=*/*.parquet"):
        found.setdefault(int(f.parent.name.split("=")[1]), set()).add((f.name, f.stat().st_mtime_ns))
    return found


def counts(spark, of):
    return {r.subscriber_id: r.calls for r in of.read(spark).collect()}


def test_only_the_ranges_of_changed_keys_are_written(spark, tmp_path):
    ranged = table(spark, tmp_path)
    before = files(tmp_path)
    assert sorted(before) == list(range(10))
    assert ranged.upsert(spark.createDataFrame([(31, 5), (39, 6), (250, 7)], ROWS)) == [3, 25]
    after = files(tmp_path)
    assert {r for r in after if after[r] != before.get(r)} == {3, 25}
    assert counts(spark, ranged) == {i: 0 for i in range(100)} | {31: 5, 39: 6, 250: 7}
    assert ranged.upsert(spark.createDataFrame([], ROWS)) == []
    assert files(tmp_path) == after
    assert not (tmp_path / "t" / "plan").exists() and not (tmp_path / "t" / "pending").exists()


def test_lookup_reads_the_ranges_of_its_keys(spark, tmp_path):
    ranged = table(spark, tmp_path)
    found = ranged.lookup(spark.createDataFrame([(31,), (31,), (77,), (999,)], "subscriber_id long"))
    assert sorted(r.subscriber_id for r in found.collect()) == [31, 77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [id_range#" in plan and " IN (3,7,99)" in plan
    assert all("id_range=3/" in f or "id_range=7/" in f for f in found.inputFiles()) or len(found.inputFiles()) == 10


def test_keys_are_unique(spark, tmp_path):
    ranged = table(spark, tmp_path)
    with pytest.raises(ValueError, match="31 is not unique"):
        ranged.upsert(spark.createDataFrame([(31, 5), (31, 6)], ROWS))
    with pytest.raises(ValueError, match="None"):
        ranged.upsert(spark.createDataFrame([(None, 5)], ROWS))
    assert counts(spark, ranged) == dict.fromkeys(range(100), 0)


class Died(Exception):
    pass


@pytest.mark.parametrize("where, done", [("pending", False), ("plan", False), ("planned", True), ("rows", True)])
def test_an_update_that_dies_is_finished_or_undone(spark, tmp_path, monkeypatch, where, done):
    """At each of its writes in turn; then the next update succeeds, as does the same one again."""
    ranged = table(spark, tmp_path)
    change = spark.createDataFrame([(31, 5), (77, 6)], ROWS)
    parts, recover = RangedTable._by_range, RangedTable.recover

    def dying(rows: DataFrame, path: str, overwrite: bool = False) -> None:
        if where == "pending" and "pending" in path:
            parts(rows.where("id_range = 3"), path)  # half of it is there
            raise Died
        if where == "rows" and path.endswith("/rows"):
            parts(rows.where("id_range = 3"), path, overwrite)  # one of two ranges is new
            raise Died
        parts(rows, path, overwrite)

    def recovering(self, spark):
        if (tmp_path / "t" / "plan").exists():
            if where == "plan":  # a plan that was not written to its end
                half = spark.read.parquet(f"{self.root}/plan").limit(1).collect()
                spark.createDataFrame(half).write.mode("overwrite").parquet(f"{self.root}/plan")
                raise Died
            if where == "planned":
                raise Died
        recover(self, spark)

    with monkeypatch.context() as patch:
        patch.setattr(RangedTable, "_by_range", staticmethod(dying))
        patch.setattr(RangedTable, "recover", recovering)
        with pytest.raises(Died):
            ranged.upsert(change)
    if where != "rows":
        assert counts(spark, ranged) == dict.fromkeys(range(100), 0)
    ranged.upsert(spark.createDataFrame([(12, 9)], ROWS))
    want = dict.fromkeys(range(100), 0) | {12: 9}
    assert counts(spark, ranged) == (want | {31: 5, 77: 6} if done else want)
    ranged.upsert(change)
    assert counts(spark, ranged) == want | {31: 5, 77: 6}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_move_nothing(spark, tmp_path):
    names = iter("abcdef")
    made = lambda n=4: BucketedTable(f"test_buckets_{(x := next(names))}", f"{tmp_path}/{x}", n)
    wide, changed, now, other = made(), made(), made(), made(8)
    wide.write(spark.range(100).select(F.col("id").alias("subscriber_id"), F.lit(0).cast("long").alias("calls")))
    changed.write(spark.createDataFrame([(31, 5), (250, None)], ROWS).select("calls", "subscriber_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide.upserted(spark, changed, now)
        assert {r.subscriber_id: r.calls for r in now.read(spark).collect()} == {i: 0 for i in range(100)} | {31: 5, 250: None}
        assert len(list((tmp_path / "c").glob("*.parquet"))) == 4  # a file a bucket: nothing was dealt anew
        joined = now.read(spark).join(wide.read(spark), "subscriber_id", "left_semi")
        assert "Exchange" not in plan_of(joined) and joined.count() == 100
        assert "Exchange" not in plan_of(S.lookup(wide.read(spark), changed.read(spark)))
        full = wide.read(spark).alias("a").join(changed.read(spark).alias("b"), "subscriber_id", "full")
        assert "Exchange" not in plan_of(full)
        assert "Exchange" in plan_of(now.read(spark).join(spark.range(5).withColumnRenamed("id", "subscriber_id"), "subscriber_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    other.write(wide.read(spark))
    with pytest.raises(ValueError, match="do not meet"):
        wide.upserted(spark, other, now)


def test_footers_answer(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("y"), (F.col("id") % 3).cast("int").alias("part"))
    rows.write.partitionBy("part").parquet(f"{tmp_path}/t")
    found = S.footer_aggregates(spark, f"{tmp_path}/t", ("x", "y"), "part", F.col("part") > 0)
    plan = plan_of(found)
    assert "PushedAggregation: [COUNT(*), MIN(x), MAX(x), MIN(y), MAX(y)]" in plan and "PushedGroupBy: [part]" in plan
    assert sorted(map(tuple, found.collect())) == [(1, 333, 0.0, 6.0, 4, 994), (2, 333, 0.0, 6.0, 2, 998)]
    assert tuple(S.footer_aggregates(spark, f"{tmp_path}/t", ("y",)).first()) == (1000, 0, 998)
    with pytest.raises(ValueError, match="do not answer"):
        S.footer_aggregates(spark, f"{tmp_path}/t", ("x",), where=F.col("y") > 5)
    with pytest.raises(ValueError, match="do not answer"):
        S.footer_aggregates(spark, f"{tmp_path}/t", ("x",), "y")
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
