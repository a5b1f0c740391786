import hashlib
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loamstone.operators.incremental import PartitionedTarget, changed_partitions, changed_records, fingerprints, open_run_changes

T = datetime(2031, 1, 1)
RUNS = "run_id bigint, source_id string, status string, index_profile_hash string"
SCANNED = "run_id bigint, doc_id string, source_id string, text string, metadata_json string, content_hash string, mtime timestamp"
MANIFEST = "doc_id string, content_hash string, index_profile_hash string, source_id string, run_id bigint, indexed_at timestamp"


def sha(text, meta="{}"):
    return hashlib.sha256(f"{text}\n{meta}".encode()).hexdigest()


def changes(spark, runs, scanned, manifest, **kw):
    out = open_run_changes(spark.createDataFrame(scanned, SCANNED), spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(runs, RUNS), **kw)
    return sorted((r["run_id"], r["doc_id"]) for r in out.collect())


def test_open_run_against_successful_runs(spark):
    runs = [(1, "s", "ok", "p"), (2, "s", "failed", "p"), (3, "s", "open", "p"), (5, "t", "open", "q"), (4, "t", "ok", "p")]
    later = datetime(2031, 1, 2)
    scanned = [
        (3, "same", "s", "a", "{}", None, T), (3, "new", "s", "b", "{}", sha("b"), T), (3, "changed", "s", "c2", "{}", sha("c2"), T),
        (3, "failed-only", "s", "d", "{}", sha("d"), T), (3, "twice", "s", "old", "{}", sha("old"), T), (3, "twice", "s", "e", "{}", sha("e"), later),
        (3, "null-hash", "s", "f", "{}", sha("f"), T), (3, "same", "s", "a", "{}", None, T), (5, "profile", "t", "g", "{}", sha("g"), T), (1, "not-open", "s", "z", "{}", sha("z"), T),
        (3, None, "s", "x", "{}", sha("x"), T),
    ]
    manifest = [
        ("same", sha("a"), "p", "s", 1, T), ("same", sha("a"), "p", "s", 1, T), ("changed", sha("c"), "p", "s", 1, T), ("failed-only", sha("d"), "p", "s", 2, T),
        ("twice", sha("e"), "p", "s", 1, T), ("null-hash", None, "p", "s", 1, T), ("profile", sha("g"), "p", "t", 4, T), ("unseen", sha("u"), "p", "s", 1, T),
    ]
    want = [(3, "changed"), (3, "failed-only"), (3, "new"), (3, "null-hash"), (5, "profile")]
    for n in (1, 7):
        assert changes(spark, runs, scanned, manifest, partitions=n) == want


def test_empty_tables(spark):
    assert changes(spark, [], [], []) == []
    assert changes(spark, [(1, "s", "open", "p")], [(1, "d", "s", "t", "{}", None, T)], []) == [(1, "d")]


def test_extra_and_clashing_columns_pass(spark):
    cur = spark.createDataFrame([("s", "a", "h1", "keep"), ("s", "b", "h2", "keep")], "scope string, key string, h string, _was_h string").withColumnRenamed("_was_h", "note")
    com = spark.createDataFrame([("s", "a", "h1", "other"), ("s", "b", "h9", "other")], "scope string, key string, h string, note string")
    out = changed_records(cur, com, "scope", "key", ["h"])
    assert [(r["key"], r["note"]) for r in out.collect()] == [("b", "keep")]


def test_fingerprints_do_not_depend_on_order_and_see_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "p int, v string")
    b = spark.createDataFrame([(2, None), (1, "x"), (2, None)], "p int, v string")
    c = spark.createDataFrame([(2, None), (1, "x"), (2, "null")], "p int, v string")
    fp = lambda df: fingerprints(df, ["p"], ["v"])
    assert changed_partitions(fp(a), fp(b), ["p"]).count() == 0
    assert [r[0] for r in changed_partitions(fp(a), fp(c), ["p"]).collect()] == [2]


def test_target_follows_source_and_survives_a_failed_run(spark, tmp_path):
    target = PartitionedTarget(str(tmp_path / "t"), "id", 8)
    df = spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("v"))
    assert target.run(df) == 8
    assert target.run(df) == 0
    changed = df.withColumn("v", F.when(F.col("id") == 7, -1).otherwise(F.col("v")))
    with pytest.raises(RuntimeError):
        target.run(changed, fail_before_commit=True)
    assert target.run(changed) == 1
    assert target.run(changed) == 0
    got = {r["id"]: r["v"] for r in target.read(spark).collect()}
    assert got == {i: (-1 if i == 7 else 2 * i) for i in range(100)}
    target.run(changed.filter("id < 50"))
    assert target.read(spark).count() == 50
    target.run(changed.limit(0))
    assert target.read(spark).count() == 0


def test_readers_never_see_half_a_run(spark, tmp_path):
    target = PartitionedTarget(str(tmp_path / "t"), "id", 8)
    df = spark.range(40).select(F.col("id"), F.lit(1).alias("v"))
    target.run(df)
    reader = target.read(spark)
    with pytest.raises(RuntimeError):
        target.run(df.withColumn("v", F.lit(2)), fail_before_commit=True)
    assert {r["v"] for r in target.read(spark).collect()} == {1}
    assert target.run(df.withColumn("v", F.lit(3))) == 8
    assert {r["v"] for r in reader.collect()} == {1} and {r["v"] for r in target.read(spark).collect()} == {3}
    assert target.vacuum(spark) > 0 and target.vacuum(spark) == 0
    assert sorted(tuple(r) for r in target.read(spark).collect()) == [(i, 3) for i in range(40)]
    assert target.run(df.withColumn("v", F.lit(3))) == 0


def test_number_of_partitions_is_settled_by_the_first_run(spark, tmp_path):
    df = spark.range(40).select(F.col("id"), F.lit(1).alias("v"))
    PartitionedTarget(str(tmp_path / "t"), "id", 8).run(df)
    assert PartitionedTarget(str(tmp_path / "t"), "id", 3).run(df) == 0
    assert PartitionedTarget(str(tmp_path / "u"), "id").run(df) <= 64


def test_target_drops_partitions_whose_rows_are_all_filtered(spark, tmp_path):
    target = PartitionedTarget(str(tmp_path / "t"), "id", 8)
    df = spark.range(20).select(F.col("id"), F.lit("on").alias("state"))
    active = lambda x: x.filter("state = 'on'")
    target.run(df, active)
    off = df.withColumn("state", F.when(F.col("id") < 15, "off").otherwise(F.col("state")))
    with pytest.raises(RuntimeError):
        target.run(off, active, fail_before_commit=True)
    target.run(off, active)
    assert sorted(r["id"] for r in target.read(spark).collect()) == list(range(15, 20))
    target.run(off.withColumn("state", F.lit("off")), active)
    assert target.read(spark).count() == 0 and target.run(df, active) == 8 and target.read(spark).count() == 20
    never = PartitionedTarget(str(tmp_path / "n"), "id", 8)
    never.run(off.filter("id < 15"), active)
    assert never.read(spark).count() == 0


def test_materialised_tables_can_be_released(spark):
    from loamstone import session

    session.release()
    df = session.materialise(spark.range(5))
    path = df.inputFiles()[0]
    assert df.count() == 5 and session.release() == 1 and session.release() == 0
    assert not os.path.exists(path.replace("file://", ""))
