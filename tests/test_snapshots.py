"""Versions of a snapshot table: what readers see, failures in the middle, two writers, vacuum."""

import pytest
from pyspark.sql import functions as F

from cueloom.operators.evidence import upsert_runs
from cueloom.operators.snapshots import Conflict, SnapshotTable, write_bound
from cueloom.streaming import streams

ROW = "audio_id long, run_key string, source_channel string, model_role string, text string"


def rows(spark, ids, text):
    return spark.createDataFrame([(i, "main:v3:raw", "main", "v3", text) for i in ids], ROW).coalesce(1)


def seen(table, version=None):
    return {r["audio_id"]: r["text"] for r in table.read(version).collect()}


@pytest.fixture
def table(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", buckets=4)
    assert t.version() == -1 and t.upsert(rows(spark, range(8), "one")) == 0
    return t


def test_readers_are_pinned(spark, table):
    assert table.upsert(rows(spark, [1, 2, 20], "two")) == 1
    assert seen(table) == {**dict.fromkeys(range(8), "one"), 1: "two", 2: "two", 20: "two"}
    assert seen(table, 0) == dict.fromkeys(range(8), "one")
    writes = {(r["audio_id"], r["written_in"]) for r in table.history().collect()}
    assert writes == {(i, 0) for i in range(8)} | {(i, 1) for i in (1, 2, 20)}


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, table, monkeypatch):
    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_put", dies)  # all data are written, the commit isn't
        with pytest.raises(OSError):
            table.upsert(rows(spark, [1], "half"))
    with pytest.raises(Exception, match="torn"):
        table.upsert(rows(spark, [1], "half"), lambda old, new: new.withColumn("text", F.raise_error(F.lit("torn")).cast("string")))
    assert table.version() == 0 and seen(table) == dict.fromkeys(range(8), "one")
    assert table.upsert(rows(spark, [1], "whole")) == 1 and seen(table)[1] == "whole"


def test_two_writers(spark, table):
    bucket = {r["audio_id"]: r["b"] for r in rows(spark, range(8), "").select("audio_id", table.bucket().alias("b")).collect()}
    a, same = next((i, j) for i in range(8) for j in range(i) if bucket[i] == bucket[j])
    apart = next(i for i in range(8) if bucket[i] != bucket[a])
    base = table.version()
    assert table.upsert(rows(spark, [a], "first"), base=base) == 1
    with pytest.raises(Conflict):  # it would bring back what the first has replaced
        table.upsert(rows(spark, [same], "second"), base=base)
    assert table.upsert(rows(spark, [apart], "third"), base=base) == 2
    got = seen(table)
    assert (got[a], got[apart], got[same]) == ("first", "third", "one")
    assert not table._put(2, {}) and table.entry(2)["read"] == base


def test_many_versions_and_vacuum(spark, table):
    for k in range(12):
        table.upsert(rows(spark, [k % 3], f"v{k}"))
    assert seen(table) == {**dict.fromkeys(range(8), "one"), 0: "v9", 1: "v10", 2: "v11"}
    assert table.entry(9)["all"] and not table.entry(10)["all"]
    gone = table.vacuum(keep=2)
    assert gone > 0 and seen(table)[2] == "v11" and seen(table, table.version() - 1)[1] == "v10"
    assert table.vacuum(keep=2) == 0
    assert table.upsert(rows(spark, [], "none")) == table.version() == 12


def test_batches_that_come_again(spark, table, tmp_path):
    assert table.upsert(rows(spark, [3], "b0"), writer="w", batch=0) == 1
    assert table.upsert(rows(spark, [3], "b0 again"), writer="w", batch=0) is None
    assert seen(table)[3] == "b0" and table.version() == 1
    rows(spark, [4, 30], "live").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # nothing new the second time
        streams.upsert_stream(spark.readStream.schema(ROW).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/state").awaitTermination()
    assert table.version() == 2 and seen(table)[30] == "live" and seen(table)[3] == "b0"


def test_runs_and_bound_writes(spark, table):
    new = spark.createDataFrame([(1, "main:v3:raw", "main", "v3", "x"), (1, "rescue:v3:raw", "rescue", "v3", "y")], ROW)
    table.upsert(new, upsert_runs)
    assert sorted(r["text"] for r in table.read().filter("audio_id = 1").collect()) == ["x", "y"]
    sha = lambda x: spark.createDataFrame(x, "audio_id long, sha string")
    bound = SnapshotTable(spark, table.path + "-bound")
    left = write_bound(bound, rows(spark, [1, 2], "t"), sha([(1, "a"), (2, "b")]), sha([(1, "a"), (2, "changed")]))
    assert [r[0] for r in left.collect()] == [2] and [(r["audio_id"], r["input_sha"]) for r in bound.read().collect()] == [(1, "a")]
