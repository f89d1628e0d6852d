"""Components stay whole under the plans that larger tables get, and queries on keywords make no row per pair of equal ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cueloom.operators import evidence as ev

from .test_groups_and_keywords import _most_rows

#: Joins are planned as shuffles and turn into broadcasts while they run, as on larger tables.
LATE_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
KEYWORDS = [
    "e10_merged_scripts",
    "l10_script_mapping",
]


def _sql_rows(name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if tables[t] else ''}')")
    rel = con.execute(entry.oracle_sql()[name])
    return [c[0] for c in rel.description], rel.fetchall()


def test_components_are_sliced_whole(spark):
    """50 components of 40 members a second apart, dealt over all partitions, are cut at their members' ends."""
    before = {k: spark.conf.get(k, None) for k in LATE_BROADCAST}
    for k, v in LATE_BROADCAST.items():
        spark.conf.set(k, v)
    try:
        c, at = F.col("id") % 50, F.floor(F.col("id") / 50)
        members = spark.range(0, 2000, 1, 8).select((c % 3).alias("audio_id"), c.alias("component"), F.col("id").alias("event_id"), F.lit("v3").alias("model_role"), (at * 1000).alias("start_ms"), (at * 1000 + 900).alias("end_ms"))
        slices = ev.slice_components(members)
        got = sorted(map(tuple, slices.collect()))
        inside = {tuple(r) for r in ev.window_members(slices, members).groupBy("component", "start_ms").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    cuts = [(0, 14_900), (14_900, 29_900), (29_900, 39_900)]
    assert got == sorted((k % 3, k, a, b, True) for k in range(50) for a, b in cuts)
    assert inside == {(k, a, n) for k in range(50) for (a, _), n in zip(cuts, (15, 15, 10))}


@pytest.mark.parametrize("name", KEYWORDS)
def test_shared_keywords_meet_once(spark, tmp_path, name):
    """1,500 parts of three names, which most contents hold: no step makes a row per pair of equal ones."""
    n, key = 1500, F.col("id")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (key % len(v) + 1).cast("int"))
    parts = spark.range(0, n, 1, 2).select(key.alias("p_partkey"), pick("misty lavender field", "old green river", "red").alias("p_name"), pick("Brand#11", "Brand#12").alias("p_brand"), pick("SMALL TIN", "LARGE BRASS").alias("p_type"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()))
    cols, want = _sql_rows(name, tmp_path, {"part": True})
    assert got.columns == cols
    assert rows == sorted(want)
    assert _most_rows(got._jdf.queryExecution().executedPlan()) <= 4 * n
