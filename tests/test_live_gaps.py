"""Live silences: corrections by late rows, silent ends, a state that falls; whole streams against plain sorting."""

import datetime as dt
import random

from cueloom.streaming import live_gaps as lg

SCHEMA = "at timestamp, audio_id long, start_ms long, end_ms long"
ZERO = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, **params):
    """Changes of each batch, as the stream gives them, and the number of rows in its state after each."""
    out, sizes = [], []
    for k, batch in enumerate(batches):
        rows = [(None if at is None else ZERO + dt.timedelta(seconds=at), a, s, e) for at, a, s, e in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        got = []
        with lg.rocksdb(spark):
            q = lg.live_gaps(live, **params).writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        out.append(sorted(got, key=str))
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return out, sizes


def test_corrections_silent_ends_and_state(spark, tmp_path):
    batches = [
        [(0, 1, 0, 900), (0, 1, 5000, 6000), (None, 1, 0, 9), (0, 1, None, 5)],
        [(10, 1, 2500, 3000), (10, 2, 0, 500)],
        [(100, 2, 600, 700)],
        [(400, 2, 4000, 4100)],
        [(401, 2, 4100, 4200)],
    ]
    out, sizes = run(spark, tmp_path, batches, silence_ms=30_000, ended_ms=200_000)
    assert out[0] == [(1, 900, 5000, "gap")]
    assert out[1] == [(1, 3000, 5000, "gap"), (1, 900, 2500, "gap"), (1, 900, 5000, "withdrawn")]
    told = [r for part in out[2:] for r in part]
    assert sorted(told, key=str) == [(1, 6000, None, "silent"), (2, 700, 4000, "gap")]
    assert sizes[-1] < max(sizes)


def test_settled_audio_is_not_corrected(spark, tmp_path):
    out, _ = run(spark, tmp_path, [[(0, 1, 0, 100), (0, 1, 5000, 5100), (0, 1, 50_000, 50_100)], [(1, 1, 2000, 2100), (1, 1, 40_000, 40_100)]], keep_ms=10_000)
    assert out[0] == [(1, 100, 5000, "gap"), (1, 5100, 50_000, "gap")]
    assert out[1] == []


def test_arrivals_in_any_order_give_the_gaps_of_all_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(0, a, s := rng.randrange(60_000), s + rng.randrange(1, 2000)) for a in range(6) for _ in range(rng.randint(1, 25))]
    rng.shuffle(rows)
    out, _ = run(spark, tmp_path, [[(k, *r[1:]) for r in rows[k::3]] for k in range(3)], keep_ms=10**9)
    changes = spark.createDataFrame([r for part in out for r in part], lg.OUT)
    want = sorted((a, *g) for a in range(6) for g in lg.silences(lg.stretches([(s, e) for _, b, s, e in rows if b == a], 1500)))
    assert sorted(map(tuple, lg.gaps_now(changes).collect())) == want and want
    assert changes.filter("kind = 'withdrawn'").count() > 0
