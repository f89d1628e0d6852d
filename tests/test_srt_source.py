"""The srt source against the parsers on whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.sources import srt_source, subtitles as st


def messy(rng, n):
    """Blocks with all kinds of line ends, runs of them, blank blocks and odd characters."""
    end = lambda: rng.choice(["\n", "\r\n", "\r"])
    out = [rng.choice(["", "﻿", "\n \n\n", "  "])]
    for k in range(n):
        span = rng.choice(["00:00:01,000 --> 00:00:02,500", "0:00 -> 1", "00:00:03,000 --> 00:00:01,000"])
        lines = rng.sample([str(k + 1), span, "text é 字幕 " * rng.randint(0, 9), "second"], rng.randint(2, 4)) if rng.random() < 0.3 else [str(k + 1), span, "line 字" * rng.randint(1, 30)]
        out.append(end().join(lines))
        out.append("".join(end() for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.1:
            out.append(" \t" + end() + end())
    return "".join(out)


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_ranges_give_the_blocks_of_whole_files(spark, tmp_path, split):
    rng = random.Random(split)
    texts = {f"r{k}.v{k}": messy(rng, rng.randint(0, 12)) for k in range(8)} | {"empty": "", "blank": "\r\n \n\n\t", "one": "\n\n1\n00:00:01,000 --> 00:00:02,000\nx"}
    if split > 1000:
        texts["long"] = messy(rng, 20_000)
    for name, text in texts.items():
        (tmp_path / f"{name}.srt").write_bytes(text.encode())
    (tmp_path / "other.txt").write_text("no")
    whole = st.blocks(spark.createDataFrame(list(texts.items()), "audio_id string, body string"))
    found = srt_source.read_blocks(spark, str(tmp_path), split_bytes=split)
    key = lambda df: sorted((r["audio_id"], r["ord"], r["lines"]) for r in df.collect())
    assert key(st.blocks(found)) == key(whole)
    if split > 1000:
        assert found.rdd.getNumPartitions() >= 3 and found.filter("audio_id = 'long'").withColumn("p", F.spark_partition_id()).select("p").distinct().count() >= 3
    every = [st.parse_cues, st.parse_bilingual, st.check_blocks] if split > 1000 else []
    for parse in every:
        a = parse(found)
        b = parse(spark.createDataFrame(list(texts.items()), "audio_id string, body string")).select(*a.columns)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_chunks_end_anywhere(monkeypatch, tmp_path):
    rng = random.Random(5)
    data = messy(rng, 30).encode()
    (tmp_path / "a.srt").write_bytes(data)
    store, path = srt_source.opened(f"file:{tmp_path}/a.srt")
    read = lambda cuts: [b for a, z in zip(cuts, cuts[1:]) for b in srt_source.blocks_of(store.open_input_file(path), a, z, len(data))]
    want = read([0, len(data)])
    for chunk in (1, 2, 3, 7):
        monkeypatch.setattr(srt_source, "CHUNK", chunk)
        for _ in range(10):
            assert read([0, *sorted(rng.sample(range(1, len(data)), 9)), len(data)]) == want


def test_globs_choose_files_and_schemas_columns(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"r{k}.srt").write_text(f"1\n00:00:01,000 --> 00:00:02,000\nx{k}\n")
    srt_source.register(spark)
    few = spark.read.format("srt").schema("pos long, audio_id string").option("splitBytes", 100).load(str(tmp_path))
    assert few.columns == ["pos", "audio_id"]
    chosen = srt_source.read_blocks(spark, str(tmp_path), glob="r[14].srt")
    assert sorted(r["audio_id"] for r in chosen.collect()) == ["r1", "r4"]
    assert few.filter("audio_id = 'r2'").count() == 1 and few.count() == 6  # a filtered read leaves the relation as it was
    with pytest.raises(Exception, match="none_here"):
        srt_source.read_blocks(spark, f"{tmp_path}/none_here").collect()


def test_modes(spark, tmp_path):
    (tmp_path / "good.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n\n2\n00:00:03,000 --> 00:00:04,000\ny\n")
    (tmp_path / "bad.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n\n1\n00:00:03,000 --> 00:00:04,000\ny\n\nzz\n")
    lenient = st.read_cues(spark, str(tmp_path), ranges=True, split_bytes=10)
    assert lenient.count() == 4
    good, bad = st.read_cues(spark, str(tmp_path), "QUARANTINE", ranges=True, split_bytes=10)
    assert [r["text"] for r in good.orderBy("ord").collect()] == ["x", "y"]
    assert sorted((r["ord"], r["reasons"][0]) for r in bad.collect()) == [(1, "duplicate_index"), (2, "duplicate_index"), (3, "short_block")]
    with pytest.raises(Exception, match="bad block in bad"):
        st.read_cues(spark, str(tmp_path), "FAILFAST", ranges=True).collect()
