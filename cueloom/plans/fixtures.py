"""Views that shape the given tables like the engine's own inputs.

Each is one SQL text that Spark and DuckDB both run, so a query and its oracle start from the same
rows. SHA256_HEX stands for the engine's hex sha256.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: view: (the tables and views it reads, its SQL)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_raw": (
        ("events", "benchmark"),
        """
SELECT event_id, CAST(floor(event_id / 250) AS BIGINT) AS audio_id,
  CASE WHEN event_id % 2 = 0 THEN 'v3' ELSE 'turbo' END AS model_role,
  CASE WHEN event_id % 17 = 0 THEN 'rescue' ELSE 'main' END AS source_channel,
  (event_id * 7919) % 2500 AS step, CAST(floor(value * 40) AS BIGINT) + 300 AS dur,
  CAST(floor(event_id / 2) AS BIGINT) % (SELECT count(*) FROM benchmark) AS item
FROM events""",
    ),
    "fx_candidate": (
        ("fx_raw", "benchmark"),
        """
SELECT r.audio_id, r.event_id, r.model_role, r.source_channel, concat(r.source_channel, ':', r.model_role, ':raw') AS run_key,
  CAST(sum(r.step) OVER (PARTITION BY r.audio_id ORDER BY r.event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start_ms,
  CAST(sum(r.step) OVER (PARTITION BY r.audio_id ORDER BY r.event_id ROWS UNBOUNDED PRECEDING) + r.dur AS BIGINT) AS end_ms,
  CASE WHEN r.event_id % 37 = 0 THEN 'ご視聴ありがとうございました'
       WHEN r.event_id % 10 = 3 THEN substr(b.text, 60, 24)
       WHEN r.event_id % 6 = 1 THEN concat(substr(b.text, 1, 24), '。')
       ELSE substr(b.text, 1, 24) END AS text,
  CASE WHEN r.event_id % 13 <> 0 THEN -(((r.event_id * 31) % 2000) / 1000) END AS avg_logprob,
  CASE WHEN r.event_id % 11 <> 0 THEN ((r.event_id * 17) % 1000) / 1000 END AS no_speech_prob,
  r.event_id % 29 = 0 AS legacy_srt
FROM fx_raw r JOIN benchmark b ON b.item_id = r.item""",
    ),
    "fx_duration": (("fx_candidate",), "SELECT audio_id, max(end_ms) + 5000 AS duration_ms FROM fx_candidate GROUP BY audio_id"),
    "fx_run": (
        ("fx_candidate",),
        "SELECT audio_id, run_key, model_role, source_channel, count(*) + CASE WHEN audio_id % 5 = 0 THEN 1 ELSE 0 END AS candidate_count FROM fx_candidate GROUP BY audio_id, run_key, model_role, source_channel",
    ),
    "fx_turn": (
        ("conversations",),
        """
SELECT conv_id AS audio_id, turn + 1 AS cue_index, turn, 400 + 60 * (length(text) % 330) AS dur, (conv_id * 131 + turn * 977) % 900 AS gap, role, text FROM conversations""",
    ),
    "fx_cue": (
        ("fx_turn",),
        """
SELECT audio_id, cue_index, turn,
  CAST(sum(gap + dur) OVER (PARTITION BY audio_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - dur AS BIGINT) AS start_ms,
  CAST(sum(gap + dur) OVER (PARTITION BY audio_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + CASE WHEN turn % 5 = 4 THEN 700 ELSE 0 END AS BIGINT) AS end_ms,
  text AS text_ja,
  CASE WHEN (audio_id + turn) % 19 = 0 THEN '' WHEN (audio_id + turn) % 23 = 0 THEN '[7]' WHEN (audio_id + turn) % 29 = 0 THEN '...'
       WHEN (audio_id + turn) % 31 = 0 THEN '申し訳ありません' WHEN (audio_id + turn) % 37 = 0 THEN '（中略）'
       ELSE concat('ZH ', substr(text, 1, 40)) END AS text_zh
FROM fx_turn""",
    ),
    "fx_manifest": (
        ("documents",),
        """
SELECT doc_id, concat('doc', CAST(doc_id AS VARCHAR(20)), '_zh.srt') AS output_name, SHA256_HEX(text) AS current_sha,
  CASE WHEN doc_id % 10 = 0 THEN SHA256_HEX('old') ELSE SHA256_HEX(text) END AS recorded_sha,
  CASE WHEN doc_id % 7 = 0 THEN 'pending' ELSE 'complete' END AS status
FROM documents""",
    ),
    "fx_usage": (
        ("events",),
        "SELECT event_id AS call_id, user_id AS audio_id, event_type AS stage, CAST(floor(value * 100) AS BIGINT) AS prompt_tokens, CAST(floor(value * 37) AS BIGINT) AS cached_tokens, CAST(floor(value * 11) AS BIGINT) AS completion_tokens FROM events",
    ),
    "fx_asset": (
        ("part",),
        "SELECT p_partkey AS asset_key, concat('track0', CAST(p_partkey AS VARCHAR(20)), '_', p_name) AS audio_base, p_name FROM part",
    ),
    "fx_script": (
        ("part",),
        """
SELECT p_partkey AS script_key,
  CASE WHEN p_partkey % 3 = 0 THEN concat('track0', CAST(p_partkey AS VARCHAR(20)), '_', p_name)
       WHEN p_partkey % 3 = 1 THEN concat('0', CAST(p_partkey AS VARCHAR(20)), '_', p_brand)
       ELSE concat('script ', CAST(p_partkey AS VARCHAR(20))) END AS script_base,
  concat(p_type, ' ', CASE WHEN p_partkey % 3 = 2 THEN p_name ELSE p_brand END) AS content
FROM part""",
    ),
    "fx_search": (
        ("pages",),
        "SELECT page_id, page_id % 2 AS provider, concat('https://example.org/', CAST(page_id % 50 AS VARCHAR(20))) AS url, substr(html, 1, 300) AS snippet, CAST(floor(page_id / 7) AS BIGINT) AS query_id FROM pages",
    ),
}

SQL = {k: v[1] for k, v in _VIEWS.items()}


def needs(names: tuple[str, ...]) -> list[str]:
    """Views to define, each after those it reads."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in _VIEWS and name not in out:
            for below in _VIEWS[name][0]:
                add(below)
            out.append(name)

    for n in names:
        add(n)
    return out


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in sf_dir."""
    wanted = needs((name,))
    tables = dict.fromkeys(t for v in wanted for t in _VIEWS[v][0] if t not in _VIEWS)
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    ctes = ",\n".join(f"{v} AS ({SQL[v]})" for v in wanted)
    text = reduce(lambda s, x: s.replace(f"SHA256_HEX({x})", f"sha2({x}, 256)"), ("text", "'old'"), ctes)
    return spark.sql(f"WITH {text} SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
