"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

A run is a table of (line hash, documents that hold it, largest doc_id that holds it), bucketed and
sorted by hash. Batches arrive in falling order of doc_id, so the largest holder of a line is known
when the line is first met, and a line found in enough documents needs no further record. A batch is
counted by line first, so that a line that very many documents share is one row, and then merged
with every run: lines that the runs hold often enough are left out (anti-join), the others make the
batch's own run. The runs' buckets are read as they lie; only the batch is shuffled. When a level
holds `fanout` runs they are compacted into one run of the next level, which later batches meet.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case; it
stands in the runs as two 64-bit hashes. Keys of min_chars code points found in min_docs documents
lose all their lines except in the largest doc_id that holds them; other lines stay.

Defined results: a null or empty text is one empty line. A document is a doc_id: rows that repeat one
hold lines together and keep what it keeps. Rows of null doc_id count together as one document and
lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, named, new_table_path

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 6
FANOUT = 3
#: A line that makes up one in so many of all lines is looked up by broadcast; there can't be more such lines.
OFTEN = 10_000

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line's key. lower() is the quick way for pure ASCII; it would change other letters too."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, th (hash of the text, to tell rows of one doc_id apart), pos, h1, h2 of all lines long enough."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """The levelled runs. ingest() takes batches in falling order of doc_id; close() when all is done."""

    def __init__(self, spark: SparkSession, *, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []
        self.paths: dict[int, str] = {}

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run from several. Their files are read as plain Parquet: a union of bucketed scans must not pass for bucketed."""
        every = self.spark.read.schema(runs[0].schema).parquet(*[self.paths[id(r)] for r in runs])
        return every.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def _stored(self, run: DataFrame) -> DataFrame:
        """run as a table in the shared folder, bucketed as a shuffle would deal it."""
        name = f"line_run_{uuid.uuid4().hex}"
        path, buckets = new_table_path(self.spark, name), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables.append(name)
        run.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        stored = self.spark.table(name)
        self.paths[id(stored)] = path
        return stored

    def _add(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._stored(run))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._add(self._merged(runs), level + 1)

    def ingest(self, lines: DataFrame) -> None:
        """Add a batch's lines (doc_id, h1, h2); lines that the runs hold in min_docs documents are left out."""
        holders = lines.select(*KEY, "doc_id").distinct()
        batch = holders.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        seen = F.lit(0)
        for k, run in enumerate(self.runs()):
            batch = batch.join(run.select(*KEY, F.col("n").alias(f"n{k}")), KEY, "left")
            seen = seen + F.coalesce(f"n{k}", F.lit(0))
        self._add(batch.filter(seen < self.min_docs).select(*KEY, "n", "top"), 0)

    def repeated(self) -> DataFrame:
        """h1, h2, n, top of the lines found in min_docs documents or more; n may leave out documents beyond these."""
        return self._merged(self.runs()).filter(F.col("n") >= self.min_docs)

    def close(self) -> None:
        """Take the runs' names out of the catalog; their files lie in the shared folder, whose owner clears it."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.tables, self.paths = [], [], {}


def repeated_lines(lines: DataFrame, *, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """h1, h2, n, top of the lines (a written table) found in min_docs documents."""
    cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    runs = LineRuns(lines.sparkSession, min_docs=min_docs, fanout=fanout)
    upper = None
    try:
        for cut in [*sorted(set(cuts), reverse=True), None]:
            batch = lines
            if cut is not None:
                batch = batch.filter(F.col("doc_id") >= cut)
            if upper is not None:
                below = F.col("doc_id") < upper
                batch = batch.filter(below if cut is not None else below | F.col("doc_id").isNull())  # nulls in the last
            runs.ingest(batch)
            upper = cut
        return materialize(runs.repeated(), "repeated")
    finally:
        runs.close()


def deduped(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """row (all of docs' columns), n_lines, n_dropped, kept (the text without the dropped lines)."""
    lines = materialize(hashed_lines(docs.select("doc_id", "text"), min_chars=min_chars), "lines")
    repeated = repeated_lines(lines, min_docs=min_docs, batches=batches, fanout=fanout)
    often = F.broadcast(repeated.filter(F.col("n") * OFTEN >= lines.count()))
    others = lines.join(often.select(*KEY), KEY, "left_anti").join(repeated, KEY)
    lost = lines.join(often, KEY).unionByName(others).filter(F.col("doc_id") < F.col("top"))
    gone = lost.groupBy(F.col("doc_id").alias("of"), F.col("th").alias("of_text")).agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    joined = rows.join(gone, (F.col("id") == F.col("of")) & (F.col("th") == F.col("of_text")), "left")
    split = joined.select("row", "gone", text_lines(F.col("row.text")).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return split.select(
        "row", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n")).alias("kept"),
    )


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; columns of these names are replaced."""
    done = deduped(docs, min_chars=min_chars, min_docs=min_docs, batches=batches, fanout=fanout)
    own = [named(c, "row") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    return done.select(*own, "n_lines", "n_dropped", F.col("kept").alias("kept_text"))


def drop_repeated(docs: DataFrame, **params) -> DataFrame:
    """docs, all columns kept, without repeated lines in text. Rows left without text that had some go."""
    done = deduped(docs, **params).filter((F.col("n_dropped") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    fewer = F.col("n_dropped") > 0
    row = F.col("row").withField("text", F.when(fewer, F.col("kept")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(fewer, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return done.select(row.alias("row")).select("row.*")


#: The same in DuckDB SQL, for the query's columns.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) + (count(*) > count(doc_id))::INTEGER >= 3
), marked AS (
  SELECT keyed.*, coalesce(doc_id < top, FALSE) AS gone FROM keyed LEFT JOIN hot USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
