"""Tables with numbered versions: a commit log beside immutable Parquet folders.

Data are dealt to buckets by a hash of the key. A writer reads a version, writes new folders for the
buckets it touches, and then puts the log entry of the next version, which must not be there yet. If
another writer was faster, its entry is looked at: when it touched none of the same buckets the next
number is tried, else the write is refused (Conflict) and nobody sees its folders. So a reader, who is
pinned to a version, sees all of a commit or nothing, a writer that dies leaves the table as it was,
and of two that change the same bucket the later one has to read again.

Entries are put by a rename that doesn't overwrite, which HDFS and local disks do; a store without it
needs its own conditional put. The log holds one line of paths a bucket, never data.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .graph import checkpoint

BUCKET, WRITTEN = "_bucket", "written_in"


class Conflict(RuntimeError):
    """Another writer has changed what this one read."""


class SnapshotTable:
    """key: the column whose rows change together; all rows of one key are in one bucket."""

    def __init__(self, spark: SparkSession, path: str, key: str = "audio_id", buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # ---- the log ----
    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entry(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{version:020d}.json")

    def version(self) -> int:
        """The last version, -1 before the first commit."""
        where, fs = self._fs()
        if not fs.exists(where):
            return -1
        names = [x.getPath().getName() for x in fs.listStatus(where)]
        return max([int(n[:20]) for n in names if n.endswith(".json") and n[:1].isdigit()], default=-1)

    def entry(self, version: int) -> dict:
        _, fs = self._fs()
        stream = fs.open(self._entry(version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, version: int, entry: dict) -> bool:
        """Put a version's entry if there is none; false if there is."""
        where, fs = self._fs()
        fs.mkdirs(where)
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(entry).encode())
        out.close()
        if fs.exists(self._entry(version)):
            fs.delete(draft, False)
            return False
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri())
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._entry(version), none)
        except Exception:
            fs.delete(draft, False)
            if fs.exists(self._entry(version)):
                return False
            raise
        return True

    def state(self, version: int) -> dict[int, str]:
        """The folder of each bucket at a version; an entry names the buckets that it changed, every tenth all of them."""
        held: dict[int, str] = {}
        for v in range(version, -1, -1):
            entry = self.entry(v)
            for bucket, folder in (entry["all"] or entry["put"]).items():
                held.setdefault(int(bucket), folder)
            if entry["all"]:
                break
        return held

    # ---- reading ----
    def read(self, version: int | None = None, only: list[int] | None = None, schema: StructType | None = None) -> DataFrame:
        """The rows of a version, the last if none is given; of some buckets only, if asked."""
        version = self.version() if version is None else version
        if version < 0:
            if schema is None:
                raise ValueError(f"{self.path} has no version")
            return self.spark.createDataFrame([], schema)
        schema = schema or StructType.fromJson(self.entry(version)["schema"])
        folders = [f"{self.path}/data/{f}/{BUCKET}={b}" for b, f in sorted(self.state(version).items()) if f and (only is None or b in only)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        """key, written_in: every write of a key that has not been vacuumed."""
        rows = [self._written(v) for v in range(self.version() + 1)]
        rows = [r for r in rows if r is not None]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.distinct()

    def _written(self, version: int) -> DataFrame | None:
        entry = self.entry(version)
        _, fs = self._fs()
        folders = [f"{self.path}/data/{f}/{BUCKET}={b}" for b, f in entry["put"].items() if f]
        folders = [f for f in folders if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f))]
        if not folders:
            return None
        rows = self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(*folders)
        return rows.filter(F.col(WRITTEN) == entry["mark"]).select(self.key, F.lit(version).alias(WRITTEN))

    # ---- writing ----
    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, *, writer: str | None = None, batch: int | None = None, base: int | None = None) -> int | None:
        """Commit merge(current rows of the buckets that incoming touches, incoming); by default incoming keys replace theirs.

        base: the version that was read, the last if not given. writer, batch: a batch that the writer
        has committed before is left out, so that it may be sent again. Returns the new version.
        """
        base = self.version() if base is None else base
        if writer is not None and self._done(writer, batch):
            return None
        mark = uuid.uuid4().hex
        new = checkpoint(incoming.drop(WRITTEN).withColumn(WRITTEN, F.lit(mark)).withColumn(BUCKET, self.bucket()))
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most `buckets` numbers
        if not touched:
            return base
        rows = new.drop(BUCKET)
        current = self.read(base, touched, rows.schema)
        merge = merge or (lambda old, fresh: old.join(fresh.select(self.key).distinct(), self.key, "left_anti").select(*fresh.columns).unionByName(fresh))
        merged = merge(current, rows).select(*rows.columns)
        folder = uuid.uuid4().hex
        merged.withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        _, fs = self._fs()
        there = lambda b: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{folder}/{BUCKET}={b}"))
        return self._commit(base, {b: folder if there(b) else "" for b in touched}, rows.schema, mark, writer, batch)

    def _done(self, writer: str, batch: int | None) -> bool:
        return any((e := self.entry(v))["writer"] == writer and e["batch"] == batch for v in range(self.version(), -1, -1))

    def _commit(self, base: int, put: dict[int, str], schema: StructType, mark: str, writer: str | None, batch: int | None) -> int:
        version = base + 1
        while True:
            for v in range(base + 1, version):
                other = self.entry(v)
                if {int(b) for b in other["put"]} & set(put):
                    raise Conflict(f"version {v} of {self.path} changed buckets that version {base} was read for")
                if writer is not None and other["writer"] == writer and other["batch"] == batch:
                    raise Conflict(f"batch {batch} of {writer} is version {v}")
            whole = self.state(version - 1) | put if version % 10 == 9 else None
            entry = {"put": put, "all": whole, "schema": json.loads(schema.json()), "mark": mark, "writer": writer, "batch": batch, "read": base, "at": time.time()}
            if self._put(version, entry):
                return version
            version += 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last `keep` versions shows, but for those younger than them: a writer may be at work. Returns how many went."""
        last = self.version()
        if last < 0:
            return 0
        first = max(0, last - keep + 1)
        held = {f for v in range(first, last + 1) for f in self.state(v).values()}
        since = self.entry(first)["at"] * 1000
        _, fs = self._fs()
        gone = 0
        for x in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")):
            if x.getPath().getName() not in held and x.getModificationTime() < since:
                fs.delete(x.getPath(), True)
                gone += 1
        return gone


def write_bound(table: SnapshotTable, df: DataFrame, expected: DataFrame, current: DataFrame) -> DataFrame:
    """Commit df's keys whose input is unchanged since it was read, with that input's sha.

    expected, current: key, sha. Returns the keys left out.
    """
    key = table.key
    same = expected.select(key, F.col("sha").alias("input_sha")).join(current.select(key, "sha"), key).filter("input_sha = sha").select(key, "input_sha")
    table.upsert(df.join(same, key))
    return expected.select(key).join(same.select(key), key, "left_anti")
