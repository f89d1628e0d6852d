"""Rules that depend on order, walked group by group in one Arrow stream per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a worker holds back before it sends them on.
BATCH = 8192


def walk_groups(df: DataFrame, by: list[str], order: list[str], cols: list[str], walk: Callable[[tuple, list[tuple]], list[tuple]], schema: str | StructType) -> DataFrame:
    """What walk(key, rows) returns for every group of `by`; rows hold `cols` in the order asked for.

    Rows are sorted by group once and streamed, so thousands of small groups cost one Python call
    each and no frame of their own; a worker holds one group at a time. They are dealt by a hash of the
    group that no join before it has as its key: Spark takes a repartition by a join's own keys for
    done, and adaptive execution may then broadcast that join and leave its rows where they lie.
    """
    n = len(by)
    types = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(types)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(target), target)], schema=target)

        key, held, out = None, [], []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:n] != key:
                    if held:
                        out += walk(key, held)
                    if len(out) >= BATCH:
                        yield batch(out)
                        out = []
                    key, held = row[:n], []
                held.append(row[n:])
        if held:
            out += walk(key, held)
        yield batch(out)

    return df.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order).select(*by, *cols).mapInArrow(run, schema)
