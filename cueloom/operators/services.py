"""Calls of the caller's own text service, one Arrow stream per partition; replies come back as a table.

The service itself isn't built: make_client() gives a callable (payload) -> str | dict | None, made
once per stream, on the executor that uses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .batches import SEPARATOR

Client = Callable[[str], "str | dict | None"]


def join_lines(args: dict) -> str | None:
    """A structured reply's lines as one text (N1); nothing usable is None."""
    lines = args.get("lines")
    return SEPARATOR.join(map(str, lines)) if lines else None


def ask(requests: DataFrame, make_client: Callable[[], Client], *, by: tuple[str, ...] = ("audio_id", "batch"), parser: Callable[[dict], "str | None"] = join_lines, tries: int = 3) -> DataFrame:
    """by, reply, tries, error: each request's payload sent until a usable reply comes, `tries` times at most.

    A dict goes through parser (N1). A request whose tries all fail has a null reply and the last
    error; it stops nothing else. A task that is run again asks again.
    """
    types: StructType = requests.select(*by).schema.add("reply", "string").add("tries", "integer").add("error", "string")

    def one(client: Client, payload: str) -> tuple[str | None, int, str | None]:
        error = None
        for n in range(1, tries + 1):
            try:
                got = client(payload)
                reply = parser(got) if isinstance(got, dict) else got
                if reply:
                    return reply, n, None
                error = "no usable reply"
            except Exception as e:  # noqa: BLE001 - whatever a service throws is its reply
                error = f"{type(e).__name__}: {e}"
        return None, tries, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, target = make_client(), to_arrow_schema(types)
        for b in batches:
            rows = [one(client, p) for p in b.column(len(by)).to_pylist()]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], *(pa.array(c, target.field(len(by) + k).type) for k, c in enumerate(cols))], schema=target)

    return requests.select(*by, "payload").mapInArrow(run, types)


def batch_payloads(batches: DataFrame, by: tuple[str, ...] = ("audio_id", "batch")) -> DataFrame:
    """by, payload: a batch's texts in order, as replies are to give them."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return batches.groupBy(*by).agg(F.array_join(texts, SEPARATOR).alias("payload"))


def ask_lines(batches: DataFrame, failed: DataFrame, make_client: Callable[[], Client], *, by: tuple[str, ...] = ("audio_id", "batch"), tries: int = 1) -> DataFrame:
    """by, place, retry: every line of the failed batches asked for on its own."""
    lines = batches.join(failed.select(*by), list(by), "left_semi").withColumnRenamed("text", "payload")
    return ask(lines, make_client, by=(*by, "place"), tries=tries).select(*by, "place", F.col("reply").alias("retry"))
