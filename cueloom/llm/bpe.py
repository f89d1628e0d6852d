"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Rows: every input row gives one output row. A null text counts as empty (no tokens). Repeated
rows are encoded each on their own; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts longer than this many characters are cut at safe places before they are encoded.
CHUNK_CHARS = 1 << 16

#: One space between two ASCII letters or digits: the split pattern always starts a match there,
#: because no alternative takes a space behind a letter or digit into the match before it.
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

#: For texts without such spaces: a single space between any two characters that are not white space,
#: the first of them no apostrophe.
SAFE_WIDE = re.compile(r"(?<=[^\s'\x1c-\x1f\x85])(?=[ ][^\s\x1c-\x1f\x85])")


def safe_pieces(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Cut text into pieces whose separate encodings concatenate to the encoding of the whole."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size) or SAFE_WIDE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return made, [str(i) for i in range(max(ranks.values()) + 1)]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= CHUNK_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text):
        ids += enc.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row: the tokens themselves, for writers of token files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoding(rank_file, pattern)
        for b in batches:
            ids = [encode_text(enc, t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, ids array<int>")


def decode(tokens: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): raw bytes, since a token need not end at a character's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoding(rank_file, pattern)
        for b in batches:
            raw = [enc.decode_bytes(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    return tokens.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"{id_col} long, bytes binary")


def round_trip_digest(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass; keep only counts and digests.

    Columns: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, decimal = encoding(rank_file, pattern)
        for b in batches:
            n, ids_sha, raw_sha = [], [], []
            for text in b.column(1):
                ids = encode_text(enc, text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(raw_sha)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(
        run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
