"""Encoding of a corpus with a public tokenizer, with offsets, and decoding.

The driver ships the tokenizer's file with the job, so only the driver must have it; it is opened once per worker. Texts arrive as Arrow batches and the ids leave as Arrow lists,
so no Python list per row crosses the border. An empty and a null text both give an empty list.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the tokenizers' files lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Characters that are encoded at once; a longer text is encoded alone, and always whole.
SLICE_CHARS = 1_000_000


def _ship(df: DataFrame, folder: str, name: str) -> None:
    """Send the file to all executors; one that is sent already isn't sent again."""
    df.sparkSession.sparkContext.addFile(f"{folder}/{name}.json")


@lru_cache(4)
def tokenizer(folder: str, name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    here = f"{folder}/{name}.json"
    t = Tokenizer.from_file(here if os.path.exists(here) else SparkFiles.get(f"{name}.json"))
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(1)
def byte_table() -> dict[str, int]:
    """Character to byte of byte-level BPE: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_CHARS characters, so that memory doesn't follow the batch's size."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _encode(texts: list[str | None], folder: str, name: str):
    t = tokenizer(folder, name)
    for a, b in slices(texts):
        yield from t.encode_batch([x or "" for x in texts[a:b]], add_special_tokens=False)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(df: DataFrame, key: str = "doc_id", column: str = "text", *, folder: str = TOKENIZERS, name: str = NAME, offsets: bool = False) -> DataFrame:
    """(key, ids) of each row, with `offsets` also starts and ends: each token's characters in the text.

    Where a character is split over several tokens, all of them carry that character's span. Repeated rows
    stay repeated; other columns are ignored.
    """
    _ship(df, folder, name)
    shape = T.StructType([df.schema[key]] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ["ids"] + ["starts", "ends"] * offsets])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, starts, ends = [], [], []
            for e in _encode(texts, folder, name):
                ids.append(np.array(e.ids, np.int32))
                if offsets:
                    spans = np.array(e.offsets, np.int32).reshape(-1, 2)
                    starts.append(spans[:, 0])
                    ends.append(spans[:, 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(_lists, [ids] + [starts, ends] * offsets)], shape.names)

    return df.select(key, column).mapInArrow(run, shape)


def count_tokens(df: DataFrame, column: str = "text", out: str = "n_tokens", *, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """df without the text but with its number of tokens; a null or empty text has none."""
    _ship(df, folder, name)
    keep = [f for f in df.schema.fields if f.name != column]
    shape = T.StructType(keep + [T.StructField(out, T.LongType())])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            counts = pa.array([len(e.ids) for e in _encode(batch.column(at).to_pylist(), folder, name)], pa.int64())
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [counts], shape.names)

    return df.mapInArrow(run, shape)


@lru_cache(4)
def _pieces(folder: str, name: str) -> list[bytes]:
    t, table = tokenizer(folder, name), byte_table()
    return [bytes(table[c] for c in t.id_to_token(i)) if all(c in table for c in t.id_to_token(i)) else t.id_to_token(i).encode() for i in range(t.get_vocab_size())]


def decode(df: DataFrame, key: str = "doc_id", column: str = "ids", *, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(key, text) of token ids: the byte table reversed. Bytes that are no whole character (a list cut within
    one) become U+FFFD. A null list gives null, an empty list an empty text."""
    _ship(df, folder, name)
    shape = T.StructType([df.schema[key], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            pieces = _pieces(folder, name)
            texts = [None if ids is None else b"".join(pieces[i] for i in ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], shape.names)

    return df.select(key, column).mapInArrow(run, shape)
