"""Asking a distributed key table from blocks of documents.

A block is a run of whole documents kept as one row of a stored table, bucketed by block id. A question sends,
for each shard of the key space, one row with the block's distinct sorted keys (differences, packed), so that a key
that is frequent everywhere is at most one entry a block. A shard answers in the order of the question. Answers go
back by block; the block table itself is never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abridge.llm.common import Scratch, shuffle_partitions

BLOCK_BYTES = 4 << 20  # a block is closed when it holds more text
ROW_BYTES = 32         # what a row counts besides its text
SHARD_BYTES = 16 << 20  # text that one shard stands for


def squeeze(a: np.ndarray) -> bytes:
    """Compress an array, byte plane by byte plane."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T if a.size else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1) if raw.size else np.zeros(0, dtype)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Compress ascending unsigned 64-bit keys."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit numbers (an invertible finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards are equal ranges of the key space, so sorted keys have sorted shards."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def shard_slices(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(shard, slice) of the non-empty shards of ascending keys."""
    s = shard_of(keys, n)
    cut = np.flatnonzero(np.diff(s, prepend=np.uint64(n + 1)))
    for a, b in zip(cut, [*cut[1:], len(keys)]):
        yield int(s[a]), slice(a, b)


NO_ID = -(1 << 63)


def id_or_least(col: str) -> Column:
    """Ids as long; null becomes the least long, so that blocks hold plain numbers."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID).cast("long"))


def least_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(NO_ID).cast("long"))


def text_blocks(docs: DataFrame, scratch: Scratch, fields: dict[str, str],
                encode: Callable[[pa.RecordBatch], dict[str, object]], name: str = "blocks",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Store ``docs`` (the last column is the text as binary) as blocks: (block, n_bytes, *fields).

    ``encode`` turns the rows of one block into the values of ``fields``.
    """
    schema = "block string, n_bytes long, " + ", ".join(f"{k} {v}" for k, v in fields.items())

    def close(rows: list[pa.RecordBatch], size: int) -> pd.DataFrame:
        table = pa.Table.from_batches(rows).combine_chunks()
        values = encode(table.to_batches()[0])
        return pd.DataFrame({"block": [uuid.uuid4().hex], "n_bytes": [size], **{k: [v] for k, v in values.items()}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(batch.num_columns - 1)
            ends = np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64) + ROW_BYTES)
            start, base = 0, 0
            while start < batch.num_rows:
                stop = min(batch.num_rows, int(np.searchsorted(ends, base + max(1, block_bytes - size))) + 1)
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - base
                start, base = stop, int(ends[stop - 1])
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pandas(close(held, size), preserve_index=False)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pandas(close(held, size), preserve_index=False)

    return scratch.store_bucketed(docs.mapInArrow(run, schema), name, "block", shuffle_partitions(docs.sparkSession))


def shard_count(blocks: DataFrame) -> int:
    """Shards by the size of the texts, and enough for every shuffle partition."""
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(-(-size // SHARD_BYTES), shuffle_partitions(blocks.sparkSession))


def by_shard(questions: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Questions (shard, ...) meet their shard; ``answer`` sees all rows of a shard, at most one a block and kind."""
    return questions.groupBy("shard").applyInPandas(answer, schema)


def with_answers(blocks: DataFrame, answers: DataFrame,
                 finish: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``finish(block row, its answers)``; only the answers move."""
    return (blocks.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInPandas(lambda b, a: finish(b, a), schema))
