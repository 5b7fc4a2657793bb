"""Question-and-answer rounds between blocks of documents and buckets of hashes.

Documents are dealt into blocks by a hash of their id. A round lets each block
ask about the distinct hashes it holds (at most one entry a hash and block, so
a hash that fills the corpus still arrives once per block), gathers the entries
of one hash range in a bucket, and sends each block only the answers that
concern it. Entries travel packed as binary columns; Spark does all shuffling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import U64

LAST_ID = (1 << 63) - 1
#: Bytes of text in a block, which a task holds as a whole.
BLOCK_BYTES = 32 << 20
ASKED = "bucket int, block int, a binary, b binary, c binary, d binary"
TOLD = "block int, kind int, a binary, b binary, c binary, d binary"


def shuffle_parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def block_count(docs: DataFrame, text_col: str, size: int = BLOCK_BYTES) -> int:
    """Blocks so that each holds about ``size`` bytes of text, two for each shuffle partition at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(2 * shuffle_parts(docs), -(-total // size))


def in_blocks(docs: DataFrame, id_col: str, text_col: str, blocks: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, id, text, carried columns), one row per document; a null text is empty, a null id comes last."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.length(text_col)), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(c).alias(f"with_{c}") for c in carry],
    )


def carried(base: DataFrame, carry: tuple[str, ...]) -> str:
    """Schema text of the carried columns."""
    return "".join(f", `with_{c}` {base.schema[f'with_{c}'].dataType.simpleString()}" for c in carry)


def with_carried(out: pa.Table, table: pa.Table, carry: tuple[str, ...]) -> pa.Table:
    for c in carry:
        out = out.append_column(f"with_{c}", table[f"with_{c}"])
    return out


def ids_of(table: pa.Table) -> np.ndarray:
    return table["id"].combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def ask(blocks: DataFrame, fn: Callable[[pa.Table], Iterator[tuple]], buckets: int) -> DataFrame:
    """``fn(documents of a block)`` gives (sorted hashes, arrays beside them)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return packed(key[0].as_py(), *fn(table), buckets=buckets)

    return blocks.groupBy("block").applyInArrow(run, ASKED)


def ask_again(blocks: DataFrame, told: DataFrame, fn: Callable[[pa.Table, pa.Table], tuple], buckets: int) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return packed(key[0].as_py(), *(fn(left, right) if left.num_rows else (np.zeros(0, U64),)), buckets=buckets)

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, ASKED)


def packed(block: int, keys: np.ndarray, *beside: np.ndarray, buckets: int) -> pa.Table:
    """One row per bucket; ``keys`` are sorted, and a bucket is a range of them."""
    edges = np.searchsorted(keys, np.array([(i << 64) // buckets for i in range(1, buckets)], U64))
    edges = np.concatenate(([0], edges, [len(keys)]))
    full = np.flatnonzero(np.diff(edges))
    cols = [[deflate(x[edges[i] : edges[i + 1]]) for i in full] for x in (keys, *beside)]
    cols += [[None] * len(full)] * (4 - len(cols))
    return pa.table(
        {"bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32())}
        | {name: pa.array(x, pa.binary()) for name, x in zip("abcd", cols, strict=True)}
    )


def deflate(x: np.ndarray | list[bytes]) -> bytes:
    """Numbers as they are; strings joined and compressed."""
    return x.tobytes() if isinstance(x, np.ndarray) else pa.compress(b"".join(x), codec="zstd", asbytes=True)


def inflate(blob: pa.Buffer, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def unpacked(table: pa.Table, name: str, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in table[name] if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def lengths(table: pa.Table, name: str, size: int) -> np.ndarray:
    return np.array([len(x.as_buffer()) // size if x.is_valid else 0 for x in table[name]], np.int64)


def answer(asked: DataFrame, fn: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """``fn(all entries of a bucket)`` gives (block, kind, arrays...) for the blocks concerned."""

    def run(table: pa.Table) -> pa.Table:
        rows = fn(table)
        cols = [[r[2 + k].tobytes() if len(r) > 2 + k else None for r in rows] for k in range(4)]
        return pa.table(
            {"block": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32())}
            | {name: pa.array(x, pa.binary()) for name, x in zip("abcd", cols, strict=True)}
        )

    return asked.groupBy("bucket").applyInArrow(run, TOLD)


def by_block(block: np.ndarray, *arrays: np.ndarray, kind: int = 0) -> list[tuple]:
    """Rows of ``arrays`` regrouped by block."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    cut = np.flatnonzero(np.diff(block)) + 1
    start = np.concatenate(([0], cut)) if len(block) else np.zeros(0, int)
    end = np.concatenate((cut, [len(block)]))
    arrays = [a[order] for a in arrays]
    return [(int(block[s]), kind, *(a[s:e] for a in arrays)) for s, e in zip(start, end, strict=False)]


def matches(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a value, place in the sorted table) of all equal entries."""
    low = np.searchsorted(table, values, side="left")
    n = np.searchsorted(table, values, side="right") - low
    i = np.repeat(np.arange(len(values)), n)
    return i, np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(i))


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is in the sorted table, its place there)."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at
