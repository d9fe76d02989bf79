"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralyn.operators.relational import numbered
from terralyn.sources import scratch
from terralyn.sources.scratch import shared_folder  # noqa: F401

#: White space between words: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one NumPy step works on; bounds a Python worker's memory.
STEP_BYTES = 1 << 20

U64 = np.uint64
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser, in place on a fresh array."""
    x = x ^ (x >> U64(33))
    x *= _MIX1
    x ^= x >> U64(33)
    x *= _MIX2
    x ^= x >> U64(33)
    return x


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    """256 random odd-looking words; with lower, A-Z hash as a-z."""
    table = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    if lower:
        table[65:91] = table[97:123]
    return table


_SPACE_TABLE = np.zeros(256, dtype=bool)
_SPACE_TABLE[[32, 9, 10, 11, 12, 13]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them, without copying; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; tables grow by doubling and stay in the worker."""
    size = 1 << max(16, int(n).bit_length())
    if size > STEP_BYTES * 4:  # one very long text: not kept
        return np.concatenate([[U64(1)], np.cumprod(np.full(n - 1, U64(base)))]).astype(U64) if n else np.zeros(0, U64)
    key = (base, size)
    if key not in _POWERS:
        out = np.full(size, U64(base))
        out[0] = 1
        _POWERS[key] = np.cumprod(out, dtype=U64)
    return _POWERS[key][:n]


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 1, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts in order, and each text's n + 1 offsets into them."""
    return placed_words(data, offsets, seed, lower)[:2]


def placed_words(data: np.ndarray, offsets: np.ndarray, seed: int = 1, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and where in data each word starts.

    A word is a run of bytes that are not white space; words never cross texts.
    """
    space = _SPACE_TABLE[data]
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    last = solid.copy()
    last[:-1] &= space[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= solid[edges]  # a text's first byte starts a word
    last[edges - 1] |= solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U64), bounds, starts
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(byte_table(seed, lower)[data] * powers(_BASE, len(data)), out=total[1:])
    return mix64((total[ends] - total[starts]) * powers(_BASE_INV, len(data) + 1)[starts] + (ends - starts).astype(U64)), bounds, starts


def array_of_longs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted(df: DataFrame, id_column: str, name: str = "_salt") -> DataFrame:
    """Adds a salt from the row's id; a key's rows then spread over as many places as there are shuffle partitions."""
    return df.withColumn(name, F.pmod(F.xxhash64(id_column), F.lit(shuffle_parts(df.sparkSession))).cast("int"))


def shuffled(df: DataFrame) -> DataFrame:
    """A table that grows with the input: joins shuffle it. Spark goes by the size of files, which is a few bytes a row here, and would send a million rows from the driver."""
    return df.hint("merge")


def group_facts(df: DataFrame, key: list[str], partial: list, merged: list) -> DataFrame:
    """One row for each (key, _salt) with facts of the whole key.

    partial: aggregates of a (key, _salt); merged: window-free aggregates over those. Both combine on the
    map side, so a key that holds a third of all rows costs a row for each task.
    """
    part = df.groupBy(*key, "_salt").agg(*partial)
    whole = part.groupBy(*key).agg(*merged)
    return part.select(*key, "_salt").join(shuffled(whole), key)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder."""
    return scratch.cut(df)


def freed(run):
    """A function over Arrow batches that gives the worker's memory back when its task ends; workers serve many tasks."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return whole


def identified(docs: DataFrame) -> DataFrame:
    """(_doc, text, row): a number for each row in the order of doc_id, the text, and the other columns.

    The number is doc_id where all ids differ. Otherwise rows are numbered by id, nulls last, and then by a hash of the
    text; equal rows come in any order. So every row is a document of its own, and of equal ones the first counts as
    the earlier.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    own = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"), row)
    ids = own.select("_doc")
    if not ids.where("_doc is null").limit(1).count() and not ids.groupBy("_doc").count().where("count > 1").limit(1).count():
        return own
    own = own.withColumn("_at", F.struct(F.col("_doc").isNull().alias("late"), F.col("_doc").alias("id"), F.xxhash64("text").alias("hash")))
    return checkpoint(numbered(own, "_at", "_nth").select(F.col("_nth").cast("long").alias("_doc"), "text", "row"))


def retexted(batch: pa.RecordBatch, names: list[str], texts: list[str]) -> pa.RecordBatch:
    """The rows of a batch with other texts; n_chars, where there is one, follows."""
    columns = dict(zip([c for c in names if c != "text"], batch.column("row").flatten(), strict=True)) | {"text": pa.array(texts, pa.string())}
    if "n_chars" in columns:
        columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def unwrapped(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns of identified rows as they were, text as a string."""
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


def retexted_schema(docs: DataFrame) -> str:
    kinds = {"text": "string", "n_chars": "bigint"}
    return ", ".join(f"`{f.name}` {kinds.get(f.name, f.dataType.simpleString())}" for f in docs.schema)
