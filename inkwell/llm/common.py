"""Helpers that the operators of this subpackage share: cut lineage, packed text batches, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import removed, scratch, stored as written  # noqa: F401  tables that cut lineage, for all operators here

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: ASCII white space of the word definitions.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of 1000 rows instead of Spark's default of 10,000, which a worker that meets long texts may not hold. A setting of the user's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def crc_of_id(col: str = "doc_id"):
    """crc32 of an id's decimal text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


class Packed:
    """Some texts as one byte array: data[starts[i]:ends[i]] is text i. Nulls are empty."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.starts, self.ends = data, bounds[:-1], bounds[1:]
        self.n = len(bounds) - 1

    def of_positions(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.ends, at, side="right")


def packed(col: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, Packed]]:
    """(first row, texts) for runs of rows of about step bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    bounds = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + step, side="right")) - 1)
        cut = bounds[row : last + 1]
        yield row, Packed(data[cut[0] : cut[-1]], cut - cut[0])
        row = last


# ---- rolling hashes, modulo 2**64 -------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LETTERS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that leaves no linear structure."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any slices of a sequence of 64-bit values; equal slices hash alike wherever they stand."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power, self.inverse = _grown(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def windows(self, length: int) -> np.ndarray:
        """Of all slices of this length, in order; not mixed."""
        n = len(self.sums) - 1
        return (self.sums[length:] - self.sums[: n + 1 - length]) * self.inverse[: n + 1 - length] if n >= length else np.zeros(0, np.uint64)


def letters(data: np.ndarray) -> np.ndarray:
    return _LETTERS[data]


def word_bounds(texts: Packed, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; none crosses a text's end."""
    m = is_word[texts.data]
    if not m.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(len(m) + 1, bool)
    fresh[texts.starts] = True
    fresh[-1] = True
    starts = m.copy()
    starts[1:] &= ~m[:-1] | fresh[1:-1]
    ends = m.copy()
    ends[:-1] &= ~m[1:] | fresh[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def smallest_first(ids) -> str:
    """A digest's member list: ids as strings, sorted as strings, joined by commas."""
    return ",".join(sorted({str(i) for i in ids}))
