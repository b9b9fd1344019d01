"""Vectorised text helpers for tasks: Arrow string columns in, numpy arrays out.

A batch of texts is one byte buffer with document offsets.  Words are maximal
runs of bytes that a 256-entry table marks as word bytes; they never cross a
document.  Names are 64-bit polynomial hashes over random byte values, so equal
byte strings have equal names on every machine and in every run.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that are worked on at once; a longer text is its own chunk.
CHUNK_BYTES = 1 << 20

#: Bytes of an Arrow batch between Spark and a task's Python.
BATCH_BYTES = 8 << 20

#: Longest word that is named by a polynomial.
POLYNOMIAL_BYTES = 255

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)


def _byte_values(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64)


BYTE_VALUES = _byte_values(20240601)

#: Words are runs without the six ASCII white-space bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of ASCII letters, digits and bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base=_BASE):
        self.base, self.inverse = int(base), pow(int(base), -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            step = np.full(max(n, CHUNK_BYTES + 1), self.base, U64)
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = self.inverse
            self.down = np.multiply.accumulate(step)
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Rolling:
    """Names of any sub-sequences [s, e) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, powers: Powers = POWERS):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def name(self, s, e, salt: int = 0) -> np.ndarray:
        size = np.asarray(e - s).astype(U64) + U64(salt)
        return mix((self.sums[e] - self.sums[s]) * self.down[s] ^ size * U64(0xD6E8FEB86659FD93))


    def grams(self, n: int, salt: int = 0) -> np.ndarray:
        """Names of all sub-sequences of n values."""
        size = U64((n + salt) * 0xD6E8FEB86659FD93 & (2**64 - 1))
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[:len(self.sums) - n] ^ size)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """Slices of Arrow batches with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a chunk: ``start``/``end`` byte positions and, per document,
    the range ``first[d]:first[d + 1]`` of its words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.raw, self.offsets = raw, offsets
        inside = table[raw]
        edge = offsets[(offsets > 0) & (offsets < len(raw))]
        left = inside.copy()
        left[1:] &= ~inside[:-1]
        left[edge] = inside[edge]
        right = inside
        keep = right[edge - 1].copy()
        right = right.copy()
        right[:-1] &= ~inside[1:]
        right[edge - 1] = keep
        self.start, self.end = np.flatnonzero(left), np.flatnonzero(right) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self):
        return len(self.start)

    def names(self, salt: int = 0) -> np.ndarray:
        """Names of the words.  Polynomials modulo 2**64 can be made to agree on words of a
        thousand bytes, so long words are named by a hash of another kind."""
        out = Rolling(BYTE_VALUES[self.raw]).name(self.start, self.end, salt)
        for k in np.flatnonzero(self.end - self.start > POLYNOMIAL_BYTES).tolist():
            word = self.raw[self.start[k]:self.end[k]].tobytes()
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
        return out

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of 0..n-1 that lie in any [start, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + size)."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def fields(docs: DataFrame, fresh: str) -> tuple[DataFrame, T.StructType]:
    """``docs`` without the columns that ``fresh`` (DDL) names, and the schema of both."""
    new = T.StructType.fromDDL(fresh).fields
    taken = {f.name.lower() for f in new}
    kept = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields if f.name.lower() not in taken]
    return docs.select(*[f"`{f.name}`" for f in kept]), T.StructType(kept + new)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded in bytes, not only in rows:
    texts may be very long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
