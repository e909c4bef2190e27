"""Sorted hash arrays in the shared folder, mapped into memory by the tasks that look things up.

Keys are 48-bit hashes. They are dealt over buckets by hash; a bucket is one file with all arrays of its table. Tables
are written by tasks, one bucket each, and never pass through the driver. A mapped table is one mapping and holds no open
file, so a task may use as many buckets as there are.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.session import scratch_path

BITS = 48
#: Arrays begin at multiples of this in a file.
ALIGN = np.lib.format.ARRAY_ALIGN


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(key) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Columns of 48-bit keys, the first one sorted, and counts, as compressed byte planes."""
    first = np.diff(columns[0], prepend=np.uint64(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes() for c in (first, *columns[1:])]
    return zstandard.compress(b"".join([*planes, counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()]), 1)


def unpack(blob: bytes, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
    n = len(raw) // (6 * columns + 8)
    found = []
    for k in range(columns):
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :6] = raw[6 * n * k : 6 * n * (k + 1)].reshape(6, n).T
        found.append(wide.view(np.uint64).ravel())
    found[0] = np.cumsum(found[0], dtype=np.uint64)
    return found, np.ascontiguousarray(raw[6 * n * columns :].reshape(8, n).T).view(np.uint64).ravel().astype(np.int64)


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with their summed counts."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns, counts = [c[order] for c in columns], counts[order]
    new = np.ones(len(counts), dtype=bool)
    if len(counts):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts, at) if len(at) else counts


@dataclass(frozen=True)
class Shelf:
    """Arrays in a folder of the shared file system; they are mapped from there, or from a local copy if it has no paths."""

    uri: str

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.uri)
        return system, f"{path}/{name}"

    def write(self, name: str, *arrays: np.ndarray) -> None:
        """Some arrays of one dimension as one file.

        Written aside first, then renamed: a repeated or lost task leaves a whole file or none.
        """
        system, path = self._at(name)
        system.create_dir(os.path.dirname(path), recursive=True)
        aside = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        with system.open_output_stream(aside) as out:
            for array in arrays:
                np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
                out.write(bytes(-array.nbytes % ALIGN))
        system.move(aside, path)

    def read(self, name: str) -> list[np.ndarray]:
        """The arrays of a file, mapped together; the mapping lasts as long as they do, the file is closed at once."""
        system, path = self._at(name)
        if not isinstance(system, fs.LocalFileSystem):
            local = os.path.join(tempfile.gettempdir(), self.uri.rsplit("/", 1)[-1], name)
            if not os.path.exists(local):
                os.makedirs(os.path.dirname(local), exist_ok=True)
                fs.copy_files(path, f"{local}.{os.getpid()}", source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
                os.replace(f"{local}.{os.getpid()}", local)
            path = local
        with pa.memory_map(path) as file:
            whole = file.read_buffer()
        found, source = [], pa.BufferReader(whole)
        while source.tell() < whole.size:
            np.lib.format.read_magic(source)
            (n,), _, kind = np.lib.format.read_array_header_1_0(source)
            found.append(np.frombuffer(whole, kind, n, source.tell()))
            source.seek(source.tell() + -(-found[-1].nbytes // ALIGN) * ALIGN)
        return found


class SortedTable:
    """Sorted 48-bit keys with values: an index over the upper bits, the next 32 bits of each key, and value arrays."""

    def __init__(self, shelf: Shelf, name: str) -> None:
        names, self.index, self.low, *arrays = shelf.read(f"{name}.npy")
        self.arrays = dict(zip(names.astype(str).tolist(), arrays))
        self.bits = (len(self.index) - 1).bit_length() - 1

    @staticmethod
    def write(shelf: Shelf, name: str, keys: np.ndarray, **values: np.ndarray) -> None:
        bits = min(16, max(4, int(len(keys) // 8).bit_length()))
        short = keys >> np.uint64(BITS - bits - 32)
        index = np.searchsorted(short >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
        shelf.write(f"{name}.npy", np.array([*values], "S"), index, (short & np.uint64(0xFFFFFFFF)).astype(np.uint32), *values.values())

    def values(self, name: str) -> np.ndarray:
        return self.arrays[name]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        short = keys >> np.uint64(BITS - self.bits - 32)
        high, low = (short >> np.uint64(32)).astype(np.int64), (short & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        a, end = self.index[high].astype(np.int64), self.index[high + 1].astype(np.int64)
        b = end.copy()
        while len(open_ := np.flatnonzero(a < b)):
            middle = (a[open_] + b[open_]) >> 1
            less = self.low[middle] < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
        if not len(self.low):
            return np.full(len(keys), -1)
        hit = (a < end) & (self.low[np.minimum(a, len(self.low) - 1)] == low)
        return np.where(hit, a, -1)


def split_by_bucket(bucket: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One packed part for each bucket; rows keep their order."""
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(at, [*at[1:], len(order)]):
        rows = order[a:b]
        yield int(bucket[rows[0]]), pack([c[rows] for c in columns], counts[rows])


def new_shelf(spark: SparkSession, label: str) -> Shelf:
    root = scratch_path(spark, label)
    return Shelf(root if root.startswith("file:") or "://" in root else f"file://{root}")


@dataclass
class HashTable:
    """The keys of a table column; what was opened stays open in the task."""

    shelf: Shelf
    buckets: int
    opened: dict = field(default_factory=dict)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of some 64-bit values are in the table, but for a chance of about one in 2 to the 48 per entry."""
        short = mix(keys.view(np.uint64)) >> np.uint64(64 - BITS)
        bucket, out = bucket_of(short, self.buckets), np.zeros(len(keys), dtype=bool)
        for b in np.unique(bucket).tolist():
            if b not in self.opened:
                self.opened[b] = SortedTable(self.shelf, str(b))
            at = np.flatnonzero(bucket == b)
            out[at] = self.opened[b].find(short[at]) >= 0
        return out


def hash_table(df: DataFrame, column: str, per_bucket: int = 1_000_000) -> HashTable:
    """Write the distinct 64-bit values of a column as a table; null is no value."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    buckets = max(1, -(-values.count() // per_bucket))
    shelf = new_shelf(df.sparkSession, "keys")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = np.unique(mix(batch["value"].to_numpy().view(np.uint64)) >> np.uint64(64 - BITS))
            yield pd.DataFrame(split_by_bucket(bucket_of(keys, buckets), [keys], np.ones(len(keys), np.int64)), columns=["bucket", "part"])

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        SortedTable.write(shelf, str(key[0]), np.unique(np.concatenate([unpack(p, 1)[0][0] for p in parts["part"]])))
        return parts[["bucket"]].head(1)

    made = values.mapInPandas(deal, "bucket int, part binary").groupBy("bucket").applyInPandas(merge, "bucket int").toPandas()
    fill_gaps(shelf, buckets, made["bucket"])
    return HashTable(shelf, buckets)


def fill_gaps(shelf: Shelf, buckets: int, there, prefix: str = "", **values: np.ndarray) -> None:
    """Empty tables for the buckets that no key fell into."""
    for b in set(range(buckets)) - {int(b) for b in there}:
        SortedTable.write(shelf, f"{prefix}{b}", np.zeros(0, np.uint64), **values)
