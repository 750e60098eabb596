"""Shared pieces of the training-data operators: lineage cuts, word hashing and label propagation.

A word is a maximal run of bytes outside space, tab, newline, vertical tab, form feed and carriage
return.  ``bytes.split()`` has exactly these separators and ``bytes.lower()`` changes A-Z only, so both
work on UTF-8 without decoding.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop, work_dir

WORD = r"[^\x20\x09-\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def cut(df: DataFrame, name: str = "cut", rows: int = 2000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    While it is written, batches sent to Python hold at most ``rows`` rows, as rows here can be long.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, most = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(most)
    conf.set(most, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        df.write.parquet(path)
    finally:
        conf.set(most, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fellgrid_path = path
    return out


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with marks added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of text, whatever the row lengths are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=float))
        group = (np.cumsum(sizes) // most).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
            pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Memory that was freed goes back to the system; the allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, TypeError, AttributeError):  # glibc's; other C libraries have none
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int = 4 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving memory back each ``most`` bytes of input and when its arrays are gone.

    Python workers outlive their tasks, idle ones too, and share their executor's memory with its JVM.
    """

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[pa.RecordBatch]:
            size = 0
            for batch in batches:
                size += batch.nbytes
                yield batch
                if size >= most:
                    size = 0
                    give_back()

        yield from run(read())
        give_back()

    return lean_run


class WordHash(dict):
    """word -> 64-bit hash, remembered for a bounded number of words."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lookup:
    """Values by key (64-bit, not 0) in arrays: each key stands at the first free place from where its hash points to."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, first = np.unique(keys, return_index=True)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, values.dtype)
        waiting = np.arange(len(keys))
        place = self._first(keys)
        while len(waiting):  # of several that want one free place one gets it, the others go on
            want = place[waiting]
            free = self.keys[want] == 0
            self.keys[want[free]] = keys[waiting[free]]
            self.values[want[free]] = values[first[waiting[free]]]
            waiting = waiting[self.keys[want] != keys[waiting]]
            place[waiting] = (place[waiting] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; an error for keys that are not there."""
        place = self._first(keys)
        open_ = np.flatnonzero(self.keys[place] != keys)
        while len(open_):
            if (self.keys[place[open_]] == 0).any():
                raise RuntimeError("a key without a value: the rows came in other partitions than before")
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            open_ = open_[self.keys[place[open_]] != keys[open_]]
        return self.values[place]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; of the whole sequence if it is shorter; none if it is empty."""
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _MIX + h[i : len(h) - n + 1 + i]
    return mix(out + np.uint64(n))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over undirected ``edges`` (a, b), for each id of ``nodes``.

    Alternates hooking of roots with pointer jumping, so a chain of length n takes about log n rounds.
    Everything is joins and map-side combined minima; the driver sees only a count of changes.
    """
    both = cut(
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .filter("src <> dst")
        .distinct(),
        "edges",
    )
    touched = both.select(F.col("src").alias("id")).distinct()
    label = cut(touched.select("id", F.col("id").alias("component")), "labels")
    for _ in range(most_rounds):
        lab = label.select(F.col("id").alias("src"), F.col("component").alias("c"))
        near = both.join(lab, "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("near"))
        seen = label.join(near, "id").select("id", "component", F.least("component", "near").alias("near"))
        # a root takes the smallest label any of its members has seen, and members follow their root
        root = seen.groupBy(F.col("component").alias("root")).agg(F.min("near").alias("to"))
        hooked = cut(
            seen.join(root, seen["component"] == root["root"]).select(
                "id", F.least("near", "to").alias("component"), (F.least("near", "to") != F.col("component")).alias("moved")
            ),
            "hooked",
        )
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = cut(hooked.join(jump, "component").select("id", F.col("far").alias("component")), "labels")
        moved = hooked.filter("moved").limit(1).count()
        drop(label), drop(hooked)
        label = new
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
