"""Token counts from flat token files: a separator scan.

A flat file is token ids one after the other, little-endian, each document closed by an end-of-document id;
there is no index.  Files are read in blocks.  Each block is searched on its own, all ids at once, and
leaves: tokens before its first separator, the sizes of the documents that lie wholly inside, tokens after its last.
A prefix scan over the blocks of a file numbers the documents and adds up what a document has in the blocks
that it crosses.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_rows, cut, slices

#: The end-of-document id and the vocabulary file of the default tokenizer.
END_OF_DOCUMENT = 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SCANNED = "file long, block long, key long, head long, sizes array<long>, tail long, ends long"


def _scan_block(ids: np.ndarray, end: int) -> tuple[int, list[int], int, int]:
    """(tokens before the first separator, sizes between separators, tokens after the last, separators)."""
    at = np.flatnonzero(ids == end)
    if not len(at):
        return 0, [], len(ids), 0
    return int(at[0]), (np.diff(at) - 1).tolist(), len(ids) - int(at[-1]) - 1, len(at)


def scan_blocks(blocks: DataFrame, *, end: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """One row for each row of ``blocks`` (file, block, ids, key): its scan; rows with a key and no ids pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(2).to_pylist():
                if raw is None:
                    rows.append((None, None, None, None))
                else:
                    rows.append(_scan_block(np.frombuffer(raw, f"<u{width}"), end))
            head, sizes, tail, ends = zip(*rows) if rows else ((), (), (), ())
            arrays = [pa.array(head, pa.int64()), pa.array(sizes, pa.list_(pa.int64())), pa.array(tail, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *arrays], ["file", "block", "key", "head", "sizes", "tail", "ends"])

    return blocks.select("file", "block", "ids", "key").mapInArrow(run, _SCANNED)


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens, ended): the documents of each file, from the scans of its blocks.

    Tokens after a file's last separator make a last document with ``ended`` false.  Files without tokens give no rows.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = scanned.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("past", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    # what has gathered since the last separator: all tails so far, less those before the block that holds it
    s = s.withColumn("carry", F.col("past") - F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("past")), ignorenulls=True).over(before), F.lit(0)))
    s = s.withColumn("final", F.lead("block").over(order).isNull())
    inside = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "sizes")).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    loose = F.when(F.col("final") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<long>"))
    rows = s.select("file", "first", "ends", F.posexplode(F.concat(inside, loose)).alias("k", "n_tokens"))
    return rows.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", (F.col("k") < F.col("ends")).alias("ended"))


def count_files(spark: SparkSession, path: str, *, end: int = END_OF_DOCUMENT, width: int = 2, block: int = 1 << 20, largest: int = 1 << 30) -> DataFrame:
    """(path, ordinal, n_tokens, ended) of the flat token files under ``path``.

    ``width`` bytes an id.  A file whose length is no multiple of it is cut short by the odd bytes.  Files of up to ``largest``
    bytes are read whole, one a row, and cut into blocks; larger ones are read in ranges, see ``count_large_files``.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = listed.filter(F.col("length") <= largest).select("path", F.xxhash64("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = raw[: len(raw) // width * width]
                for k in range(0, len(raw), block * width):
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([k // (block * width)], pa.int64()), pa.array([raw[k : k + block * width]], pa.binary()), pa.array([None], pa.int64())], ["file", "block", "ids", "key"])

    blocks = small.select("file", "content").mapInArrow(run, "file long, block long, ids binary, key long")
    counted = stitch(scan_blocks(blocks, end=end, width=width)).join(small.select("file", "path"), "file").drop("file")
    large = [r["path"] for r in listed.filter(F.col("length") > largest).select("path").collect()]  # names of large files alone
    return counted.unionByName(count_large_files(spark, large, end=end, width=width)) if large else counted


def count_large_files(spark: SparkSession, paths: list[str], *, end: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """``count_files`` for files of any size, which Spark's line reader scans for the separator's bytes in ranges of its own choice.

    The pieces between those bytes come in order within a range, and a prefix scan over pieces and ranges gives their places.  Bytes that
    look like the separator but lie across two ids are no separator; pieces around them are one.  An id whose bytes can overlap
    themselves (its first bytes equal its last) can't be scanned for in this way and is an error.
    """
    mark = end.to_bytes(width, "little")
    if any(mark[:k] == mark[-k:] for k in range(1, width)):
        raise ValueError(f"the bytes of id {end} overlap themselves; take files of at most 2 GB")
    text = mark.decode("latin1")
    lines = spark.read.option("lineSep", text).option("encoding", "ISO-8859-1").text(paths) if not text.isascii() else spark.read.option("lineSep", text).text(paths)
    m = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("k"), F.octet_length("value").cast("long").alias("n"))
    pieces = cut(m, "pieces")
    # ranges of a file in order, then pieces in order inside each
    ranges = pieces.groupBy("path", "range").agg(F.sum(F.col("n") + width).alias("all"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.join(ranges.withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).select("path", "range", "base"), ["path", "range"])
    inside = Window.partitionBy("path", "range").orderBy("k")
    placed = placed.withColumn("stop", F.col("base") + F.sum(F.col("n") + width).over(inside) - width)  # where the bytes after the piece begin
    real = (F.col("stop") + width <= F.col("size")) & (F.col("stop") % width == 0)
    marks = placed.filter(real).select("path", "size", "range", "stop")
    # documents are numbered by range, so that no task has all of a file
    held = marks.groupBy("path", "range").agg(F.count("*").alias("c"), F.max("stop").alias("last"))
    held = held.withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("past", F.coalesce(F.max("last").over(before) + width, F.lit(0)))
    row = Window.partitionBy("path", "range").orderBy("stop")
    docs = marks.join(held.select("path", "range", "first", "past"), ["path", "range"]).withColumn("from", F.coalesce(F.lag("stop").over(row) + width, F.col("past")))
    docs = docs.select("path", (F.col("first") + F.row_number().over(row) - 1).alias("ordinal"), ((F.col("stop") - F.col("from")) / width).cast("long").alias("n_tokens"), F.lit(True).alias("ended"))
    ends = pieces.groupBy("path").agg(F.max("size").alias("size")).join(held.groupBy("path").agg((F.max("last") + width).alias("at"), F.sum("c").alias("ordinal")), "path", "left")
    rest = F.floor((F.floor(F.col("size") / width) * width - F.coalesce("at", F.lit(0))) / width).cast("long")
    loose = ends.select("path", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended")).filter("n_tokens > 0")
    return docs.unionByName(loose)


def tokenize(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT, block: int = 1 << 16, width: int = 2) -> DataFrame:
    """(file, block, ids, key): the texts of each partition as one flat file in blocks, and its keys in order.

    ``vocabulary`` is read on the driver; ``width`` bytes an id, which must hold all its ids and ``end``.
    Rows with ids hold a block; rows with a key say which document comes at which place (block is the place).
    Null and empty texts are a lone separator.
    """
    with open(vocabulary, "rb") as f:  # read on the driver; executors need no copy
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(max(ranks.values()), end) >= 1 << (8 * width):
        raise ValueError(f"{width} bytes don't hold all ids of the vocabulary")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        file = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        size = number = place = 0

        def rows(numbers: list[int], ids: list, keys: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file] * len(numbers), pa.int64()), pa.array(numbers, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.int64())], ["file", "block", "ids", "key"])

        for batch in slices(batches, "text", 1 << 20):
            keys = batch.column(0).to_pylist()
            yield rows(list(range(place, place + len(keys))), [None] * len(keys), keys)
            place += len(keys)
            for raw in byte_rows(batch.column(1)):
                ids = coder.encode_ordinary(raw.decode("utf-8", "replace"))
                ids.append(end)
                held.append(np.array(ids, f"<u{width}"))
                size += len(ids)
            if size >= block:
                flat = np.concatenate(held)
                whole = size // block * block
                cut_at = range(0, whole, block)
                yield rows(list(range(number, number + len(cut_at))), [flat[k : k + block].tobytes() for k in cut_at], [None] * len(cut_at))
                number += len(cut_at)
                held, size = [flat[whole:]], size - whole
        if size:
            yield rows([number], [np.concatenate(held).tobytes()], [None])

    pair = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return pair.mapInArrow(run, "file long, block long, ids binary, key long")


def count_tokens(docs: DataFrame, *, key: str = "doc_id", end: int = END_OF_DOCUMENT, width: int = 2, **options) -> DataFrame:
    """(key, n_tokens) for each row of ``docs``, by way of flat files and their separators.

    Null and empty texts have 0 tokens; repeated rows are counted each; an empty table gives an empty result.
    """
    scanned = cut(scan_blocks(tokenize(docs, key=key, end=end, width=width, **options), end=end, width=width), "scanned")
    counts = stitch(scanned.filter("ends is not null"))
    places = scanned.filter("ends is null").select("file", F.col("block").alias("ordinal"), F.col("key").alias(key))
    return places.join(counts, ["file", "ordinal"]).select(key, "n_tokens")
