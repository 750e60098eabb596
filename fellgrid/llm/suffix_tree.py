"""Language-model scoring by a probabilistic suffix tree over bytes.

A text is read as its lower-cased words, each followed by a space, and an end symbol.  Candidate contexts are
all runs of up to ``depth`` symbols (within a text) that were seen ``fewest`` times or more in the texts that train; the model has no
other bound, so it grows with the corpus.  A candidate is retained if its next-symbol distribution diverges
from its longest retained suffix's: count-weighted Kullback-Leibler divergence of at least ``gain`` nats, and
one symbol whose probability rises by ``ratio`` or more.  Distributions are smoothed
towards the suffix's by the number of different symbols that followed (Witten-Bell).  The probability of a symbol
is that of the longest retained suffix of what stands before it.

The tree is spread, and never in one place:

1. Texts are dealt into parts of about ``part_bytes``.  Each part leaves its different grams of ``depth`` + 1 symbols
   with their counts in texts that train (0 for grams of other texts), as packed arrays by shard; a shard has the grams whose last three
   context symbols have one hash, so it holds whole subtrees below these.
2. Contexts of up to two symbols (65,793 at most) make a tree that all executors get.  Below it each shard's task
   grows its subtrees from all parts' grams, and answers each gram of each part with its probability.
3. Each part's texts meet the part's answers, and are scored by looking up each symbol's gram.

The plain model next to it counts words: log10((c + 1) / (N + V + 1)) for each word and one end a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Lookup, WordHash, byte_rows, cut, mix, slices

#: The end of a text as a symbol of its own; no word holds this byte.
END = 10
_END_WORD = 0x656E64  # hash that stands for the end among words
_NEAR = 3  # context symbols that a shard's grams share


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """(symbols of all texts end to end, length of each, words of each); zero bytes count as ones, as zero stands for what is before a text."""
    split = [t.lower().split() for t in texts]
    parts = [b" ".join(w) + (b" \n" if w else b"\n") for w in split]
    return np.maximum(np.frombuffer(b"".join(parts), np.uint8), 1), np.array([len(p) for p in parts], np.int64), split


def grams_of(symbols: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """The gram of ``width`` symbols that ends at each symbol, the last in the lowest byte; zero bytes stand before a text's start."""
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    age = np.arange(len(symbols)) - first
    code = symbols.astype(np.uint64)
    for back in range(1, width):
        moved = np.zeros(len(symbols), np.uint64)
        moved[back:] = symbols[: len(symbols) - back]
        moved[age < back] = 0
        code |= moved << np.uint64(8 * back)
    return code


def _shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return (mix((codes >> np.uint64(8)) & np.uint64((1 << (8 * _NEAR)) - 1)) % np.uint64(shards)).astype(np.int64)


class _Counts:
    """Counts of keys, added up a few millions at a time."""

    def __init__(self, most: int = 3_000_000):
        self.most, self.held, self.size = most, [], 0

    def add(self, keys: np.ndarray, counted: bool = True) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.held.append((found, n if counted else np.zeros(len(found), np.int64)))
        self.size += len(found)
        if self.size > self.most:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held) != 1:
            keys = np.concatenate([k for k, _ in self.held]) if self.held else np.zeros(0, np.uint64)
            n = np.concatenate([n for _, n in self.held]) if self.held else np.zeros(0, np.int64)
            names, where = np.unique(keys, return_inverse=True)
            self.held = [(names, np.bincount(where, n, minlength=len(names)).astype(np.int64))]
        self.size = len(self.held[0][0])
        return self.held[0]


_COUNTED = "kind byte, part int, key long, n long, codes binary, counts binary"


def count_parts(rows: DataFrame, *, depth: int, shards: int, most: int = 8_000_000) -> DataFrame:
    """From (part, learn, text): packed grams of each part and shard (kind 0), counts of words (kind 1) and of grams of three symbols (kind 2) in texts that train.

    A part with more than ``most`` different grams leaves them in several rows a shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        names = [c.split()[0] for c in _COUNTED.split(", ")]

        def plain(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            some = n > 0
            keys, n = keys[some].view(np.int64), n[some]
            for k in range(0, len(keys), 100_000):
                m = len(keys[k : k + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), pa.nulls(m, pa.int32()), pa.array(keys[k : k + m]), pa.array(n[k : k + m]), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names)

        def leave(part: int, grams: _Counts) -> Iterator[pa.RecordBatch]:
            codes, n = grams.merge()
            if not len(codes):
                return
            short = _Counts()
            low, where = np.unique(codes & np.uint64(0xFFFFFF), return_inverse=True)
            short.held = [(low, np.bincount(where, n, minlength=len(low)).astype(np.int64))]
            yield from plain(2, *short.merge())
            shard = _shard_of(codes, shards)
            order = np.argsort(shard, kind="stable")
            codes, n, shard = codes[order], np.minimum(n[order], 0xFFFFFFFF).astype(np.uint32), shard[order]
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for k in range(0, len(edges) - 1, 500):
                cuts = edges[k : k + 501]
                pairs = list(zip(cuts.tolist(), cuts[1:].tolist()))
                m = len(pairs)
                blobs = [pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for x in (codes, n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), pa.array(np.full(m, part, np.int32)), pa.array(shard[cuts[:-1]]), pa.array(np.diff(cuts)), *blobs], names)

        held, grams, words = None, _Counts(), _Counts()
        for batch in slices(batches, "text", 2 << 20):
            part = batch.column(0).to_numpy()
            for p in np.unique(part).tolist():
                if held is not None and (p != held or grams.size > most):
                    yield from leave(held, grams)
                    grams = _Counts()
                held = p
                for learn in (True, False):
                    here = np.flatnonzero((part == p) & (batch.column(1).to_numpy(zero_copy_only=False) == learn))
                    if not len(here):
                        continue
                    symbols, lengths, split = _stream(byte_rows(batch.column(2).take(pa.array(here))))
                    grams.add(grams_of(symbols, lengths, depth + 1), learn)
                    if learn:
                        words.add(np.concatenate([cache.of([w for s in split for w in s]), np.full(len(split), _END_WORD, np.uint64)]))
                        if words.size > words.most // 2:
                            yield from plain(1, *words.merge())
                            words = _Counts()
        if held is not None:
            yield from leave(held, grams)
        yield from plain(1, *words.merge())

    return rows.select("part", "learn", "text").mapInArrow(run, _COUNTED)


@dataclass
class Rules:
    """When a context is retained."""

    fewest: int = 4
    gain: float = 4.0
    ratio: float = 1.2


def refine(place: np.ndarray, counts: np.ndarray, parent: np.ndarray, valid: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each entry, whether its context is retained, rest) one symbol further back.

    An entry is a symbol after a context, whose number is ``place``; its count may be 0.  ``parent``: its probability after the context's
    longest retained suffix.  ``valid``: contexts that can be retained.  rest: what the context leaves to the suffix for each unit of its probability.
    """
    size = len(valid)
    n = np.bincount(place, counts, minlength=size)
    kinds = np.bincount(place, counts > 0, minlength=size)
    some = counts > 0
    share = np.where(some, counts / np.maximum(n[place], 1), 1.0)
    spread = np.bincount(place, np.where(some, counts * np.log(share / parent), 0.0), minlength=size)
    rest = kinds / np.maximum(n + kinds, 1)
    smooth = counts / np.maximum(n + kinds, 1)[place] + rest[place] * parent
    lift = np.zeros(size)
    np.maximum.at(lift, place[some], smooth[some] / parent[some])
    keep = valid & (n >= rules.fewest) & (spread >= rules.gain) & (lift >= rules.ratio)
    return np.where(keep[place], smooth, parent), keep, rest


def low_tree(codes: np.ndarray, counts: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(row of each context of two symbols, probabilities[row, symbol]): contexts of up to two symbols, from counts of grams of three.

    The root shares out what Witten-Bell leaves over all 255 symbols evenly.
    """
    counts = counts.astype(np.float64)
    symbol = (codes & np.uint64(255)).astype(np.int64)
    first = np.bincount(symbol, counts, minlength=256)
    first[0] = 0
    kinds = (first > 0).sum()
    root = (first + max(kinds, 1) / 255) / (first.sum() + max(kinds, 1))
    rows, row = [root[None]], np.zeros(1 << 16, np.int64)
    used = 1
    for d in (1, 2):
        entry, where = np.unique(codes & np.uint64((1 << (8 * (d + 1))) - 1), return_inverse=True)
        c = np.bincount(where, counts, minlength=len(entry))
        context, place = np.unique((entry >> np.uint64(8)).astype(np.int64), return_inverse=True)
        table = np.concatenate(rows)
        sym = (entry & np.uint64(255)).astype(np.int64)
        above = row[context & 255] if d == 2 else np.zeros(len(context), np.int64)
        parent = table[above[place], sym]
        p, keep, rest = refine(place, c, parent, context >> (8 * (d - 1)) > 0, rules)
        kept = np.flatnonzero(keep)
        fresh = table[above[kept]] * rest[kept][:, None]
        number = np.full(len(context), -1)
        number[kept] = np.arange(len(kept))
        seen = keep[place]
        fresh[number[place[seen]], sym[seen]] = p[seen]
        rows.append(fresh)
        if d == 1:
            for c1, k in zip(context[kept].tolist(), range(len(kept))):  # all contexts of two symbols that end in it
                row[c1::256] = used + k
        else:
            row[context[kept]] = used + np.arange(len(kept))
        used += len(kept)
    return row, np.concatenate(rows)


def log_probabilities(codes: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], depth: int, rules: Rules) -> np.ndarray:
    """log10 of each gram's last symbol's probability after the others, for all grams of a shard (equal ones may come more than once; their counts add up)."""
    names, inverse = np.unique(codes, return_inverse=True)
    c = np.bincount(inverse, counts, minlength=len(names))
    row, table = low
    p = table[row[((names >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)], (names & np.uint64(255)).astype(np.int64)]
    for d in range(_NEAR, depth + 1):
        entry, first, where = np.unique(names & np.uint64((1 << (8 * (d + 1))) - 1), return_index=True, return_inverse=True)
        context = entry >> np.uint64(8)
        new = np.r_[True, context[1:] != context[:-1]]
        place = np.cumsum(new) - 1
        better, _, _ = refine(place, np.bincount(where, c, minlength=len(entry)), p[first], context[new] >> np.uint64(8 * (d - 1)) > 0, rules)
        p = better[where]
    return np.log10(p).astype(np.float32)[inverse]


def _answers(blobs: DataFrame, low: tuple[np.ndarray, np.ndarray], depth: int, rules: Rules) -> DataFrame:
    """(part, codes, logs) from (shard, part, codes, counts); a task has whole shards."""
    shared = blobs.sparkSession.sparkContext.broadcast((low[0].astype(np.int32), low[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, part, codes, counts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.setdefault(shard, []).append((part, np.frombuffer(codes, np.uint64), np.frombuffer(counts, np.uint32)))
        for shard in list(held):
            rows = held.pop(shard)
            logs = log_probabilities(np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype(np.float64), shared.value, depth, rules)
            ends = np.cumsum([0, *(len(r[1]) for r in rows)])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([logs[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["part", "codes", "logs"])

    return blobs.select("shard", "part", "codes", "counts").mapInArrow(run, "part int, codes binary, logs binary")


def score_texts(
    docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", depth: int = 6, fewest: int = 4, gain: float = 4.0, ratio: float = 1.2, part_bytes: int = 96 << 20, head: int = 1 << 16
) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    The model learns from the rows where ``learn`` is true (null: it isn't).  Null and empty texts consist of the end alone.  Without rows to learn from
    distributions are uniform.  Repeated rows are scored each; other columns are ignored, so their names can't clash.  An empty table gives an empty result.

    ``docs`` is read twice and must come in the same partitions both times, as files do; a plan that deals rows
    anew is better written first.  Texts whose grams are not among their part's are an error, never a wrong score.

    Words are counted over all rows to learn from.  The ``head`` most frequent words' counts go to all
    executors (a fixed number); the other words of the texts meet their counts in a join.
    """
    if not 3 <= depth <= 7:
        raise ValueError("contexts of three to seven symbols fit a gram's 64 bits")
    spark, rules = docs.sparkSession, Rules(fewest, gain, ratio)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(learn.cast("boolean"), F.lit(False)).alias("learn"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(4, -(-int(size) // part_bytes))
    shards = min(8 * parts, 1 << 16)
    # equal rows of several partitions of the source go to several parts
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(parts)).cast("int"))
    counts = cut(count_parts(rows.repartitionById(parts, "part"), depth=depth, shards=shards), "counts")
    words = counts.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n"))
    n_tokens, n_types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.desc("n"), "key").limit(head).select("key", "n").toArrow()
    frequent = dict(zip(top["key"].to_pylist(), top["n"].to_pylist()))
    short = counts.filter("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # 2**24 at most
    low = low_tree(short["key"].to_numpy().view(np.uint64), short["n"].to_numpy(), rules)
    blobs = counts.filter("kind = 0").select(F.col("key").cast("int").alias("shard"), "part", "codes", "counts")
    answers = _answers(blobs.repartitionById(shards, "shard"), low, depth, rules)
    names = np.array(sorted(frequent), np.int64)
    shared = spark.sparkContext.broadcast((names, np.array([frequent[k] for k in names.tolist()], np.int64)))
    whole = float(n_tokens + n_types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns = shared.value
        cache = WordHash()
        packed: list[tuple[bytes, bytes]] = []
        known = None

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Take the answers, which come first, and hand on the texts."""
            for batch in batches:
                is_text = batch.column(0).to_numpy() == 1
                for i in np.flatnonzero(~is_text).tolist():
                    packed.append((batch.column(3)[i].as_py(), batch.column(4)[i].as_py()))
                yield batch.select([1, 2]).filter(pa.array(is_text))

        for batch in slices(texts(batches), "text", 1 << 20):
            if known is None:
                known = Lookup(np.frombuffer(b"".join(c for c, _ in packed), np.uint64), np.frombuffer(b"".join(x for _, x in packed), np.float32))
                packed.clear()
            symbols, lengths, split = _stream(byte_rows(batch.column(1)))
            size = len(split)
            counts_of = [len(s) + 1 for s in split]
            doc = np.repeat(np.arange(size), counts_of)
            ends = np.cumsum(counts_of) - 1
            h = np.full(len(doc), _END_WORD, np.uint64)
            inner = np.ones(len(doc), bool)
            inner[ends] = False
            h[inner] = cache.of([w for s in split for w in s])
            h = h.view(np.int64)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            logs_of = known.of(grams_of(symbols, lengths, depth + 1))
            score = np.bincount(np.repeat(np.arange(size), lengths), logs_of, minlength=size)
            logs = np.bincount(doc[found], np.log10(ns[at[found]] + 1.0), minlength=size)
            n_known = np.bincount(doc[found], minlength=size)
            order = np.lexsort((h[~found], doc[~found]))
            d, k = doc[~found][order], h[~found][order]
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(size + 1)), pa.int32()), pa.array(k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(counts_of, np.int64)), pa.array(n_known), pa.array(logs, pa.float64()), pa.array(score, pa.float64()), rare], ["id", "n_tokens", "known", "logs", "score", "rare"])

    both = rows.select("part", F.lit(1).cast("byte").alias("kind"), "id", "text", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("logs")).unionByName(
        answers.select("part", F.lit(0).cast("byte").alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "codes", "logs")
    )
    placed = both.repartitionById(parts, "part").sortWithinPartitions("kind").select("kind", "id", "text", "codes", "logs")
    scored = placed.mapInArrow(run, "id long, n_tokens long, known long, logs double, score double, rare array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    least_n = min(frequent.values(), default=0) if len(frequent) == head else None
    tail = words.select("key", "n") if least_n is None else words.filter(F.col("n") <= least_n).select("key", "n")
    asked = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    met = asked.join(tail, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    full = scored.drop("rare").join(met, "row", "left")
    return full.select(
        F.col("id").alias(key),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(whole))).alias("base_score"),
        "score",
    )
