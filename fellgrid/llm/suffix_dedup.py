"""Repeated passages by sparse suffix arrays.

Suffixes begin at word positions that the content selects: minimisers, the position of the smallest hash among
each ``every`` successive ``gram``-word windows.  Two passages with the same ``gram + every - 1`` words hold at
least one suffix at the same place, so any passage that repeats over ``least`` words is met by suffixes in its
first ``every`` positions, of which at least ``least - every + 1`` words follow inside the passage.

1. Suffixes are grouped by their first ``least - every + 1`` words; those that occur once are dropped.
2. The others are sorted by their words and each is compared with its nearest neighbours in that order on both sides; sorted by what
   stands before them, it is compared with its neighbours there too.  Matches are extended to both sides word by word; those of ``least``
   words or more are repeated passages.
3. A suffix that was not compared shares no more words to the right than the furthest neighbour in the first order, and no more to
   the left than the furthest in the second.  The windows of ``least`` words that these bounds allow and no found match
   has (they begin up to ``every - 1`` words before the suffix) are in question.  They are looked up by their hashes among those of all suffixes
   of the group, which leaves nothing out.
4. Overlapping passages of one document become spans.

The sort is by ranges of (first words, rest), not by key, so a passage that a third of all documents share is
spread over many tasks; the rows at the seams of two tasks travel with both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, byte_rows, cut, slices, window_hashes

#: Bytes kept of each word's hash in a context.
_WORD = 3


def select_positions(h: np.ndarray, gram: int, every: int) -> np.ndarray:
    """Minimiser positions of one text: for each ``every`` successive windows the last of the smallest hashes."""
    if len(h) < gram:
        return np.zeros(0, np.int64)
    g = window_hashes(h, gram)
    if len(g) <= every:
        return np.array([len(g) - 1 - int(g[::-1].argmin())])
    view = np.lib.stride_tricks.sliding_window_view(g[::-1], every)
    return np.unique(len(g) - 1 - (np.arange(len(view)) + view.argmin(1)))


def _bytes_of(h: np.ndarray) -> bytes:
    """Words as ``_WORD`` bytes each, so that bytes sort like the sequence."""
    return np.ascontiguousarray(h.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :_WORD].tobytes()


def _suffixes(docs: DataFrame, *, text: str, gram: int, every: int, least: int) -> DataFrame:
    """(id, row, n, digest, pos, heads) for each text: its length in words, a digest of them, its suffixes and their first words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        size = least - every + 1
        for batch in slices(batches, "text"):
            ns, digests, poss, heads, offsets = [], [], [], [], [0]
            for raw in byte_rows(batch.column(2)):
                h = cache.of(raw.lower().split())
                ns.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                pos = np.zeros(0, np.int64)
                if len(h) >= least:
                    pos = select_positions(h, gram, every)
                    pos = pos[pos <= len(h) - size]
                    heads.append(window_hashes(h, size)[pos].view(np.int64))
                poss.append(pos)
                offsets.append(offsets[-1] + len(pos))
            flat = np.concatenate(poss).astype(np.int32)
            head = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            ends = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(ends, pa.array(head))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), *lists], ["id", "row", "n", "digest", "pos", "heads"])

    return _rows(docs, text).mapInArrow(run, "id long, row long, n long, digest binary, pos array<int>, heads array<long>")


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """(id, row, text): ``row`` tells the texts apart that share an id."""
    return docs.select("id", F.xxhash64(F.col(text).cast("string")).alias("row"), F.col(text).cast("string").alias("text"))


def _contexts(docs: DataFrame, wanted: DataFrame, *, text: str, every: int, least: int) -> DataFrame:
    """(head, row, pos, left, right): wanted suffixes, ``every`` words before each (nearest first) and ``least`` from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        size = least - every + 1
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for i, raw, marks in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), batch.column(2).to_pylist()):
                h = cache.of(raw.lower().split())
                heads = window_hashes(h, size).view(np.int64)
                forward, backward, n = _bytes_of(h), _bytes_of(h[::-1]), len(h)
                for m in marks:
                    p = m["pos"]
                    if p + size <= n and heads[p] == m["head"]:
                        out.append((m["head"], i, p, backward[(n - p) * _WORD : (n - p + every) * _WORD], forward[p * _WORD : (p + least) * _WORD]))
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 5, kinds)], ["head", "row", "pos", "left", "right"])

    marks = wanted.groupBy("id", "row").agg(F.collect_set(F.struct("pos", "head")).alias("marks"))
    return _rows(docs, text).join(marks, ["id", "row"]).select("row", "text", "marks").mapInArrow(run, "head long, row long, pos long, left binary, right binary")


def _words_of(contexts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts as rows of ``words`` words, shorter ones filled up; number of words of each)."""
    wide = words * _WORD
    flat = b"".join(c.ljust(wide, b"\0") for c in contexts)
    return np.frombuffer(flat, np.uint8).reshape(len(contexts), words, _WORD), np.array([len(c) // _WORD for c in contexts], np.int64)


def _agree(rows: np.ndarray, size: np.ndarray, apart: int) -> np.ndarray:
    """Number of equal words at the start of each context and the one ``apart`` rows on."""
    differ = (rows[apart:] != rows[:-apart]).any(2)
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(first, np.minimum(size[apart:], size[:-apart]))


def _matches(rows: list[tuple], side: int, every: int, least: int, near: int) -> np.ndarray:
    """(far, back, ahead) of rows (head, row, pos, left, right) in the order of a ``side`` (0: right, 1: left).

    Each is compared with the ``near`` rows before and after it.  far: most words that any row of its head beyond these can share on that
    side, as far as these rows tell (-1: there is none).  back, ahead: reach of the matches of ``least`` words or more, -1 without one.
    """
    n = len(rows)
    out = np.full((n, 3), -1, np.int64)
    if n < 2:
        return out
    name = np.array([r[:3] for r in rows], np.int64)
    left, right = _words_of([r[3] for r in rows], every), _words_of([r[4] for r in rows], least)
    for d in range(1, min(near, n - 1) + 1):
        head = name[d:, 0] == name[:-d, 0]
        to_left, to_right = _agree(*left, d), _agree(*right, d)
        long = head & (name[d:, 1:] != name[:-d, 1:]).any(1) & (to_left + to_right >= least)
        beyond = np.where(head, to_left if side else to_right, -1)
        for part, edge in ((out[d:], 0), (out[:-d], -1)):
            np.maximum(part[:, 1], np.where(long, to_left, -1), out=part[:, 1])
            np.maximum(part[:, 2], np.where(long, to_right, -1), out=part[:, 2])
            if d == near:
                np.maximum(part[:, 0], beyond, out=part[:, 0])
            else:  # the row that has just so many rows on that side
                part[edge, 0] = max(part[edge, 0], beyond[edge])
    return out


_NAMES = ["side", "row", "pos", "head", "far", "back", "ahead"]


def _reach(suffixes: DataFrame, side: int, every: int, least: int, near: int) -> DataFrame:
    """(side, row, pos, head, far, back, ahead) of each suffix from its neighbours in the order of one side; those at the seams of tasks have several rows."""
    order = ["right", "left"][:: -1 if side else 1]
    by = ["head", *order, "row", "pos"]
    columns = ["head", "row", "pos", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[tuple] = []  # rows that wait for those after them, and ``near`` rows before them
        done, first = 0, None

        def leave(found: np.ndarray, rows: list[tuple]) -> pa.RecordBatch:
            name = np.array([r[:3] for r in rows], np.int64).reshape(-1, 3)
            ints = [pa.array(np.full(len(rows), side, np.int8)), *(pa.array(c) for c in (name[:, 1], name[:, 2], name[:, 0], *found.T))]
            return pa.RecordBatch.from_arrays([*ints, pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary())], [*_NAMES, "left", "right"])

        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(5)))
            if not held:
                continue
            first = held[0] if first is None else first
            ready = len(held) - near
            if ready > done:
                yield leave(_matches(held, side, every, least, near)[done:ready], held[done:ready])
                cut_at = max(0, ready - near)
                held, done = held[cut_at:], ready - cut_at
        if held:
            yield leave(_matches(held, side, every, least, near)[done:], held[done:])
            # the first and the last row, for the neighbours in other tasks: numbered 2 task, 2 task + 1
            head, row, pos, left, right = zip(first, held[-1])
            ints = [pa.array([None, None], pa.int8()), *(pa.array(c, pa.int64()) for c in (row, pos, head, (2 * task, 2 * task + 1), (None, None), (None, None)))]
            yield pa.RecordBatch.from_arrays([*ints, pa.array(left, pa.binary()), pa.array(right, pa.binary())], [*_NAMES, "left", "right"])

    ordered = suffixes.select(*columns).repartitionByRange(*by).sortWithinPartitions(*by)
    found = cut(ordered.mapInArrow(run, "side byte, row long, pos long, head long, far long, back long, ahead long, left binary, right binary"), "matches")
    # two rows a task, so their number is that of tasks
    seams = [(h, i, p, bytes(left), bytes(right)) for h, i, p, left, right in found.filter("side is null").orderBy("far").select(*columns).collect()]
    across = []
    for x, y in zip(seams[1::2], seams[2::2]):
        across += [(side, r[1], r[2], r[0], *m) for r, m in zip((x, y), _matches([x, y], side, every, least, 1).tolist())]
    inside = found.filter("side is not null").select(*_NAMES)
    return inside.unionByName(suffixes.sparkSession.createDataFrame(across, "side byte, row long, pos long, head long, far long, back long, ahead long")) if across else inside


def _by_row(batches: Iterator[pa.RecordBatch], work) -> Iterator[tuple]:
    """``work`` (row, columns) for the records of each row, which come one after the other; the first column is the row."""
    held: list[pa.RecordBatch] = []

    def done() -> tuple:
        t = pa.Table.from_batches(held)
        return work(t.column(0)[0].as_py(), [c.to_numpy() for c in t.columns[1:]])

    for batch in batches:
        row = batch.column(0).to_numpy()
        edges = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1, len(row)]
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            if a == b:
                continue
            if held and held[-1].column(0)[0].as_py() != row[a]:
                yield done()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def _union(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans that intervals make together; those that touch or overlap become one."""
    order = np.lexsort((stop, start))
    start, stop = start[order], stop[order]
    reach = np.maximum.accumulate(stop)
    new = np.r_[True, start[1:] > reach[:-1]] if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return start[first], np.maximum.reduceat(stop, first) if len(first) else stop


def _resolve(reached: DataFrame, least: int, every: int) -> DataFrame:
    """(row, start, stop, head, need) of the matches, as spans of each row, head null; and of suffixes whose neighbours don't tell all.

    Those have their head, start = stop = the suffix's place, and bit o of need set for each window that begins o words before it and is in question.
    """

    def work(row: int, columns: list[np.ndarray]) -> tuple:
        side, pos, head, far, back, ahead = columns
        at, place = np.unique(pos, return_inverse=True)
        top = np.full((4, len(at)), -1, np.int64)
        heads = np.zeros(len(at), np.int64)
        heads[place] = head
        for k, values in ((0, np.where(side == 0, far, -1)), (1, np.where(side == 1, far, -1)), (2, back), (3, ahead)):
            np.maximum.at(top[k], place, values)
        right, left, back, ahead = top
        found = back >= 0
        start, stop = _union(at[found] - back[found], at[found] + ahead[found])
        o = np.arange(every)
        asked = (left[:, None] >= o) & (right[:, None] >= least - o) & ~((o <= back[:, None]) & (least - o <= ahead[:, None]))
        need = (asked.astype(np.int64) << o).sum(1)
        open_ = need != 0
        n, m = len(start), int(open_.sum())
        return [row] * (n + m), np.r_[start, at[open_]], np.r_[stop, at[open_]], [None] * n + heads[open_].tolist(), [None] * n + need[open_].tolist()

    return reached.select("row", "side", "pos", "head", "far", "back", "ahead").repartition("row").sortWithinPartitions("row").mapInArrow(lambda batches: _records(_by_row(batches, work)), _SPANS)


_SPANS = "row long, start long, stop long, head long, need long"


def _records(parts: Iterator[tuple], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SPANS.split(", ")]
    held: list[list] = [[] for _ in names]
    for part in parts:
        for a, b in zip(held, part):
            a.extend(b)
        if len(held[0]) > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names)
            held = [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names)


def _windows(suffixes: DataFrame, every: int, least: int) -> DataFrame:
    """(head, o, h, row, start, asked): the windows of ``least`` words of suffixes (…, need, own), for the bits o of need; asked: those of own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for head, row, pos, left, right, need, own in zip(*(batch.column(k).to_pylist() for k in range(7))):
                for o in range(max(0, least - len(right) // _WORD), min(every, len(left) // _WORD + 1)):
                    if need >> o & 1:
                        h = xxhash.xxh3_64_intdigest(left[: o * _WORD] + b"|" + right[: (least - o) * _WORD])
                        out.append((head, o, h - (1 << 64) if h >> 63 else h, row, pos - o, own >> o & 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 6)], ["head", "o", "h", "row", "start", "asked"])

    return suffixes.select("head", "row", "pos", "left", "right", "need", "own").mapInArrow(run, "head long, o long, h long, row long, start long, asked long")


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 50, gram: int = 8, every: int = 32, near: int = 4) -> DataFrame:
    """(key, start, stop, n_words) of the word spans of each document that repeat elsewhere, ``least`` words or longer.

    Words are compared with A-Z lower-cased (by hashes of 24 bits a word).  Elsewhere is another row or another place of the same text.
    Texts that are null, empty or shorter than ``least`` words have no spans, rows without a key are left out.
    Rows that repeat a text are copies of each other, whole; rows that share a key each bring the spans of their text under it.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    if every > 62:
        raise ValueError("suffixes at most 62 words apart")
    docs = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = cut(_suffixes(docs, text="text", gram=gram, every=every, least=least).filter(F.col("n") >= least), "suffixes")
    # equal texts: one goes on, all are repeated from start to end
    classes = cut(found.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("rows")).select("digest", "first.id", "first.row", "rows"), "classes")
    copies = found.select("id", "n", "digest").join(classes.filter("rows > 1").select("digest"), "digest").select("id", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))
    alone = found.join(classes.select("digest", "id", "row"), ["digest", "id", "row"], "left_semi").dropDuplicates(["digest"])
    rows = cut(alone.select("id", "row", F.explode(F.arrays_zip("pos", "heads")).alias("x")).select("id", "row", F.col("x.pos").alias("pos"), F.col("x.heads").alias("head")), "rows")
    often = cut(rows.groupBy("head").agg(F.count("*").alias("c")).filter("c > 1").select("head"), "often")  # a table, so that the join can split frequent heads
    suffixes = cut(_contexts(docs, rows.join(often, "head", "left_semi"), text="text", every=every, least=least), "contexts")
    spans = cut(_resolve(_reach(suffixes, 0, every, least, near).unionByName(_reach(suffixes, 1, every, least, near)), least, every), "spans")
    matches = spans.filter("head is null").select("row", "start", "stop")
    asking = spans.filter("head is not null")
    hard = cut(asking.groupBy("head").agg(F.bit_or("need").alias("need")), "hard")
    if hard.limit(1).count():
        own = asking.select("head", "row", F.col("start").alias("pos"), F.col("need").alias("own"))
        members = suffixes.join(hard, "head").join(own, ["head", "row", "pos"], "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
        windows = cut(_windows(members, every, least), "windows")
        again = windows.groupBy("head", "o", "h").agg(F.count("*").alias("c"), F.max("asked").alias("asked")).filter("c > 1 and asked = 1").select("head", "o", "h")
        more = windows.filter("asked = 1").join(again, ["head", "o", "h"], "left_semi").select("row", "start", (F.col("start") + least).alias("stop"))

        def work(row: int, columns: list[np.ndarray]) -> tuple:
            start, stop = _union(*columns)
            return [row] * len(start), start, stop, [None] * len(start), [None] * len(start)

        both = matches.unionByName(more).repartition("row").sortWithinPartitions("row")
        matches = both.mapInArrow(lambda batches: _records(_by_row(batches, work)), _SPANS).select("row", "start", "stop")
    named = matches.join(classes.filter("rows = 1").select("id", "row"), "row").select("id", "start", "stop")
    return named.unionByName(copies).select(F.col("id").alias(key), "start", "stop", (F.col("stop") - F.col("start")).alias("n_words")).distinct()
