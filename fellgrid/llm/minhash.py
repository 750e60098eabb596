"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. Every text becomes its set of word-shingle hashes, a digest of that set, and the ``k`` smallest hashes
   (the bottom-k sketch).  Texts with one digest form a class; only the class's smallest id goes on.
2. Inverted lists of the retained values.  Of each sketch only the values that are rarest over all sketches
   go on (prefix filter in order of frequency): sets that are similar enough share at least ``k - p + 1``
   values of their sketches, so their first ``p`` in any common order meet.  Values that occur once are in the
   prefix but make no list.  A passage that a third of all texts quotes is frequent, hence last.
3. Each list links its members to its pivot, the member with fewest values of its own.  The sketches' overlap
   filters these pairs (union-sketch estimate), the full sets decide, and links become components.
4. Lists that still span several components are searched in whole: members outside the list's
   largest component meet all members.  Both are dealt into blocks, and a block of the ones meets a block of the others in a tile, so no
   tile has more rows than two blocks and each pair meets once.  Pairs above the threshold by the first values of their sets (exact for
   sets that small) link; others that may reach it are decided on the full sets.  First each member brings
   its best partners only; then, for what is still apart, all.

Pairs inside one component are never made, so a group of n copies costs about n comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, byte_rows, components, cut, lean, slices, window_hashes

#: Bytes kept of each hash in a stored set: 48 bits, so that two of a pair's hashes meet by chance once in about 10**9 pairs.
_BYTES = 6


def _sets(texts: list[bytes], cache: WordHash, size: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield np.unique(window_hashes(cache.of(text.lower().split()), size))


def sketch_texts(docs: DataFrame, *, key: str, text: str, size: int, k: int) -> DataFrame:
    """(id, n, digest, sketch, u) for each row: set size, digest of the set, bottom-k values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in slices(batches, "text"):
            ns, digests, flat, offsets = [], [], [], [0]
            for s in _sets(byte_rows(batch.column(1)), cache, size):
                ns.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                flat.append(s[:k])
                offsets.append(offsets[-1] + min(k, len(s)))
            values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), sketch], ["id", "n", "digest", "sketch"])

    pair = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return pair.mapInArrow(lean(run), "id long, n long, digest binary, sketch array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, *, key: str, text: str, size: int) -> DataFrame:
    """(id, n, body): the sorted set of each wanted id, ``_BYTES`` big-endian bytes a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in slices(batches, "text"):
            ns, bodies = [], []
            for s in _sets(byte_rows(batch.column(1)), cache, size):
                top = np.ascontiguousarray(s.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :_BYTES]
                ns.append(len(s))
                bodies.append(top.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(bodies, pa.binary())], ["id", "n", "body"])

    pair = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return pair.join(wanted, "id", "left_semi").mapInArrow(lean(run), "id long, n long, body binary")


def _values(body) -> np.ndarray:
    """Back to integers, in ascending order."""
    raw = np.frombuffer(body, np.uint8).reshape(-1, _BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - _BYTES :] = raw
    return wide.view(">u8").ravel().astype(np.int64)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = _values(a.as_buffer()), _values(b.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("body").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("body").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def _tile(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, out: np.ndarray, asks: np.ndarray, heads: list[np.ndarray], percent: int, first: int, best: int | None) -> tuple[list[tuple[int, int, bool]], bool]:
    """Candidate pairs across components of one list: rows that ask (outside the main component) with rows of a block of members, by the first values of the sets.

    Returns (a, b, sure): sure pairs are decided (both sets are whole here); of those only a spanning forest
    is returned.  Of the others each member outside the main component brings its ``best`` (None: all); the
    second value says whether that left any out.
    """
    names, flat = np.unique(np.concatenate(heads), return_inverse=True)
    length = np.array([len(x) for x in heads])
    starts = np.r_[0, np.cumsum(length)[:-1]]
    table = np.full((len(heads), length.max()), np.iinfo(np.int64).max)
    for row, x in zip(table, heads):
        row[: len(x)] = x
    tail = np.where(n > first, np.array([x[-1] for x in heads]), np.iinfo(np.int64).max - 1)
    least = percent / 100 - 4 * math.sqrt(percent / 100 * (1 - percent / 100) / first)
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    pairs, more = [], False
    for i in np.flatnonzero(asks):
        mark = np.zeros(len(names), np.int64)
        mark[flat[starts[i] : starts[i] + length[i]]] = 1
        both = np.add.reduceat(mark[flat], starts)
        js = np.flatnonzero((comp != comp[i]) & (np.minimum(n, n[i]) * 100 >= percent * np.maximum(n, n[i])) & (both > 0) & ~asks & (~out | (ids > ids[i])))
        if not len(js):
            continue
        # up to the smaller tail both sets are known in whole: their overlap there estimates that of the sets
        end = np.minimum(tail[i], tail[js])
        union = np.searchsorted(heads[i], end, side="right") + (table[js] <= end[:, None]).sum(1) - both[js]
        whole = (n[js] <= first) & (n[i] <= first)
        for j in js[whole & (100 * both[js] >= percent * union)]:
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                pairs.append((int(ids[i]), int(ids[j]), True))
        may = np.flatnonzero(~whole & (both[js] >= least * union))
        order = np.argsort(-both[js][may] / union[may], kind="stable")[:best]
        pairs += [(int(ids[i]), int(ids[j]), False) for j in js[may[order]]]
        more |= len(order) < len(may)
    return pairs, more


def _search(tiles: DataFrame, percent: int, first: int, best: int | None) -> DataFrame:
    """``_tile`` for each (v, p, q); the rows of a tile come one after the other.  A row (v, p, null) marks a tile that left candidates out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(group)
            ids, n, comp, out, asks = (t.column(i).to_numpy() for i in (3, 4, 5, 6, 7))
            heads = t.column(8).to_pylist()
            found, more = _tile(ids, comp, n, out.astype(bool), asks.astype(bool), [_values(h) for h in heads], percent, first, best)
            rows = [(min(a, b), max(a, b), sure) for a, b, sure in found] + [(t.column(0)[0].as_py(), t.column(1)[0].as_py(), None)] * more
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "sure"])

        group: list[pa.RecordBatch] = []
        held = None
        for batch in batches:
            v, p, q = (batch.column(k).to_numpy() for k in range(3))
            edges = np.r_[0, np.flatnonzero((v[1:] != v[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1, len(v)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if group and held != (v[a], p[a], q[a]):
                    yield done(group)
                    group = []
                held = (v[a], p[a], q[a])
                group.append(batch.slice(a, b - a))
        if group:
            yield done(group)

    order = tiles.select("v", "p", "q", "id", "n", "component", "out", "asks", "head").repartition("v", "p", "q").sortWithinPartitions("v", "p", "q")
    return order.mapInArrow(lean(run), "a long, b long, sure boolean")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, k: int = 64, first: int = 256, block: int = 1024) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Two rows are linked if their sets of ``size``-word shingles have 100 * intersection >= ``percent`` * union;
    component_id is the smallest key reachable over links.  Texts of fewer words are one shingle; texts that
    are null or have no words have an empty set and link with nothing, not even one another.  Rows that repeat
    a key appear as often as they come; texts under one key count as linked if their keys are equal.  Any order of ties gives
    the same result.  Columns other than key and text are ignored, so their names can't clash.
    """
    sketched = cut(sketch_texts(docs, key=key, text=text, size=size, k=k), "sketch")
    some = sketched.filter("n > 0 and id is not null")
    classes = some.groupBy("digest").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes, "classes")

    # df order: the prefix of each sketch, without the values that occur once
    values = classes.select("rep", "n", F.explode("sketch").alias("v"))
    often = cut(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "often")  # a table, so that the join can split frequent values
    common = values.join(often, "v")
    # overlap that similar sets' sketches have at least, five standard deviations below its mean; small sets whole
    p_long = k - math.floor(k * percent / 100 - 5 * math.sqrt(k * percent / 100 * (1 - percent / 100))) + 1
    held = F.least("n", F.lit(k))
    p = F.when(F.col("n") > k, F.lit(p_long)).otherwise(F.ceil(F.lit(1 - (percent / 100) ** 2 + 0.02) * F.col("n")) + 1)
    ranked = (
        common.groupBy("rep")
        .agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
        .withColumn("own", held - F.size("vs"))
        .withColumn("left", p - F.col("own"))
        .filter("left > 0")
        .select("rep", "n", "own", F.explode(F.slice("vs", F.lit(1), F.col("left").cast("int"))).alias("x"))
    )
    postings = cut(ranked.select(F.col("rep").alias("id"), "n", "own", F.col("x.v").alias("v")), "postings")
    members = postings.select("id").distinct()
    sets = cut(_full_sets(docs, members, key=key, text=text, size=size), "sets")

    # each list's members with its pivot
    pivots = postings.groupBy("v").agg(F.min(F.struct("own", "id", "n")).alias("pivot"))
    star = postings.join(pivots, "v").filter("id <> pivot.id")
    near = (F.least("n", "pivot.n") * 100 >= percent * F.greatest("n", "pivot.n")) & (F.col("own") + F.col("pivot.own") < 2 * p_long)
    star = star.filter(near).select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct()
    small = classes.select(F.col("rep"), "sketch")
    sketches = cut(small.join(members, small["rep"] == members["id"], "left_semi"), "sketches")
    both = star.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    # union-sketch estimate: of the k smallest values of the union, the share that both have
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    least = percent / 100 - 4.5 * math.sqrt(percent / 100 * (1 - percent / 100) / k)
    likely = both.filter(shared >= F.lit(least) * F.size(union))
    links = cut(_verify(likely, sets, percent), "links")

    nodes = cut(members, "nodes")
    heads = sets.select("id", F.substring("body", 1, _BYTES * first).alias("head"))
    sign = F.xxhash64("id")
    left = None
    for best in (2, None):
        comp = cut(components(nodes, links), "comp")
        placed = postings.join(comp, "id")
        # a list of two is its pivot and one member, which were compared; lists with the same members are searched once
        lists = placed.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"), F.bit_xor(sign).alias("x"), F.sum(F.shiftright(sign, 32)).alias("s"))
        open_lists = cut(lists.filter("lo < hi and c > 2").groupBy("c", "x", "s").agg(F.min("v").alias("v")).select("v", "c"), "open")
        if left is not None:
            open_lists = open_lists.join(left, "v", "left_semi")
        if open_lists.limit(1).count() == 0:
            break
        placed = cut(placed.join(open_lists, "v"), "placed")
        parts = placed.groupBy("v", "component").agg(F.count("*").alias("held"))
        main = parts.groupBy("v").agg(F.max(F.struct("held", (-F.col("component")).alias("minus"))).alias("m"), F.sum("held").alias("all"))
        main = cut(main.select("v", (-F.col("m.minus")).alias("main"), (F.col("all") - F.col("m.held")).alias("outside")), "main")
        blocks, askers = F.ceil(F.col("c") / F.lit(block)).cast("int"), F.ceil(F.col("outside") / F.lit(block)).cast("int")
        dealt = placed.join(main, "v").withColumn("out", F.col("component") != F.col("main"))
        dealt = dealt.withColumn("own_q", F.pmod(sign, blocks).cast("int")).withColumn("own_p", F.pmod(F.shiftright(sign, 20), askers).cast("int"))
        asked = F.transform(F.sequence(F.lit(0), askers - 1), lambda p: F.struct(p.alias("p"), F.col("own_q").alias("q"), F.lit(False).alias("asks")))
        asking = F.transform(F.sequence(F.lit(0), blocks - 1), lambda q: F.struct(F.col("own_p").alias("p"), q.alias("q"), F.lit(True).alias("asks")))
        dealt = dealt.withColumn("x", F.explode(F.when(F.col("out"), F.concat(asked, asking)).otherwise(asked))).select("v", "x.p", "x.q", "x.asks", "id", "n", "component", "out")
        found = cut(_search(dealt.join(heads, "id"), percent, first, best).distinct(), "found")
        more = found.filter("sure").select("a", "b").unionByName(_verify(found.filter("not sure"), sets, percent))
        links = cut(links.unionByName(more).distinct(), "links")
        left = found.filter("sure is null").select(F.col("a").alias("v")).distinct()
    final = components(nodes, links)

    named = classes.select("digest", F.col("rep").alias("id")).join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = sketched.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
