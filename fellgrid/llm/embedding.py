"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

A unit vector x is stored as int8 values q and a step s, x = s q + e; |e| is computed, not estimated.  For two
such vectors  x.y = s t (q.r) + s q.f + e.(t r) + e.f, so  |x.y - s t (q.r)| <= |s q| |f| + |e| |t r| + |e| |f|.
A product of two tiles of int8 values therefore decides most pairs, above the threshold or below; only int8 rows travel for it.  Only pairs
that this bound leaves open are computed again in double precision: the vectors that take part in one are fetched for their tiles.

Only vectors of one label are compared.  Equal vectors form a class and count with their number.  A label is
cut into tiles of bounded size, dealt by the vectors' lean against a fixed axis u: |x.u - y.u| <= |x - y| for unit
vectors, so pairs of tiles whose ranges of lean are further apart than sqrt(2 - 2 threshold) are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

#: Slack for the rounding of float arithmetic in the bounds and in the unit vectors.
_SLACK = 1e-6


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1.  They are first scaled by powers of two, which is exact, so that no square under- or overflows."""
    scaled = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their steps, and the norms of what quantisation leaves out."""
    step = np.abs(unit).max(1) / 127.0
    q = np.rint(unit / step[:, None]).astype(np.int8)
    return q, step, np.linalg.norm(unit - q * step[:, None], axis=1)


def bounds(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) cosine of each pair of quantised rows (q, step, error norm)."""
    (q, s, e), (r, t, f) = left, right
    # int8 products summed in float32 are exact below 2**24, i.e. for up to 1040 dimensions
    exact = np.float32 if q.shape[1] <= 1040 else np.float64
    middle = (q.astype(exact) @ r.astype(exact).T) * s[:, None] * t[None]
    a, b = s * np.sqrt((q.astype(np.float64) ** 2).sum(1)), t * np.sqrt((r.astype(np.float64) ** 2).sum(1))
    slack = a[:, None] * f[None] + e[:, None] * b[None] + e[:, None] * f[None] + _SLACK
    return middle - slack, middle + slack


def exact_links(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each pair of rows x[i], y[j] reaches the threshold, in double precision."""
    ux, uy = unit_rows(x), unit_rows(y)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 65536):
        keep[k : k + 65536] = np.einsum("ij,ij->i", ux[i[k : k + 65536]], uy[j[k : k + 65536]]) >= threshold
    return keep


_BLOCK = 1024


def _pairs(left: np.ndarray, right: np.ndarray, same: bool, rows: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j) of sure links and (i, j) of pairs left open, block by block, as row numbers."""
    for a in range(0, len(left), _BLOCK):
        for b in range(a if same else 0, len(right), _BLOCK):
            p, w = left[a : a + _BLOCK], right[b : b + _BLOCK]
            low, high = bounds(tuple(c[p] for c in rows), tuple(c[w] for c in rows))
            may = high >= threshold
            if same and a == b:
                may = np.triu(may, 1)
            sure = may & (low >= threshold)
            (i, j), (k, m) = np.nonzero(sure), np.nonzero(may & ~sure)
            yield p[i], w[j], p[k], w[m]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The records of each tile meeting, which come one after the other and share their first ``keys`` columns."""
    parts: list[pa.RecordBatch] = []
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(*(batch.column(k).to_pylist() for k in range(keys))))
        edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        for a, b in zip(edges, edges[1:]):
            if parts and held != names[a]:
                yield pa.Table.from_batches(parts)
                parts = []
            held = names[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def _int8_rows(t: pa.Table, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, step, error norm) from three columns of a table."""
    q = np.frombuffer(b"".join(t.column(at).to_pylist()), np.int8).reshape(t.num_rows, -1)
    return q, t.column(at + 1).to_numpy(), t.column(at + 2).to_numpy()


def _doubles(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.concatenate([c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in column.chunks]).reshape(rows, -1)


class _Links:
    """Number of links of each row of a meeting, and the row that each is joined with."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count, self.root = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.weights[j])
        np.add.at(self.count, j, self.weights[i])
        _join(self.root, i, j)

    def result(self, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rep, links, to) of the rows that have any."""
        top = np.array([_root(self.root, k) for k in range(len(rep))], np.int64)
        keep = (self.count > 0) | (top != np.arange(len(rep)))
        return rep[keep], self.count[keep], rep[top[keep]]


def near_vectors(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, tile: int = 2048) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``table``.

    Two vectors are linked if their labels are equal and not null, they have the same number of components,
    and their cosine in double precision is at least ``threshold``.  Vectors that are null, empty, zero, or hold null,
    NaN or infinite components link with nothing: 0 links, their own component.  Repeated rows link with one another as other equal
    vectors do.  Columns other than the three are ignored; an empty table gives an empty result.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    digest = F.sha2(F.to_json(F.struct("label", "v")), 256)
    tagged = cut(rows.select("id", "sound", F.when(F.col("sound"), digest).alias("digest"), "label", "v"), "vectors")
    classes = tagged.filter("sound").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("dims", F.size("v")), "classes")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """int8 rows and the lean of each class, vectors of equal size together."""
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                unit = unit_rows(_doubles(pa.chunked_array([part.column(4)]), part.num_rows))
                q, step, error = quantise(unit)
                lean = unit @ np.where(np.arange(d) % 2 == 0, 1.0, -1.0) / math.sqrt(d)
                columns = [pa.array([r.tobytes() for r in q], pa.binary()), pa.array(step), pa.array(error), pa.array(lean)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), *columns], ["label", "dims", "rep", "m", "q", "step", "error", "lean"])

    packed = cut(classes.select("label", "dims", "rep", "m", "v").mapInArrow(pack, "label string, dims int, rep long, m long, q binary, step double, error double, lean double"), "packed")
    # tiles: each group's classes dealt into about n / tile tiles, by direction
    groups = packed.groupBy("label", "dims").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    cuts = packed.groupBy("label", "dims").agg(F.percentile_approx("lean", [i / 256 for i in range(257)], 2000).alias("marks"))
    placed = packed.join(groups.join(cuts, ["label", "dims"]), ["label", "dims"])
    # position among 257 quantile marks, with a hash to spread equal leans
    at = F.size(F.filter("marks", lambda m: m <= F.col("lean"))) - 1 + F.pmod(F.xxhash64("rep"), F.lit(1000)) / 1000.0
    number = F.least(F.col("tiles") - 1, F.greatest(F.lit(0), F.floor(at * F.col("tiles") / 256))).cast("int")
    dealt = placed.select("label", "dims", number.alias("t"), "lean", "rep", "m", "q", "step", "error")
    ranges = dealt.groupBy("label", "dims", "t").agg(F.min("lean").alias("a"), F.max("lean").alias("z"))
    reach = math.sqrt(2 - 2 * threshold) + _SLACK
    other = ranges.select("label", "dims", F.col("t").alias("o"), F.col("a").alias("oa"), F.col("z").alias("oz"))
    near = ranges.join(other, ["label", "dims"]).filter((F.col("oa") <= F.col("z") + reach) & (F.col("oz") >= F.col("a") - reach))
    near = near.groupBy("label", "dims", "t").agg(F.collect_list("o").alias("os"))
    # a tile meets itself and the tiles near it: (lo, hi); rows go to each meeting they take part in
    meet = F.transform("os", lambda o: F.struct(F.least(o, F.col("t")).alias("lo"), F.greatest(o, F.col("t")).alias("hi")))
    rows_of = ["t", "rep", "m", "q", "step", "error"]
    meetings = dealt.join(near, ["label", "dims", "t"]).select("label", "dims", F.explode(meet).alias("p"), *rows_of).select("label", "dims", "p.lo", "p.hi", *rows_of)
    by = ["label", "dims", "lo", "hi"]

    def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
        lo, hi, side = t.column(2)[0].as_py(), t.column(3)[0].as_py(), t.column(4).to_numpy()
        return np.flatnonzero(side == lo), np.flatnonzero(side == hi), lo == hi

    names = [*by, "t", "rep", "links", "to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sure links of each meeting; and its rows that take part in open pairs, links null."""
        for t in _groups(batches, 4):
            left, right, same = sides(t)
            rep, links, rows = t.column(5).to_numpy(), _Links(t.column(6).to_numpy()), _int8_rows(t, 7)
            asked = np.zeros(len(rep), bool)
            for i, j, k, m in _pairs(left, right, same, rows, threshold):
                links.add(i, j)
                asked[k] = asked[m] = True
            found = links.result(rep)
            again = np.flatnonzero(asked)
            n = len(found[0]) + len(again)
            key = [pa.array([t.column(c)[0].as_py()] * n, t.schema.field(c).type) for c in range(4)]
            side = np.r_[np.zeros(len(found[0]), np.int64), t.column(4).to_numpy()[again]]
            none = pa.nulls(len(again), pa.int64())
            values = [pa.array(side, pa.int32()), pa.array(np.r_[found[0], rep[again]]), pa.concat_arrays([pa.array(found[1]), none]), pa.concat_arrays([pa.array(found[2]), none])]
            yield pa.RecordBatch.from_arrays([*key, *values], names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links among the open pairs of each meeting, in double precision."""
        for t in _groups(batches, 4):
            left, right, same = sides(t)
            rep, links, rows, x = t.column(5).to_numpy(), _Links(t.column(6).to_numpy()), _int8_rows(t, 7), _doubles(t.column(10), t.num_rows)
            for _, _, k, m in _pairs(left, right, same, rows, threshold):
                keep = exact_links(x, x, k, m, threshold)
                links.add(k[keep], m[keep])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in links.result(rep)], ["rep", "links", "to"])

    looked = meetings.repartition(*by).sortWithinPartitions(*by, "t").mapInArrow(run, "label string, dims int, lo int, hi int, t int, rep long, links long, to long")
    looked = cut(looked, "looked")
    again = looked.filter("links is null").select(*by, "t", "rep").join(packed.select("rep", "m", "q", "step", "error"), "rep").join(classes.select("rep", "v"), "rep")
    open_rows = again.select(*by, *rows_of, "v").repartition(*by).sortWithinPartitions(*by, "t")
    found = cut(looked.filter("links is not null").select("rep", "links", "to").unionByName(open_rows.mapInArrow(settle, "rep long, links long, to long")), "found")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    nodes = classes.select(F.col("rep").alias("id"))
    joined = components(nodes, found.filter("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "rep")
    whole = classes.select("digest", "rep", "m").join(degree, "rep", "left").join(joined, "rep").select("digest", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component")
    out = tagged.select("id", "digest").join(whole, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _root(root: np.ndarray, k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return int(k)


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of linked rows, the smaller row number as root; whole arrays at a time."""
    while len(i):
        a, b = root[i], root[j]
        while True:  # to the roots
            up_a, up_b = root[a], root[b]
            if (up_a == a).all() and (up_b == b).all():
                break
            a, b = up_a, up_b
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
