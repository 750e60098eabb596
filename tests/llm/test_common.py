import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fellgrid.llm import common, langid


def test_words_follow_the_contract():
    import re

    text = "A\x0bb\x0c c\td\ne\rf é g"
    assert [w.decode() for w in text.encode().split()] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 10, None, "", "b" * 50, "c"])], ["id", "text"])
    parts = list(common.slices([batch], "text", 20))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(5)) and len(parts) > 1


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(1, 2), (2, 3), (5, 6), (6, 1)], [(i, i + 1) for i in range(1, 30)], [(1, i) for i in range(2, 20)]])
def test_components(spark, edges):
    nodes = sorted({x for e in edges for x in e} | {1, 100})
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    n = spark.createDataFrame([(x,) for x in nodes], "id long")
    e = spark.createDataFrame(edges, "a long, b long")
    assert {r["id"]: r["component"] for r in common.components(n, e).collect()} == root


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=4), st.integers(2, 3), st.integers(0, 1000), st.integers(1, 5))
def test_forward_backward_is_exact(lengths, labels, seed, width):
    rng = np.random.default_rng(seed)
    total = sum(lengths)
    scores, hops = rng.normal(size=(total, labels)) * 2, rng.normal(size=(labels, labels))
    starts = np.zeros(total, bool)
    starts[np.cumsum([0, *lengths[:-1]])] = True
    p, joint = langid.forward_backward(scores, starts, hops, width=width, pairs=True)
    want, pairs, at = np.zeros_like(scores), np.zeros((labels, labels)), 0
    for n in lengths:
        weights = {y: np.exp(sum(scores[at + i, y[i]] for i in range(n)) + sum(hops[y[i - 1], y[i]] for i in range(1, n))) for y in itertools.product(range(labels), repeat=n)}
        z = sum(weights.values())
        for y, w in weights.items():
            for i in range(n):
                want[at + i, y[i]] += w / z
            for i in range(1, n):
                pairs[y[i - 1], y[i]] += w / z
        at += n
    assert np.allclose(p, want) and np.allclose(joint, pairs)
    assert np.allclose(langid.forward_backward(scores, starts, hops, width=width), want)
