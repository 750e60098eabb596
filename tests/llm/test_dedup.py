import random

import numpy as np
import pytest

from fellgrid.llm import embedding, minhash, suffix_dedup


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent):
    sets = [(k, shingles(t, size)) for k, t in rows]
    root = {k: k for k, _ in rows if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if a is not None and b is not None and x and y and 100 * both >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in root}


def near_copies(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    hot = [word() for _ in range(60)]
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([12, 60, 400]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join(hot + [word() for _ in range(rng.randint(5, 60))]) for _ in range(40)]
    rows += [" ".join(word() for _ in range(80)) for _ in range(20)] + rows[:5]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, size, percent):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, size=size, percent=percent).collect()}
    want = brute_components(rows, size, percent)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(dict(rows)[k], size)) and r["kept"] == (want[k] == k) for k, r in got.items())


def test_near_duplicates_small_blocks_and_heads(spark):
    """Groups beyond one block, sets beyond their stored first values."""
    rows = near_copies(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, size=3, percent=85, first=32, block=4).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " end"), (9, "é ü"), (9, "é ü")]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, n long, digest string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, size=3, percent=85).collect())
    assert got[:6] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True)]
    assert [g[2] for g in got[6:]] == [7, 7, 9, 9]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def brute_spans(rows, least):
    from collections import Counter

    words = [(k, (t or "").encode().lower().split()) for k, t in rows]
    seen = Counter(tuple(w[i : i + least]) for _, w in words for i in range(len(w) - least + 1))
    out = set()
    for k, w in words:
        cur = None
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i : i + least])] > 1:
                if cur and i <= cur[1]:
                    cur[1] = i + least
                else:
                    if cur:
                        out.add((k, *cur))
                    cur = [i, i + least]
        if cur:
            out.add((k, *cur))
    return out


def test_repeated_passages_match_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    hot = [[word() for _ in range(n)] for n in (49, 50, 51, 70, 130)]
    rows = []
    for i in range(60):
        parts = [[word() for _ in range(rng.randint(0, 40))]]
        for p in rng.sample(hot, rng.randint(0, 3)):
            parts += [p[: rng.choice([len(p), len(p) // 2, len(p) - 3])] if rng.random() < 0.3 else p, [word() for _ in range(rng.randint(1, 30))]]
        rows.append((i, " ".join(w for part in parts for w in part)))
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (102, None), (103, ""), (104, "few words")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, pos int")
    got = {(r["doc_id"], r["start"], r["stop"]) for r in suffix_dedup.repeated_passages(df).collect()}
    assert got == brute_spans(rows, 50)
    assert suffix_dedup.repeated_passages(df.limit(0)).collect() == []


def decoys(seed):
    """Two texts that share 50 to 72 words around a core, and texts that share more of it on one side but less than 50 words in all."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    noise = lambda n: [word() for _ in range(n)]
    rows = []
    for _ in range(3):
        shared = noise(rng.choice([50, 50, 51, 60, 72]))
        n = len(shared)
        rows += [noise(rng.randint(0, 40)) + shared + noise(rng.randint(0, 40)) for _ in range(2)]
        for _ in range(12):
            before, after = noise(30), noise(30)
            a = rng.randint(0, n - 20)
            b = min(n, a + rng.randint(20, 49))
            part = shared[a:b]
            if rng.random() < 0.5:  # longer to the right than any true match, in what follows one of the two
                source = rows[-1] if rng.random() < 0.5 else rows[0]
                at = rng.randint(0, max(0, len(source) - 49))
                part = source[at : at + 49]
            rows.append(before + part + after)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_repeated_passages_among_decoys(spark, seed):
    rows = decoys(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for near in (4, 1):
        got = {(r["doc_id"], r["start"], r["stop"]) for r in suffix_dedup.repeated_passages(df, near=near).collect()}
        assert got == brute_spans(rows, 50)


def test_repeated_passages_hidden_on_both_sides(spark):
    """Fifty shared words, and decoys that agree with one of the two further to the right or further to the left, none in fifty words."""
    rng = random.Random(4)
    noise = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    shared = noise(50)
    first, second = noise(30) + shared + noise(30), noise(30) + shared + noise(30)
    rows = [first, second]
    for k in range(12):
        of = first if k % 2 else second
        cut = of[37 : 37 + 43 + 6] if k < 6 else of[25 : 25 + 49]
        rows.append(noise(12) + cut + noise(12))
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {(r["doc_id"], r["start"], r["stop"]) for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_spans(rows, 50)
    assert {g[0] for g in got} >= {0, 1}


def test_repeated_passages_of_rows_that_share_a_key(spark):
    rng = random.Random(9)
    noise = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    shared = noise(60)
    texts = [" ".join(shared + noise(5)), " ".join(noise(7) + shared), " ".join(noise(80))]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[0]), (2, texts[2])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["stop"]) for r in suffix_dedup.repeated_passages(df).collect())
    assert got == [(1, 0, 60), (1, 0, 67)]


def brute_vectors(rows, threshold):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links, root = {k: 0 for k, _, _ in rows}, {k: k for k, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, v, l) in enumerate(rows):
        for b, w, m in rows[:i]:
            if l is not None and l == m and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {k: (links[k], find(k)) for k, _, _ in rows}


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 16))
    rows = []
    for i in range(160):
        v = centres[i % 4] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(500 + i, rows[7][1], rows[7][2]) for i in range(5)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] * 16, 1), (604, rows[0][1], None), (605, [], 0), (606, [float("inf")] + [1.0] * 15, 0), (607, [1e-30] * 16, 0), (608, [1e30] * 16, 0), (609, [1e30] * 15 + [9e29], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, digest string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_vectors(df, tile=16).collect()}
    assert got == brute_vectors(rows, 0.93)
    assert embedding.near_vectors(df.limit(0)).collect() == []


def test_tile_bounds_lose_no_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * 10.0 ** rng.integers(-200, 200, size=(200, 1))
    unit = embedding.unit_rows(x)
    c = unit @ unit.T
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if c[i, j] >= 0.8}
    rows, got, opened = embedding.quantise(unit), set(), 0
    every = np.arange(200)
    for i, j, k, m in embedding._pairs(every, every, True, rows, 0.8):
        keep = embedding.exact_links(x, x, k, m, 0.8)
        got |= set(zip(i.tolist(), j.tolist())) | set(zip(k[keep].tolist(), m[keep].tolist()))
        opened += len(k)
    assert got == want and 0 < opened < 0.2 * 200 * 199 / 2
