import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from fellgrid.llm import mixing, suffix_tree, token_counts


def fill(sizes, weights, share, cap):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while True:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    total = sum(w[x] for x in free)
    return target | {s: left * w[s] / total for s in free}


def brute_copies(rows, want, sizes, stratum=100_000):
    """Copies of distinct (doc_id, text, source), drawn one source after the other."""
    unit = lambda x: int(hashlib.md5(("mix:" + x).encode()).hexdigest()[:8], 16) / 2**32
    out, groups = {}, {}
    for k, t, s in rows:
        known = str(k) if k is not None else "text:" + (t or "")
        groups.setdefault(s, []).append((len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(("mix:" + known).encode()).hexdigest(), hashlib.md5((t or "").encode()).hexdigest(), unit(known), (k, t, s)))
    for s, members in groups.items():
        rate = want[s] / sizes[s] if sizes[s] else 0.0
        parts = {}
        for m in members:
            parts.setdefault(math.floor(m[3] * math.ceil(len(members) / stratum)), []).append(m)
        for part, held in parts.items():
            start, f = unit(f"start:{'true' if s is None else 'false'}:{s or ''}:{part}"), rate - math.floor(rate)
            for i, m in enumerate(sorted(held)):
                out[m[4]] = math.floor(rate) + math.floor(start + (i + 1) * f) - math.floor(start + i * f)
    return out


def test_mix_draws_with_the_fraction_as_probability(spark):
    """Over many seeds each document gets its extra copy as often as the fraction says; strata, ties, clashing names and missing keys."""
    rows = [(None if i % 5 == 0 else i // 2, "w " * (i % 7), "ab"[i % 3 == 0], i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _source long").repartition(1)
    total, n = Counter(), 40
    for k in range(n):
        got = mixing.mix_sources(df, weights=(1.0, 9.0), share=0.65, seed=f"s{k}:", stratum=13).select("_source", "copies", "target", "source_size").collect()
        assert len(got) == 60
        for r in got:
            total[r["_source"]] += r["copies"] - r["target"] / r["source_size"]
    assert all(abs(v) < 0.45 * n for v in total.values()) and abs(sum(total.values())) < 0.05 * n * 60


def test_mix_targets_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" * int(n) for n in [1] * int(rng.integers(0, 40))), s) for i, s in enumerate(rng.choice(["src0"] * 5 + ["b", "é", "zz", "a"], 400).tolist())]
    rows += [(1000, None, "b"), (1001, "", None), (1002, "x y", None), (1003, " ", "empty")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size long")
    got = mixing.mix_sources(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(sizes, (3, 1, 2), 1.5, 2)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-9)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate) <= r["copies"] <= math.ceil(rate) and r["copies"] * r["size"] <= 2 * r["size"]
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in mixing.mix_sources(df.repartition(3)).collect()}
    for name in sizes:  # within one document of the target
        taken = sum(r["copies"] * r["size"] for r in got if r["source"] == name)
        assert abs(taken - want[name]) <= max(r["size"] for r in got if r["source"] == name)
    plain = {(r["doc_id"], r["text"], r["source"]): r for r in got}
    assert {k: r["copies"] for k, r in plain.items()} == brute_copies(list(plain), want, sizes)
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_token_counts_round_trip(spark, tmp_path):
    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "one", "é" * 300, "a b c " * 2000, "<|endoftext|>", "\n\n", "one"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for block in (7, 1 << 16):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, block=block).collect()}
        assert got == {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1, 2, 3, 5, 1000])
def test_separator_scan_of_files(spark, tmp_path, block):
    end = 9
    docs = {"a.bin": [[1, 2], [], [3], [4] * 11], "b.bin": [[]], "c.bin": []}
    loose = [5, 6]
    for name, parts in docs.items():
        ids = [x for p in parts for x in [*p, end]] + (loose if name == "a.bin" else [])
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    got = sorted((r["path"].rsplit("/")[-1], r["ordinal"], r["n_tokens"], r["ended"]) for r in token_counts.count_files(spark, str(tmp_path), end=end, block=block).collect())
    assert got == [("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 1, True), ("a.bin", 3, 11, True), ("a.bin", 4, 2, False), ("b.bin", 0, 0, True)]


def test_large_files_in_ranges(spark, tmp_path):
    """Separators at odd places are none; ranges smaller than documents and files give the same as whole files."""
    rng = np.random.default_rng(4)
    end = 50256
    for name, n in (("a.bin", 400), ("b.bin", 1), ("c.bin", 90)):
        ids = rng.choice([end, end, 0x50C4, 0xC4C4, 0x5050, 7, 0x50, 0xC4, 0x0A0D], n).astype("<u2")
        (tmp_path / name).write_bytes(ids.tobytes() + (b"x" if name == "c.bin" else b""))
    (tmp_path / "d.bin").write_bytes(np.array([5] * 50, "<u2").tobytes())
    rows = lambda df: sorted((r["path"].rsplit("/")[-1], r["ordinal"], r["n_tokens"], r["ended"]) for r in df.collect())
    want = rows(token_counts.count_files(spark, str(tmp_path), end=end))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("64", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert rows(token_counts.count_files(spark, str(tmp_path), end=end, largest=10)) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    with pytest.raises(ValueError):
        token_counts.count_large_files(spark, [str(tmp_path / "a.bin")], end=0x0A0A)
    with pytest.raises(ValueError):
        token_counts.tokenize(spark.createDataFrame([(1, "a")], "doc_id long, text string"), width=1)


def brute_tree(texts, depth, fewest, gain, ratio):
    """log10 probability of a text by a suffix tree made of dictionaries, one context after the other."""
    symbols = lambda t: [max(b, 1) for b in b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n"]
    after = {}
    for t in texts:
        s = symbols(t)
        for i, x in enumerate(s):
            for d in range(min(i, depth) + 1):
                after.setdefault(tuple(s[i - d : i]), Counter())[x] += 1
    first = after.get((), Counter())
    kinds = max(len(first), 1)
    cache = {}

    def probability(context, x):
        if not context:
            return (first[x] + kinds / 255) / (sum(first.values()) + kinds)
        if (context, x) not in cache:
            seen = after.get(context, Counter())
            n = sum(seen.values())
            smooth = lambda y: (seen[y] + len(seen) * probability(context[1:], y)) / (n + len(seen))
            keep = n >= fewest and sum(c * math.log(c / n / probability(context[1:], y)) for y, c in seen.items()) >= gain
            keep = keep and max(smooth(y) / probability(context[1:], y) for y in seen) >= ratio
            cache[context, x] = smooth(x) if keep else probability(context[1:], x)
        return cache[context, x]

    def score(t):
        s = symbols(t)
        return sum(math.log10(probability(tuple(s[max(0, i - depth) : i]), x)) for i, x in enumerate(s))

    return score


def test_base_scores_and_tree(spark):
    rng = np.random.default_rng(0)
    parts = ["ab", "cd", "efg", "h"]
    texts = [" ".join("".join(rng.choice(parts, 3)) for _ in range(20)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "Zebra AB\0 é"), (902, "Zebra AB\0 é"), (None, "ab cd")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int")
    learn = docs["doc_id"] % 2 == 0
    for head, options in ((1 << 16, {}), (3, {"depth": 3, "part_bytes": 1000, "gain": 1.0})):
        got = suffix_tree.score_texts(docs, learn, head=head, **options).collect()
        tokens = lambda t: [*(t or "").encode().lower().split(), None]
        taught = [t for k, t in rows if k is not None and k % 2 == 0]
        c = Counter(w for t in taught for w in tokens(t))
        n, v = sum(c.values()), len(c)
        text = dict(rows)
        score = brute_tree(taught, options.get("depth", 6), 4, options.get("gain", 4.0), 1.2)
        assert len(got) == len(rows)
        for r in got:
            w = tokens(text[r["doc_id"]])
            assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
            assert math.isclose(r["score"], score(text[r["doc_id"]]), rel_tol=1e-4)
    assert suffix_tree.score_texts(docs.limit(0), learn).collect() == []
    none = suffix_tree.score_texts(docs, learn & (docs["doc_id"] < 0)).collect()
    assert all(math.isclose(r["score"], -math.log10(255) * sum(len(w) + 1 for w in [*(text[r["doc_id"]] or "").encode().lower().split(), b""]), rel_tol=1e-4) for r in none)


def test_what_the_tree_holds_grows_with_the_corpus():
    """Ten times the text retains many more contexts, and the distributions of every context sum to one."""
    rng = np.random.default_rng(3)
    syllables = ["".join(rng.choice(list("abcdefghij"), 3)) for _ in range(60)]
    text = lambda n: " ".join("".join(rng.choice(syllables, 2)) for _ in range(n)).encode()
    kept = []
    for n in (300, 3000):
        symbols, lengths, _ = suffix_tree._stream([text(n)])
        codes, counts = np.unique(suffix_tree.grams_of(symbols, lengths, 7), return_counts=True)
        low = suffix_tree.low_tree(*np.unique(codes & np.uint64(0xFFFFFF), return_counts=True), suffix_tree.Rules())
        assert np.allclose(low[1][:, 1:].sum(1), 1.0)
        logs = suffix_tree.log_probabilities(codes, counts.astype(float), low, 6, suffix_tree.Rules())
        short = suffix_tree.log_probabilities(codes, counts.astype(float), low, 3, suffix_tree.Rules())
        kept.append(int((np.abs(logs - short) > 1e-6).sum()))
    assert kept[1] > 3 * kept[0]


def test_lookup():
    from fellgrid.llm.common import Lookup

    keys = np.random.default_rng(1).integers(1, 1 << 62, 5000).astype(np.uint64)
    table = Lookup(np.r_[keys, keys[:10]], np.r_[np.arange(5000), np.arange(10)].astype(np.float32))
    assert (table.of(keys[::-1]) == np.arange(5000)[::-1]).all()
    with pytest.raises(RuntimeError):
        table.of(np.array([1 << 63], np.uint64))
