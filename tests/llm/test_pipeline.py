import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

corpus_pipeline = pytest.importorskip("corpus_pipeline")


BASE = "the men and the women of this town are at work with what they have for that long day in spring".split()
ITEM = "Seven green boats crossed the wide lake before noon and came back full of silver fish for supper"


def corpus():
    text = lambda i, n=60: " ".join(BASE[(i * k) % len(BASE)] + ("" if k % 5 else f"x{i}") for k in range(1, n))
    french = " ".join("le chien et la souris sont allés avec cette chose vers la même école où ils étaient".split() * 4)
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(200 + i, french + " " + " ".join(f"é{i}n{k}" for k in range(20)), "fr", "s0", 1) for i in range(10)]
    rows += [(100, rows[4][1], "en", "s0", 1), (101, "12 !! 34", "en", "s0", 1), (102, None, None, None, None), (103, "", "en", "s1", 0), (106, text(50), None, None, 5)]
    rows += [(104, rows[5][1][:50] + " zz " + ITEM + " yy", "en", "s1", 1), (105, rows[6][1].replace("x6", "q") + ' token = "' + "0f" * 20 + '"', "en", "s2", 1)]
    rows += [(107, text(51) + " pwd hunter2x!", "en", "s1", 1), (None, text(52), "en", "s2", 1), (None, text(53), "en", "s2", 1), (108, rows[7][1] + " end", "en", "s0", 1), (109, ITEM, "en", "s0", 1)]
    return rows


def brute_run(spark, docs, rows):
    """The five stages one after the other, a row at a time; models are those that the stages fit on the same rows."""
    import numpy as np
    from test_dedup import brute_components
    from test_measures import brute_copies, fill

    from fellgrid.llm import langid, secrets

    model = langid.fit(docs)

    def language(text):
        _, p = langid.label_words(model, [(text or "").encode()])
        mean = p.mean(0) if len(p) else np.zeros(len(model.labels))
        return (model.labels[int(mean.argmax())], float(mean.max())) if len(p) else (None, 0.0)

    kept = [(k, t, la or language(t)[0], s, n) for k, t, la, s, n in rows if language(t)[1] >= 0.5]
    roots = brute_components([(i, r[1]) for i, r in enumerate(kept)], 5, 80)
    groups = {}
    for i, r in enumerate(kept):
        groups.setdefault(roots[i], []).append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    plain = lambda t: " ".join(w.strip(".,!?").lower() for w in t.split())
    kept = [r for r in kept if plain(ITEM) not in plain(r[1])]
    field = secrets.fit(spark.createDataFrame(kept, docs.schema))
    clean = []
    for k, t, la, s, n in kept:
        base = secrets.base_spans(t)
        spans = [(a, b) for a, _, b in base] + [(a, b) for a, b in field.spans(t) if not any(a < e and x < b for x, _, e in base)]
        covered = sorted({i for a, b in spans for i in range(a, b)})
        out, last = [], None
        for i, c in enumerate(t):
            if i in set(covered):
                if last is None or i != last + 1 or any(a == i for a, b in spans if not any(x < i < y for x, y in spans)):
                    out.append("<SECRET>")
                last = i
            else:
                out.append(c)
        text = "".join(out)
        clean.append((k, text, la, s, len(text)))
    sizes = Counter()
    for r in clean:
        sizes[r[3]] += len(r[1].split())
    copies = brute_copies([(r[0], r[1], r[3]) for r in clean], fill(sizes, (3, 1, 2), 1.5, 2), sizes)
    return Counter((*r, c) for r in clean for c in range(1, copies[r[0], r[1], r[3]] + 1))


def test_run_matches_brute_force(spark, tmp_path):
    d, rows = str(tmp_path), corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    got = Counter(tuple(r) for r in out.collect())
    assert got == brute_run(spark, spark.read.parquet(f"{d}/documents.parquet"), rows)
    ids = {k[0] for k in got}
    assert not ids & {100, 101, 102, 103, 104, 108, 109} and any("<SECRET>" in k[1] for k in got) and not any("0f0f" in k[1] or "hunter2x" in k[1] for k in got)
    assert {k[2] for k in got} == {"en", "fr"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "mix"]


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    d, rows = str(tmp_path), corpus()
    docs = spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _fellgrid_row string, size int")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0
        out = stage(spark, docs, d)
        assert out.columns[:7] == docs.columns and {r[0] for r in out.select("_fellgrid_row").distinct().collect()} == {"mine"}, name


def test_null_and_repeated_ids(spark, tmp_path):
    from fellgrid.llm import langid

    base = "the men and the women of this town are at work with what they have for that long day in spring".split()
    texts = [" ".join(base[(i * k) % len(base)] + ("" if k % 5 else f"x{i}") for k in range(1, 60)) for i in range(8)]
    item = "Seven green boats crossed the wide lake before noon and came back full of silver fish for supper"
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[2]), (9, texts[3]), (None, texts[0]), (7, item), (None, "so it was " + item)]
    docs = spark.createDataFrame([(k, t, "en", f"s{i % 2}", len(t)) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    kept = sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])], key=str)
    assert [x for x in pairs(corpus_pipeline.near_dedup(spark, docs, d)) if item not in x[1]] == kept
    assert pairs(corpus_pipeline.decontaminate(spark, docs, d)) == sorted([x for x in rows if item not in x[1]], key=str)
    # a source whose rate is a whole number takes each row, and one with a fraction takes some of those without an id
    two = spark.createDataFrame([(None, f"word{i} and more", "a") for i in range(300)] + [(i, "b " * 20, "b") for i in range(300)], "doc_id long, text string, source string")
    taken = corpus_pipeline.mixing.mix_sources(two, weights=(1.0, 9.0), share=0.65).filter("source = 'a'").select("copies", "size", "target").collect()
    assert all(r["copies"] is not None for r in taken) and len({r["copies"] for r in taken}) == 2
    assert abs(sum(r["copies"] * r["size"] for r in taken) - taken[0]["target"]) <= 3
    assert langid.fit(docs.withColumn("doc_id", docs["doc_id"] * None), most_docs=2, rounds=1).labels == ["en"]
