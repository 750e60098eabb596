import hashlib
import re

import pytest

from fellgrid.llm import decontam, langid, secrets, urls

ENGLISH = "the cat and the dog went with this thing to that other shore for what they had there".split()
GERMAN = "der hund und die katze gingen mit dem anderen nach dort weil sie nicht schön genug waren".split()
FRENCH = "le chien et la souris sont allés avec cette chose vers la même école où ils étaient".split()


def sentences(words, n, seed):
    import random

    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(30)) for _ in range(n)]


def test_language_id(spark):
    rows = [(i, t, lang) for lang, words in (("en", ENGLISH), ("de", GERMAN), ("fr", FRENCH)) for i, t in enumerate(sentences(words, 40, ord(lang[0])))]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train, rounds=20)
    assert model.labels == ["de", "en", "fr"]
    odd = [(1, None), (2, ""), (3, "12 34 !!"), (4, " ".join(ENGLISH)), (5, " ".join(GERMAN).upper()), (6, "Le chien est à l'école"), (4, " ".join(ENGLISH))]
    df = spark.createDataFrame([(k, t, "q") for k, t in odd], "doc_id long, text string, score string")
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect())
    assert [g[1] for g in got] == ["und", "und", "und", "en", "en", "de", "fr"]
    assert all(0 <= g[2] <= 1 for g in got) and got[0][2] == 0.0
    assert langid.identify(df.limit(0), model).collect() == []
    # words of a mixed text are labelled one by one
    doc, p = langid.label_words(model, [(" ".join(ENGLISH[:12]) + " " + " ".join(GERMAN[:12])).encode()])
    assert (p[:8].argmax(1) == 1).all() and (p[-8:].argmax(1) == 0).all()


def test_language_id_reads_all_of_long_runs():
    ends, middle = "".join(ENGLISH).encode(), "".join(GERMAN * 20).encode()
    run = ends + middle + ends
    pieces = langid.words_of(b"a " + run)
    assert pieces[0] == b"a" and all(len(p) <= 48 and p.decode() for p in pieces)
    assert {run[i : i + 3] for i in range(len(run) - 2)} == {p[i : i + 3] for p in pieces[1:] for i in range(len(p) - 2)}
    assert len(set(langid.features([run], 1 << 30)[1])) > len(set(langid.features([ends[:24] + ends[-24:]], 1 << 30)[1])) + 20
    rows = [(t, lang) for lang, words in (("en", ENGLISH), ("de", GERMAN)) for t in sentences(words, 40, len(lang))]
    model = langid.train([t.encode() for t, _ in rows] + [t.replace(" ", "").encode() for t, _ in rows], [lang for _, lang in rows] * 2, rounds=20)
    doc, p = langid.label_words(model, [run])
    assert len(p) > 10 and model.labels[p.mean(0).argmax()] == "de"


def test_language_id_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty)
    df = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert [tuple(r) for r in langid.identify(df, model).collect()] == [(1, "word", "und", 0.0)]


def brute_base(text):
    t = text or ""
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    spans.sort()
    return spans, hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


TEXTS = [
    None, "", "plain words", "password=abcde", "password=abcdef", "PassWord' = 'x1/y2+z3", "é token: \"" + "0a" * 20 + "\" é", "AKIA" + "B" * 15, "x AKIA" + "B" * 16, "f" * 23, "é" + "f" * 24 + "g",
    "secret=token=abcdef", "api_key:abcdefapikey=zzzzzz", "ſecret=abcdefg", "toKen=abcdefg", "a" * 50_000 + " key " + "9f" * 16,
]


def test_secret_base_spans(spark):
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_hex int")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df, secrets.train([], lines=400, rounds=30)).collect()}
    for i, t in enumerate(TEXTS):
        spans, digest = brute_base(t)
        assert got[i]["base_sha256"] == digest
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert len([s for s in got[i]["spans"].split(",") if s]) == len(spans) + got[i]["n_crf"]
    assert secrets.scan_secrets(df.limit(0), None).collect() == []


def test_secret_redaction(spark):
    df = spark.createDataFrame([(1, "a password=abcdef b", 1), (2, None, 1), (3, "clean", 1)], "doc_id long, text string, x int")
    assert [tuple(r) for r in secrets.scan_secrets(df, None, redact="<S>").orderBy("doc_id").collect()] == [(1, "a <S> b", 1), (2, None, 1), (3, "clean", 1)]


ITEM = "A farmer named Anna has 12 apples and buys 7 more apples at the market near London. How many apples does Anna have today?"


def test_decontamination(spark):
    other = ITEM.replace("Anna", "Bella").replace("12", "31").replace("7", "9").replace("London", "Paris")
    mixed = ITEM.replace("Anna", "Bella", 1)  # one name stands for two
    docs = [(1, ITEM), (2, "Before it. " + ITEM.lower().replace("anna", "Anna").replace("london", "London") + " after"), (3, other), (4, mixed), (5, "nothing of it"), (6, None), (7, ""), (8, ITEM[:40]), (9, ITEM), (9, ITEM)]
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "two words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.find_leaks(d.drop("item_id"), b).collect()}
    assert got == {(1, 10): True, (2, 10): True, (3, 10): False, (9, 10): True}
    assert decontam.find_leaks(d.limit(0), b).collect() == [] and decontam.find_leaks(d, b.limit(0)).collect() == []


def test_decontamination_short_items(spark):
    d = spark.createDataFrame([(1, "so it has two words in it"), (2, "two other words")], "doc_id long, text string")
    b = spark.createDataFrame([(13, "two words")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(d, b).collect()] == [(1, 13)]


def test_decontamination_whatever_stands_before(spark):
    tom = "Tom has 3 red pens. Tom gives 2 pens to a friend. How many pens remain?"
    france, wide = "What is the capital of France?", "Anna likes wide green boats very much"
    docs = [(1, "Quiz question\n" + france), (2, "Quiz question " + france + " Answer it"), (3, "a quiz, " + france.lower().replace("france", "France")), (4, tom.replace("Tom", "Max").replace("3", "5"))]
    docs += [(5, "see heading\n" + tom), (6, "we say " + wide), (7, "in 3 People walk to the large town"), (8, "Tom has 3 red pens. Max gives 2 pens to a friend. How many pens remain?"), (9, "see - " + wide.replace("Anna", "Bella"))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(10, france), (11, tom), (12, wide), (13, "People walk to the large town")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.find_leaks(d, b).collect()}
    assert got == {(1, 10): True, (2, 10): True, (3, 10): True, (4, 11): False, (5, 11): True, (6, 12): True, (7, 13): True, (9, 12): False}


def test_decontamination_dense_items(spark):
    sums, dates, dense = "What is 15 + 27 - 8 × 3?", "1914 1918 1939 1945 1989 2001 2020", "Of 3 boxes with 12 pens 7 are red, 9 7 5 3 8"
    docs = [(1, "see " + sums + " now"), (2, "see " + sums.replace("27", "28")), (3, "years " + dates + " end"), (4, "years " + dates.replace("1945", "1946")), (5, dense), (6, dense.replace("12", "40")), (7, "12 of 3 and Bern"), (8, "we saw Bern, Rome, Paris, Oslo, Wien, Riga and more")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(10, sums), (11, dates), (12, dense), (13, "Bern, Rome, Paris, Oslo, Wien, Riga")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.find_leaks(d, b).collect()}
    assert got == {(1, 10): True, (3, 11): True, (5, 12): True, (6, 12): False, (8, 13): True}


def test_decontamination_finds_renamed_items(spark):
    """Items of one to four sentences with names in all places, renamed and with other numbers by rule; unrelated texts of the same names stay."""
    import random

    rng = random.Random(8)
    nouns = "apples boats chairs drums eggs forks gates hats irons jars kites lamps maps nets oars pens quilts ropes shoes trays".split()
    verbs = "buys sells counts paints carries borrows washes hides finds packs drops stacks".split()
    names = ["Anna", "Bella", "New York", "Los Angeles", "McLean", "USA", "Rio de Janeiro", "O'Neil", "Lee", "DeWitt", "UK", "Karl", "San Jose", "Maria Lopez", "van Dyke", "Tom"]
    forms = ["{0} {v} {n} {o} near {1} before noon while the rain falls.", "Then {0} {v} {n} more {o} and leaves them with {1} for a week.", "In {1} the people of {0} have {n} kg of {o} left over today.", "How many {o} does {0} have in all after that?"]
    items, docs, planted = [], [], {}
    for i in range(40):
        picked = rng.sample(range(4), rng.randint(2, 4))
        words = [(rng.choice(verbs), rng.choice(nouns)) for _ in picked]
        make = lambda a, b, m: " ".join(forms[f].format(a, b, v=v, o=o, n=m + k) for k, (f, (v, o)) in enumerate(zip(picked, words)))  # noqa: E731, B023
        a, b, c, d = rng.sample([n for n in names if n not in ("Rio de Janeiro", "van Dyke")], 4)
        items.append((i, make(a, b, rng.randint(2, 40))))
        docs.append((i, rng.choice(["Quiz time\n", "so it goes. ", "we ask this: "]) + make(c, d, rng.randint(50, 90)) + " the end"))
        planted[i] = i
    docs += [(100 + i, " ".join(rng.choice(names) + " " + rng.choice(verbs) + " " + str(rng.randint(2, 40)) + " " + rng.choice(nouns) + " of the old house." for _ in range(4))) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(d, b).collect()}
    recall = sum((k, v) in got for k, v in planted.items()) / len(planted)
    print(f"recall {recall:.3f}")
    assert recall >= 0.8 and not any(k >= 100 for k, _ in got)


def test_decontamination_names_of_several_words(spark):
    item = "A train leaves London at 9 and reaches Paris at noon, so how long does the trip from London take?"
    two = item.replace("London", "New York").replace("Paris", "Los Angeles")
    odd = item.replace("London", "McLean").replace("Paris", "USA")
    wrong = item.replace("London", "New York", 1).replace("Paris", "Los Angeles")  # New York and London for one name
    lists = "we saw Rome, Oslo, Bern and a train"
    docs = [(1, two), (2, odd), (3, wrong), (4, lists), (5, item.upper())]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(10, item)], "item_id long, text string")
    assert {r["doc_id"]: r["exact"] for r in decontam.find_leaks(d, b).collect() if r["doc_id"] != 5} == {1: False, 2: False}


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/", "block"), ("net", "/", "block")]
URLS = [
    None, "", "no scheme", "http://net", "http://net/", "HTTP://X.Example.NET/en/1?q=/de/#x", "https://example.net/de/", "https://a.example.net/en/2", "https://b.a.example.net/", "https://notexample.net/en/",
    "x://example.com/de/y#z", "x://example.com?/de/", "x://www.example.com/de", "ftp://sub.org/fr/", "ftp://org/fr", "a://b://net/", "x:///path", "http://example.net./en/", "http://é.example.com/de/é",
]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.mark.parametrize("parts", [1, 7])
def test_url_rules(spark, parts):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, rules, parts=parts).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS)}
    assert urls.judge_urls(df.limit(0), rules).collect() == []
    assert {r["verdict"] for r in urls.judge_urls(df, rules.limit(0)).collect()} == {"allow"}

