import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fellgrid.llm import secrets


@pytest.fixture(scope="module")
def field():
    return secrets.train(PROSE)


PROSE = [" ".join(random.Random(i).choices("the river bends slowly past old mills and Anna walks home at 7 with 12 friends, reading ( a book ) about light.".split(), k=200)) for i in range(20)]


def planted(seed):
    """Texts made by other rules than those the field is trained on: (text, where its secret is or None)."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    prose = lambda: " ".join(rng.choices(PROSE[rng.randrange(20)].split(), k=rng.randint(3, 12)))
    with_secret = [
        ("export GITLAB_TOKEN_CI=", lambda: "glpat-" + pick(alnum, 20), ""), ("curl -H 'Authorization: Bearer ", lambda: pick(alnum, 36), "' https://api.example.org/v1/items"),
        ("mongodb://root:", lambda: "Wd7" + pick(alnum, 9), "@mongo.example.net:27017/main"), ('{"apiSecretKey": "', lambda: pick(alnum, 32), '", "region": "eu"}'), ("cookie auth_session=", lambda: pick(alnum, 28), "; path=/"),
        ("maps key: ", lambda: "AIza" + pick(alnum + "_-", 35), ""), ("the admin pwd is ", lambda: "Blue" + pick("0123456789", 4) + "!", " for now"), ("id ", lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum, 43), " end"),
        ("credentials:\n  user: anna\n  pass: ", lambda: "k" + pick(alnum, 11) + "#" + pick(alnum, 2), "\n"), ("AWS_SECRET_ACCESS_KEY ", lambda: pick(alnum + "/+", 40), ""),
    ]
    without = [
        lambda: "order 2023-11-04 from anna.mill@post.example.org", lambda: "see https://docs.example.org/guide/first-steps/page-7?lang=en", lambda: f"call +49 30 {rng.randint(100000, 999999)}", lambda: "version 4.11.2-rc1 of libparse",
        lambda: "keys and tokens of the old railway museum", lambda: "the password was changed by Anna", lambda: "a[i] = b[j] + 17;", lambda: "Price: 1,299.00 EUR (incl. 19% VAT)", lambda: "def walk_tree(node, depth=0):", lambda: "ISBN 978-3-16-148410-0", lambda: "WARNING!!! READ THIS NOW!!!",
    ]
    out = []
    for _ in range(300):
        before, after = prose() + rng.choice([" ", "\n", ". "]), rng.choice(["\n", " ", "\n\n"]) + prose()
        if rng.random() < 0.5:
            lead, make, tail = rng.choice(with_secret)
            value = make()
            out.append((before + lead + value + tail + after, (len(before + lead), len(before + lead + value))))
        else:
            out.append((before + rng.choice(without)() + after, None))
    return out


def test_field_finds_secrets_made_by_other_rules(field):
    """Recall (a span that covers nine tenths of the secret) and precision, stated in the README."""
    hit = spans = right = there = 0
    for text, where in planted(5):
        found = field.spans(text)
        there += where is not None
        spans += len(found)
        if where:
            good = [s for s in found if min(s[1], where[1]) - max(s[0], where[0]) >= 0.9 * (where[1] - where[0]) and s[1] - s[0] <= 1.2 * (where[1] - where[0])]
            hit, right = hit + bool(good), right + len(good)
    print(f"recall {hit / there:.3f}, precision {right / spans:.3f}")
    assert hit / there > 0.85 and right / spans > 0.85


def test_field_on_held_out_texts(field):
    lines = secrets._made_up(400, 77)
    hit = sum(len(set(field.spans(t)) & set(s)) for t, s in lines)
    assert hit / sum(len(s) for _, s in lines) > 0.93
    assert sum(len(set(field.spans(t)) - set(s)) for t, s in lines) / len(lines) < 0.05


def test_secrets_span_several_tokens(field):
    web = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    for text, secret in [("pwd hunter2x! it", "hunter2x!"), ("key = Zx9-Qw7.", "Zx9-Qw7"), ("jwt " + web + " end", web), ("pass is Tr0ub4dor and", "Tr0ub4dor"), ("passphrase: correct-horse-battery-staple ok", "correct-horse-battery-staple")]:
        assert [text[a:b] for a, b in field.spans(text)] == [secret]
    doc, scores, _, _ = field.scores([f"é {web} é".encode()], secrets._Tokens(field.own))
    assert field.tags(doc, scores).tolist() == [0, 1, 2, 2, 2, 2, 0]
    for text in ["the key to success is hard work", "token economy: a study", "", " \n", "Köln ist schön, sagt Anna."]:
        assert field.spans(text) == []


def test_training_has_all_tags_and_moves_every_transition(field):
    tokens = [len(secrets.find_tokens([t[a:b].encode()])[1]) for t, spans in secrets._made_up(300, 11) for a, b in spans]
    assert max(tokens) > 3 and sum(n > 1 for n in tokens) > 50
    assert (np.abs(field.transitions) > 1e-3).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.integers(1, 6), min_size=1, max_size=4), st.floats(0.1, 4))
def test_viterbi_equals_enumeration(seed, lengths, scale):
    rng = np.random.default_rng(seed)
    hop = rng.normal(size=(3, 3)) * 2
    hop[0, 2] = -30.0
    doc = np.repeat(np.arange(len(lengths)), lengths)
    scores = rng.normal(size=(len(doc), 3)) * scale + np.array([1.0, 0, 0])
    got = secrets.SecretField([], [], [], hop).tags(doc, scores)
    for d, n in enumerate(lengths):
        s = scores[doc == d]
        value = lambda tags: sum(hop[a, b] + s[i, b] for i, (a, b) in enumerate(zip((0, *tags), tags)))
        best = max(itertools.product(range(3), repeat=n), key=value)
        assert value(tuple(got[doc == d].tolist())) == pytest.approx(value(best))


def test_features_of_batches_do_not_depend_on_the_batch(field):
    texts = [t for t, _ in secrets._made_up(60, 5)] + ["", "a", "é" * 30, "x" * 50_000 + " key=Ab9$Ab9$Ab9"]
    want = [field.spans(t) for t in texts]
    for most in (300_000, 50):
        assert list(field.spans_of([t.encode() for t in texts], secrets._Tokens(field.own, most))) == want


def test_tokens_are_runs_and_single_marks():
    import re

    texts = ["a-b c.d\n=é9 ", "", "  ", "x" * 70_000 + "!y", "\t#\r\nz", "日本 語!"]
    raw, doc, start, length, h, gap = secrets.find_tokens([t.encode() for t in texts])
    got = [(int(d), raw[s : s + n].tobytes().decode()) for d, s, n in zip(doc, start, length)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[A-Za-z0-9+/_\u0080-\U0010ffff-]+|[^\t-\r A-Za-z0-9+/_\u0080-\U0010ffff-]", t)]
    assert gap[:6].tolist()[1:] == [1, 0, 0, 2, 0]
    assert len({(w, int(x)) for (_, w), x in zip(got, h)}) == len({w for _, w in got}) == len(set(h.tolist()))


def test_fit_takes_bounded_samples(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "other"), (None, "x " * 50), (2, None)], "doc_id long, text string")
    assert len(secrets.fit(df, most_docs=2, lines=50, rounds=2).looks) == len(secrets._LOOKS)
    assert len(secrets.fit(df.limit(0), lines=50, rounds=2).looks) == len(secrets._LOOKS)
