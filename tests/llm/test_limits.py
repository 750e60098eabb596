"""Memory of Python workers, in small."""

import ctypes
import random

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from fellgrid.llm import common, langid, secrets


def made_batches(count, seed=3):
    """Batches of 2,000 rows and about 4 MB, every fifth word a new one."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    known = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(500)]
    for _ in range(count):
        texts = [" ".join("".join(rng.choices(letters, k=9)) if rng.random() < 0.2 else rng.choice(known) for _ in range(300)) for _ in range(2000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["doc_id", "text"])


def megabytes(name):
    with open("/proc/self/status") as f:
        return next(int(x.split()[1]) for x in f if x.startswith(name)) / 1024


def function_of(monkeypatch, make):
    """The function that an operator gives to mapInArrow."""
    held = []
    with monkeypatch.context() as m:
        m.setattr(type(make[0]), "mapInArrow", lambda self, f, schema: held.append(f))
        make[1](make[0])
    return held[0]


@pytest.mark.parametrize("name", ["secrets", "language"])
def test_workers_stay_small(spark, monkeypatch, name):
    try:
        trim = ctypes.CDLL(None).malloc_trim
        with open("/proc/self/clear_refs", "w") as f:
            f.write("5")
    except (OSError, AttributeError):
        pytest.skip("memory can't be measured here")
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert isinstance(df, DataFrame)
    if name == "secrets":
        field = secrets.train([], lines=100, rounds=3)
        run = function_of(monkeypatch, (df, lambda d: secrets.scan_secrets(d, field, redact="<SECRET>")))
    else:
        model = langid.train([b"the cat and the dog", b"der hund und die katze", b"le chien et la souris", b"el perro y la gata"], ["en", "de", "fr", "es"], rounds=3)
        run = function_of(monkeypatch, (df, lambda d: langid.identify(d, model)))
    batches = list(made_batches(3))
    sum(b.num_rows for b in run(iter(batches[:1])))  # what is imported and made once
    pa.default_memory_pool().release_unused(), trim(0)
    with open("/proc/self/clear_refs", "w") as f:
        f.write("5")
    before = megabytes("VmHWM")
    assert sum(b.num_rows for b in run(iter(batches))) == 6000
    peak, after = megabytes("VmHWM") - before, megabytes("VmRSS") - before
    assert peak < 120 and after < 40, (peak, after)


def test_lean_keeps_batches_and_order():
    batches = [pa.RecordBatch.from_arrays([pa.array([i])], ["i"]) for i in range(5)]
    assert [b.column(0)[0].as_py() for b in common.lean(iter, most=1)(iter(batches))] == list(range(5))
    assert list(common.lean(iter)(iter([]))) == []
