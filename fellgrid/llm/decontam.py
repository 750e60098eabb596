"""Benchmark decontamination by canonical templates.

A text becomes a sequence of template words: numbers turn into ``<num>``, a unit after a number into
``<unit>``, a name into ``<name>``; the others are lower-cased and lose the punctuation around
them.  Names are capitalised words, also with capitals inside (McLean), and short words of capitals alone (USA); names that follow one
another without punctuation are one (New York), its value all its words; a capitalised article before one inside a sentence belongs to it (Los Angeles).  A capitalised word that begins a sentence or a line, and a
word of capitals, may be a name or not: windows are made with
both readings, in texts and items, so that a passage meets its copy whatever stands before it; where a name follows the first word of
a sentence, there are windows with both joined, too, and items have a second variant with all such words joined.  An item's first word is also read as a unit if it can be one.  Question words, articles and the like are no names anywhere.  Windows of template words are hash-joined with those of the benchmark items, so a
question with other numbers or names still meets its item.  Along one alignment the slots must agree: equal
values of the item must stand for equal values in the document, else it isn't the same question re-parameterised.

Windows with fewer than two literal words in every reading say too little as templates.  They meet by their words as they
are, slot values included, so that lists of numbers, dates or names are found as copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, cut, lean, mix, slices

#: Spelled-out numbers and units, in the forms that texts use.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours minutes seconds days weeks months years km/h mph % percent usd eur dollars euros cents c f k w kw v a hz mb gb tb meters metres kilometers kilometres grams kilograms litres liters miles feet inches degrees points people".split()
#: Words that are capitalised at the beginning of a sentence but are no names.
STARTERS = (
    "what which who whom whose when where why how if the an this that these those there it he she they we you in on at of for from by to with and or but so then is are was were do does did can could will would should has have had let find "
    "was welche welcher welches wer wem wen wann wo warum wie wenn der die das ein eine einer es er sie wir ihr in im auf am an von aus bei mit und oder aber so dann ist sind war waren hat haben kann wird "
    "que quel quelle quels quelles qui quand où pourquoi comment combien si le la les un une des il elle ils elles nous vous dans en sur de du au aux par pour avec et ou mais alors est sont était a ont "
    "qué cuál cuáles quién cuándo dónde cómo cuánto cuántos cuántas el los las una unos unas ella ellos es son era fue ha han del al con por para y o pero"
).split()

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?")
_GLUED = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([a-z%/]+)")
_EDGE = re.compile(r"^[^\w$€£+%-]+|[^\w%]+$")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLAIN, _NUM, _NAME, _CAPITALS, _STARTER = 0, 1, 2, 3, 4
_UNITS, _NUMBER_WORDS, _STARTERS, _STOPS = set(UNITS), set(NUMBER_WORDS), set(STARTERS), set(".!?:\x1e")
_LINE = b" \x1e "  # stands for a line break: a word of punctuation alone that ends a sentence


class Template(dict):
    """word -> number of its entry; entries hold hash, kind (plain, number, name, short word of capitals), unit, sentence end and punctuation after it.

    Words that weren't met before wait in ``new`` until ``learn`` makes their entries, all at once.
    """

    def __init__(self, most: int = 150_000):
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.hash, self.kind, self.value = np.zeros(0, np.uint64), np.zeros(0, np.int8), []
        self.unit, self.stop, self.open = (np.zeros(0, bool) for _ in range(3))

    def __missing__(self, raw: bytes) -> int:
        n = self[raw] = len(self)
        self.new.append(raw)
        return n

    def learn(self) -> None:
        """Entries of the new words."""
        words = b"\n".join(self.new).decode("utf-8", "replace").split("\n")
        # what is letters alone but for marks after it has nothing else at its edges and is no number in digits
        bare = [w.rstrip(".,;:!?") for w in words]
        odd = [i for i, b in enumerate(bare) if not b.isalpha()]
        for i in odd:
            bare[i] = _EDGE.sub("", words[i])
        low = [b.lower() for b in bare]
        kind = np.full(len(words), _PLAIN, np.int8)
        for i, b in enumerate(bare):
            if b[:1].isupper() and len(b) > 1:
                if low[i] in _STARTERS:
                    kind[i] = _STARTER
                elif b[-1].islower():
                    kind[i] = _NAME
                elif len(b) <= 5 and b.isupper() and b.isalpha():
                    kind[i] = _CAPITALS
        kind[[i for i, x in enumerate(low) if x in _NUMBER_WORDS]] = _NUM
        for i in odd:
            glued = _GLUED.fullmatch(low[i])
            if _NUMBER.fullmatch(bare[i]) or (glued and glued[2] in _UNITS):
                kind[i] = _NUM
        # a word of punctuation alone is no template word: hash 0
        hashes = [xxhash.xxh3_64_intdigest(x) | 1 if x else 0 for x in "\n".join(low).encode().split(b"\n")]
        self.hash, self.kind = np.r_[self.hash, np.array(hashes, np.uint64)], np.r_[self.kind, kind]
        self.unit = np.r_[self.unit, [x in _UNITS for x in low]]
        self.stop = np.r_[self.stop, [w[-1] in _STOPS for w in words]]
        self.open = np.r_[self.open, [w.endswith(b) for w, b in zip(words, bare)]]
        self.value += low
        self.new = []

    def of(self, texts: list[bytes]) -> tuple[Words, Words | None]:
        """The template words of the texts; and with names joined to the first words of sentences, if there are any.

        A name that begins a sentence or a line may be literal instead, as may a word of capitals; a text's first word may be a unit.
        """
        if len(self) > self.most:
            self.reset()
        split = [t.replace(b"\r", b"\n").replace(b"\n", _LINE).split() for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        entry = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, len(doc))
        if self.new:
            self.learn()
        stop = self.stop[entry]
        begins = np.r_[True, stop[:-1] | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
        real = self.hash[entry] != 0
        # a word of punctuation alone doesn't take the beginning from the word after it
        behind = np.flatnonzero(real)
        runs = np.maximum.reduceat(begins, np.r_[0, behind[:-1] + 1]) if len(behind) else begins[:0]
        apart = np.r_[True, np.diff(behind) > 1] if len(behind) else real[:0]  # punctuation alone stands before it
        doc, entry, begins = doc[real], entry[real], runs
        kind, code = self.kind[entry], self.hash[entry].copy()
        num, name = kind == _NUM, (kind == _NAME) | (kind == _CAPITALS)
        inner = np.r_[False, doc[1:] == doc[:-1]] if len(doc) else num
        glued = np.r_[False, inner[1:] & ~apart[1:] & ~begins[1:] & self.open[entry[:-1]]] if len(doc) else num
        # an article with a capital inside a sentence belongs to the name after it
        name |= (kind == _STARTER) & ~begins & np.r_[glued[1:] & (kind == _NAME)[1:], False] if len(doc) else num
        after = inner & np.r_[False, num[:-1]] if len(doc) else num
        unit = after & self.unit[entry] & ~num
        name &= ~unit
        literal = name & (begins | (kind == _CAPITALS))
        code[num], code[name], code[unit] = 3, 5, 7
        first_unit = ~inner & self.unit[entry] & ~num
        # names one after the other become one
        sure, firm = name & ~literal, name & (kind != _CAPITALS)

        def joined(left: np.ndarray) -> Words:
            more = glued & np.r_[False, sure[1:] & left[:-1]] if len(doc) else glued
            head = np.flatnonzero(~more)
            many = np.diff(np.r_[head, len(doc)])
            value = self.hash[entry][head]
            for k in np.flatnonzero(many > 1):
                for e in entry[head[k] + 1 : head[k] + many[k]]:
                    value[k] = (int(value[k]) * int(_STEP) + int(self.hash[e])) & 0xFFFFFFFFFFFFFFFF
            return Words(doc[head], code[head], value, (num | name | unit)[head], literal[head] & (many == 1), first_unit[head], head, many, entry)

        plain = joined(sure)
        at_start = glued[1:] & sure[1:] & (firm & begins)[:-1] if len(doc) else glued
        return plain, joined(firm) if at_start.any() else None


@dataclass
class Words:
    """Template words: text number, code, hash of the value, whether it is a slot, may be literal, may be a unit; first entry and number of entries of each; all entries."""

    doc: np.ndarray
    code: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    literal: np.ndarray
    unit: np.ndarray
    head: np.ndarray
    many: np.ndarray
    entry: np.ndarray

    def around(self, marked: np.ndarray, size: int) -> tuple[Words, np.ndarray]:
        """(the words less than ``size`` from marked ones, each stretch with a number of its own as text; their places in the whole)."""
        near = np.zeros(len(marked), bool)
        for at in range(-size + 1, size):
            near |= np.roll(marked, at)
        place = np.flatnonzero(near)
        stretch = np.cumsum(np.r_[True, (np.diff(place) > 1) | (self.doc[place[1:]] != self.doc[place[:-1]])]) if len(place) else place
        take = lambda x: x[place]
        return Words(stretch, *(take(x) for x in (self.code, self.value, self.slot, self.literal, self.unit, self.head, self.many)), self.entry), place


def _windows(doc: np.ndarray, code: np.ndarray, slot: np.ndarray, value: np.ndarray, size: int, other: list[tuple[np.ndarray, np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, bits of the slots, is by value) of each window of ``size`` template words inside one text, in each reading.

    A reading needs two literal words at least (one of two).  All windows without them in some reading are also hashed by value.

    value[word]: hash of the word as it is.  ``other``: further readings as (words that have it, code of each word in it, whether it makes them slots).
    """
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    h, slots = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for i in range(size):
        h = h * _STEP + code[i : n + i]
        slots |= slot[i : n + i].astype(np.int64) << i
    inside = np.flatnonzero(doc[:n] == doc[size - 1 :])
    start, h, slots = inside, h[inside], slots[inside]
    for has, new, becomes in other:
        at, weight = np.flatnonzero(has), np.uint64(1)
        mark = np.zeros(len(code) + 1, bool)
        mark[at] = True
        for i in range(size - 1, -1, -1):
            turned = np.flatnonzero(mark[start + i] & ((slots >> i & 1) == slot[start + i]))
            if len(turned):
                word = start[turned] + i
                changed = h[turned] + (new[word] - code[word]) * weight
                bit = np.int64(1 << i)
                start, h = np.r_[start, start[turned]], np.r_[h, changed]
                slots = np.r_[slots, slots[turned] | bit if becomes else slots[turned] & ~bit]
            weight = np.uint64(int(weight) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
    literal = size - np.bitwise_count(slots).astype(np.int64)
    good = literal >= min(2, max(1, size - 1))
    # what one side's reading lets be a template can be dense on the other: by value wherever the first reading or another is too dense
    dense = np.unique(start[~good])
    exact, bits = np.zeros(len(dense), np.uint64), np.zeros(len(dense), np.int64)
    for i in range(size):
        exact = exact * _STEP + value[dense + i]
        bits |= slot[dense + i].astype(np.int64) << i
    hashes = np.r_[mix(h[good] + np.uint64(size)), mix(exact + np.uint64(size + 64))]
    return np.r_[start[good], dense], hashes, np.r_[slots[good], bits], np.r_[np.zeros(good.sum(), bool), np.ones(len(dense), bool)]


def _template_rows(table: DataFrame, key: str, text: str, size: int, sizes: list[int] | None, bits: int, wanted: np.ndarray | None) -> DataFrame:
    """(id, variant, total, usable, pos, exact, h, slots): the template windows of each text.

    variant: 0, or 1 with names joined to the first words of sentences.  Of benchmark items that has all windows, of other texts those that hold a joined name.

    exact: by value.  usable: how many of the text's ``total`` windows make templates.

    ``sizes`` None: a benchmark; texts of fewer words than ``size`` are one window.  ``wanted``: keep only
    windows whose hash is set in this bitmap.
    """
    held = table.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Template()
        bitmap = held.value if held is not None else None
        for batch in slices(batches, "text", 1 << 20):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for variant, words in enumerate(made.of(byte_rows(batch.column(1)))):
                if words is None:
                    continue
                whole = words
                place = np.arange(len(words.doc))
                # a joined name at the start of a sentence; a literal reading has gone
                fresh = (words.many > 1) & ~np.isin(words.head, plain.head[plain.many > 1]) if variant else np.zeros(0, bool)
                if variant and sizes is not None:
                    words, place = whole.around(fresh, size)
                plain = plain if variant else words
                first = np.searchsorted(whole.doc, np.arange(len(ids) + 1))
                length = np.diff(first)
                has = np.bincount(whole.doc[fresh], minlength=len(ids)) > 0 if variant else np.ones(len(ids), bool)
                other = [(words.literal, words.value, False)] + ([(words.unit, np.full(len(words.code), 7, np.uint64), True)] if sizes is None else [])
                usable = np.zeros(len(ids), np.int64)
                held_before = np.r_[0, np.cumsum(fresh[place])] if variant else None
                for n in sizes or range(1, size + 1):
                    start, h, slots_of, exact = _windows(words.doc, words.code, words.slot, words.value, n, other)
                    doc = whole.doc[place]
                    if sizes is None:
                        here = np.flatnonzero(has[doc[start]] & (length[doc[start]] == n if n < size else length[doc[start]] >= n))
                        usable += np.bincount(doc[np.unique(start[here][~exact[here]])], minlength=len(ids))
                    else:
                        low = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
                        hit = (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0
                        here = np.flatnonzero(hit & (held_before[start + n] > held_before[start]) if variant else hit)
                    for i in here:
                        s = start[i]
                        d = doc[s]
                        heads, many = words.head[s : s + n], words.many[s : s + n]
                        values = [" ".join(made.value[e] for e in words.entry[heads[j] : heads[j] + many[j]]) for j in range(n) if slots_of[i] >> j & 1]
                        total = max(1, int(length[d]) - size + 1)
                        out.append((int(ids[d]), variant, total, int(usable[d]), int(place[s] - first[d]), bool(exact[i]), int(h[i].view(np.int64)), values))
            if out:
                cols = list(zip(*out))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "variant", "total", "usable", "pos", "exact", "h", "slots"])

    pair = table.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return pair.mapInArrow(lean(run), "id long, variant int, total long, usable long, pos long, exact boolean, h long, slots array<string>")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 5, similarity: float = 0.8, bits: int = 22
) -> DataFrame:
    """(key, item, coverage, exact) for each document that holds a benchmark item or a re-parameterised one.

    coverage is the share of the item's windows (``size`` template words; shorter items: the whole item) that
    the document has in consistent alignments, ``similarity`` or more.  Where more than half of an item's windows make templates,
    the share of these counts if it is larger; all windows can also be met by value.  exact says that all slots that were met, and all
    windows that make no templates, hold the item's own values.  Texts that are null, empty or without template words match nothing;
    repeated rows count once; empty tables give an empty result; other columns are ignored.

    Windows of documents are first looked up in a bitmap of 2**``bits`` bits made from the benchmark: its size
    is fixed, whatever the benchmark's is; a fuller bitmap only sends more windows to the join, which decides.
    """
    items = cut(_template_rows(benchmark.dropDuplicates([item]), item, item_text, size, None, bits, None), "items")
    slots = items.select(F.col("h").bitwiseAND((1 << bits) - 1).alias("low")).distinct().toArrow()["low"].to_numpy()  # at most 2**bits
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    np.bitwise_or.at(bitmap, slots >> 3, np.left_shift(np.uint8(1), (slots & 7).astype(np.uint8)))
    shorter = [r[0] for r in items.filter("total = 1").groupBy("id").agg(F.count("*")).limit(1).collect()]
    sizes = list(range(1, size + 1)) if shorter else [size]
    hits = _template_rows(docs, key, text, size, sizes, bits, bitmap)
    theirs = items.select("h", F.col("id").alias("item"), "variant", "total", "usable", F.col("pos").alias("ipos"), F.col("exact").alias("by_value"), F.col("slots").alias("islots"))
    met = hits.select("id", "pos", "h", "slots").join(theirs, "h")
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("islots", "slots"))))
    templates = F.collect_set(F.when(~F.col("by_value"), F.col("ipos")))
    aligned = met.groupBy("id", "item", "variant", "total", "usable", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("covered"), templates.alias("templates"), pairs.alias("pairs"))
    values = F.array_distinct(F.transform("pairs", lambda x: x["islots"]))
    same = ~F.exists("pairs", lambda x: ~x["islots"].eqNullSafe(x["slots"]))
    sound = aligned.filter(F.size(values) == F.size("pairs")).withColumn("same", same)
    met_by = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    whole = sound.groupBy("id", "item", "variant", "total", "usable").agg(met_by("covered").alias("n"), met_by("templates").alias("m"), F.min("same").alias("same"))
    share = F.when(2 * F.col("usable") > F.col("total"), F.col("m") / F.col("usable")).otherwise(0.0)
    whole = whole.withColumn("exact", F.col("same") & (F.col("n") - F.col("m") >= F.col("total") - F.col("usable")))
    out = whole.withColumn("coverage", F.greatest(F.col("n") / F.col("total"), share)).filter(F.col("coverage") >= similarity)
    best = out.groupBy("id", "item").agg(F.max(F.struct("coverage", "exact")).alias("best"))  # of an item's variants
    return best.select(F.col("id").alias(key), F.col("item").alias(item), "best.coverage", "best.exact")
