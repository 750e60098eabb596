"""Language ID by a linear-chain conditional random field over the words of a text.

Each word has features: the word itself (lexicon), prefixes and suffixes of one to three bytes, and the
three-byte n-grams of the whole word between marks, hashed into a fixed number of slots.  A slot holds a weight for each language; the
chain has a weight for each pair of neighbouring languages.  Forward-backward gives each word its
distribution over languages given the whole text, so code-switched passages are labelled word by word; a
text's language is the one with the largest mean over its words.

Training maximises the conditional likelihood of sequences made of stretches of labelled texts: within a
stretch the language stays, between stretches it may change, which is what the transitions are learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, lean, mix, slices

#: Longest word that is one position of the chain, in bytes; longer runs become several.
_PIECE = 48


def words_of(text: bytes) -> list[bytes]:
    """Words of a text; runs of more than _PIECE bytes are cut between characters into pieces that overlap by two bytes or more, so that no n-gram is lost."""
    words = text.split()
    if not words or max(map(len, words)) <= _PIECE:
        return words
    out = []
    for w in words:
        start, end = 0, len(w)
        while len(w) - start > _PIECE:
            end = _floor(w, start + _PIECE)
            out.append(w[start:end])
            start = _floor(w, end - 2)
        out.append(w[start:])
    return out


def _floor(word: bytes, at: int) -> int:
    """The last place up to ``at`` where a character begins."""
    for i in range(4):
        if word[at - i] & 0xC0 != 0x80:
            return at - i
    return at


def has_letter(word: bytes) -> bool:
    return any(c.isalpha() for c in word.decode("utf-8", "replace"))


def features(words: list[bytes], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, slot) of the features of lower-cased words, by word; none for words without letters."""
    real = np.array([w.isalpha() or has_letter(w) for w in words], bool)
    kept = np.flatnonzero(real)
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.array([xxhash.xxh3_64_intdigest(words[i]) for i in kept], np.uint64)
    held = [words[i] for i in kept]
    raw = np.frombuffer(b"^" + b"$^".join(held) + b"$", np.uint8).astype(np.uint64)
    size = np.array([len(w) for w in held], np.int64)
    first = np.r_[0, np.cumsum(size + 2)[:-1]] + 1
    last = first + size - 1
    number = np.repeat(np.arange(len(kept)), size)
    # the three-byte windows of each marked word
    at = np.arange(len(number)) + 2 * number
    owner, code = [number], [raw[at] | raw[at + 1] << np.uint64(8) | raw[at + 2] << np.uint64(16) | np.uint64(4 << 40)]
    for n in (1, 2, 3):
        here = np.flatnonzero(size >= n)
        head, tail = np.zeros(len(here), np.uint64), np.zeros(len(here), np.uint64)
        for i in range(n):
            head = head << np.uint64(8) | raw[first[here] + i]
            tail = tail << np.uint64(8) | raw[last[here] - i]
        owner += [here, here]
        code += [head | np.uint64((8 + n) << 40), tail | np.uint64((16 + n) << 40)]
    owner.append(np.arange(len(kept)))
    code.append(whole)
    slot = (mix(np.concatenate(code)) % np.uint64(slots)).astype(np.int64)
    owner = kept[np.concatenate(owner)]
    order = np.argsort(owner, kind="stable")
    return owner[order], slot[order]


@dataclass
class Crf:
    """labels; weights[slot, label]; transitions[from, to]; slots."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(score of each language, has features) for each word."""
        owner, slot = features([_lower(w) for w in words], len(self.weights))
        scores = np.stack([np.bincount(owner, self.weights[slot, y], minlength=len(words)) for y in range(len(self.labels))], 1)
        return scores.astype(np.float32), np.bincount(owner, minlength=len(words)) > 0


def _lower(word: bytes) -> bytes:
    return word.lower() if word.isascii() else word.decode("utf-8", "replace").lower().encode()


def forward_backward(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, width: int = 128, pairs: bool = False):
    """Distribution over labels at each position of many chains, laid end to end; with ``pairs`` also the
    expected number of each pair of neighbouring labels.

    scores[t, label]; starts[t] is true where a chain begins.  The positions are cut into ``width``-long
    stretches that are handled side by side: first each stretch's matrix product, then the stretches in turn, then
    each stretch's positions from the message that reaches it.  This is exact; no stretch is approximated.
    """
    total, size = scores.shape
    if not total:
        return (scores, np.zeros((size, size))) if pairs else scores
    hop = np.exp(transitions - transitions.max())
    turned = np.ascontiguousarray(hop.T)
    lanes = -(-total // width)
    pad = lanes * width - total
    near = np.ones((lanes * width, size))
    np.exp(scores - scores.max(1, keepdims=True), out=near[:total])
    # by position within the stretch, so that each step reads and writes one block
    near = np.ascontiguousarray(near.reshape(lanes, width, size).transpose(1, 0, 2))
    first = np.r_[starts, np.ones(pad, bool)].reshape(lanes, width)
    begins = [np.flatnonzero(first[:, t]) for t in range(width)]

    def settle(v: np.ndarray, t: int) -> np.ndarray:
        """Keep messages in range; every few steps is enough, as each step has a label of weight 1."""
        return v / v.sum(axis=tuple(range(1, v.ndim)), keepdims=True) if t % 4 == 0 else v

    def step(v: np.ndarray, t: int) -> np.ndarray:
        """Forward messages (rows of v) to position t of each lane; a chain's start forgets them."""
        moved = (v.reshape(-1, size) @ hop).reshape(v.shape)
        if len(begins[t]):
            moved[begins[t]] = 1.0
        moved *= near[t] if v.ndim == 2 else near[t][:, None]
        return settle(moved, t)

    def back(v: np.ndarray, t: int) -> np.ndarray:
        """Backward messages from position t of each lane to the one before; a chain's start cuts them."""
        moved = ((v * (near[t] if v.ndim == 2 else near[t][:, None])).reshape(-1, size) @ turned).reshape(v.shape)
        if len(begins[t]):
            moved[begins[t]] = 1.0
        return settle(moved, t)

    eye = np.broadcast_to(np.eye(size), (lanes, size, size))
    product, back_product = eye, eye
    for t in range(width):
        product = step(product, t)
    for t in range(width - 1, -1, -1):
        back_product = back(back_product, t)
    enter, leave = np.ones((lanes, size)), np.ones((lanes, size))
    message = np.ones(size) / size
    for i in range(lanes):
        enter[i] = message
        message = message @ product[i]
        message = message / message.sum()
    message = np.ones(size) / size
    for i in range(lanes - 1, -1, -1):
        leave[i] = message
        message = message @ back_product[i]
        message = message / message.sum()
    alpha = np.empty_like(near)
    beta = np.empty_like(near) if pairs else None
    v = enter
    for t in range(width):
        v = alpha[t] = step(v, t)
    v = leave
    for t in range(width - 1, -1, -1):
        if pairs:
            beta[t] = v
        else:
            alpha[t] *= v
        v = back(v, t)
    alpha = alpha.transpose(1, 0, 2)
    if pairs:
        near, beta = near.transpose(1, 0, 2), beta.transpose(1, 0, 2)
    flat = alpha.reshape(-1, size)[:total]
    if not pairs:
        return flat / flat.sum(1, keepdims=True)
    later = beta.reshape(-1, size)[:total]
    inner = ~starts[1:]
    joint = flat[:-1][inner][:, :, None] * hop * (near.reshape(-1, size)[1:total] * later[1:])[inner][:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    flat = flat * later
    return flat / flat.sum(1, keepdims=True), joint.sum(0)


def train(texts: list[bytes], langs: list[str], *, slots: int = 1 << 16, rounds: int = 40, stretch: int = 40, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> Crf:
    """Fit by full-batch adaptive gradient steps on the conditional log-likelihood."""
    labels = sorted(set(langs))
    size = len(labels)
    number = {x: i for i, x in enumerate(labels)}
    pieces: list[tuple[int, list[bytes]]] = []
    for text, lang in zip(texts, langs):
        words = [_lower(w) for w in words_of(text)]
        pieces += [(number[lang], words[i : i + stretch]) for i in range(0, len(words), stretch)]
    order = np.random.default_rng(seed).permutation(len(pieces))
    ids: dict[bytes, int] = {}
    word, gold, start = [], [], []
    for turn, i in enumerate(order):
        y, words = pieces[i]
        begin = turn % 8 == 0  # eight stretches make a sequence
        for w in words:
            word.append(ids.setdefault(w, len(ids)))
            gold.append(y), start.append(begin)
            begin = False
    owner, slot = features(list(ids), slots)
    has = np.zeros(len(ids), bool)
    has[owner] = True
    word, gold, start = np.array(word, np.int64), np.array(gold, np.int64), np.array(start, bool)
    # a sequence whose first words have no letters begins at the first that has
    chain = np.cumsum(start)
    word, gold, chain = (x[has[word]] for x in (word, gold, chain))
    start = np.r_[True, chain[1:] != chain[:-1]][: len(word)]
    weights, hops = np.zeros((slots, size)), np.zeros((size, size))
    if not len(word) or size < 2:
        return Crf(labels, weights, hops)
    truth = np.stack([np.bincount(word[gold == y], minlength=len(ids)) for y in range(size)], 1).astype(float)
    inner = ~start[1:]
    pairs = np.bincount(gold[:-1][inner] * size + gold[1:][inner], minlength=size * size).reshape(size, size).astype(float)
    sq_w, sq_h = np.full_like(weights, 1e-8), np.full_like(hops, 1e-8)
    for _ in range(rounds):
        emit = np.stack([np.bincount(owner, weights[slot, y], minlength=len(ids)) for y in range(size)], 1)
        scores = emit[word]
        p, joint = forward_backward(scores, start, hops, pairs=True)
        expected = np.stack([np.bincount(word, p[:, y], minlength=len(ids)) for y in range(size)], 1)
        g = (truth - expected)[owner]
        grad = np.stack([np.bincount(slot, g[:, y], minlength=slots) for y in range(size)], 1) / len(word) - decay * weights
        grad_h = (pairs - joint) / len(word) - decay * hops
        sq_w += grad**2
        sq_h += grad_h**2
        weights += rate * grad / np.sqrt(sq_w)
        hops += rate * grad_h / np.sqrt(sq_h)
    return Crf(labels, weights, hops)


def fit(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", most_docs: int = 1200, most_bytes: int = 2 << 20, **options) -> Crf:
    """Fit on at most ``most_docs`` labelled rows and ``most_bytes`` of text, the first by a hash of the key (without one: of the text).

    This bounded sample is the one place where not all rows are read; prediction covers every row.  Rows with
    a null text or language are not labelled.  The sample is drawn within each language, so that rare ones are in it.
    """
    from pyspark.sql.window import Window

    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)).alias("h"))
    # the smallest hashes of each language, by map-side combined aggregation on hashes alone
    counts = rows.groupBy("lang").agg(F.count("*").alias("all"))
    langs = counts.count()
    if not langs:
        return Crf([], np.zeros((1, 0)), np.zeros((0, 0)))
    each = max(1, most_docs // langs)
    share = F.least(F.lit(1.0), F.lit(1.5 * each) / F.col("all") + 0.001)
    bar = F.when(share >= 1, F.lit(2**63 - 1)).otherwise(((share - 0.5) * 2.0**64).cast("long"))
    counts = F.broadcast(counts) if langs <= 100_000 else counts  # a checked size; more languages meet in a join
    order = Window.partitionBy("lang").orderBy("h", "text")
    few = rows.join(counts, "lang").filter(F.col("h") <= bar).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each)
    room = Window.partitionBy("lang").orderBy("k")
    few = few.withColumn("bytes", F.sum(F.octet_length("text")).over(room)).filter((F.col("bytes") <= most_bytes // langs) | (F.col("k") == 1))
    sample = few.select("lang", "text").collect()
    return train([r["text"].encode() for r in sample], [r["lang"] for r in sample], **options)


class _Emissions(dict):
    """word -> row in a table of emissions, -1 without letters; remembers a bounded number of words."""

    def __init__(self, model: Crf, most: int = 100_000):
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.table, self.real = np.zeros((0, len(self.model.labels)), np.float32), np.zeros(0, bool)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.reset()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            scores, real = self.model.emissions(self.new)
            self.table, self.real, self.new = np.vstack([self.table, scores]), np.r_[self.real, real], []
        rows[~self.real[rows]] = -1
        return rows


def label_words(model: Crf, texts: list[bytes], cache: _Emissions | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document number, distribution over languages) for each word with a letter, in order."""
    cache = cache if cache is not None else _Emissions(model)
    split = [words_of(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in split])
    rows = cache.rows([w for words in split for w in words])
    doc, rows = doc[rows >= 0], rows[rows >= 0]
    if not len(rows):
        return doc, np.zeros((0, len(model.labels)))
    start = np.r_[True, doc[1:] != doc[:-1]]
    return doc, forward_backward(cache.table[rows].astype(np.float64), start, model.transitions)


def identify(docs: DataFrame, model: Crf, *, text: str = "text", unknown: str = "und") -> DataFrame:
    """The rows of ``docs`` plus lang_pred and score.

    lang_pred is the language with the largest mean over the text's words (ties: the first by name) and score
    that mean; ``und`` and 0.0 for texts that are null, empty or have no letter, and for all texts if the
    model knows no language.  Input columns named lang_pred or score are replaced.
    """
    body = docs.drop("lang_pred", "score")
    names = body.columns
    where = names.index(text)

    shared = body.sparkSession.sparkContext.broadcast((model.labels, model.weights.astype(np.float32), model.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(*shared.value)
        cache = _Emissions(own)
        for batch in slices(batches, text, 1 << 19):
            n = batch.num_rows
            pred, score = np.array([unknown] * n, object), np.zeros(n)
            if own.labels:
                doc, p = label_words(own, byte_rows(batch.column(where)), cache)
                words = np.bincount(doc, minlength=n)
                mean = np.stack([np.bincount(doc, p[:, y], minlength=n) for y in range(len(own.labels))], 1) / np.maximum(words, 1)[:, None]
                best = mean.argmax(1)
                some = words > 0
                pred[some] = np.array(own.labels, object)[best[some]]
                score[some] = np.minimum(mean[some, best[some]], 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*body.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return body.mapInArrow(lean(run), schema)
