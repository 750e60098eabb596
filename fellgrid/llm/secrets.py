"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of characters that secrets are made of, and single other characters such as ``.``, ``=`` or ``!``.
The field tags every token, whatever its length or look, as beginning a secret, inside one, or outside, from the token's shape, its
neighbours' classes and the gaps between them, keywords on the line and the line before, and features of the whole text (marks, mixed
tokens, keywords, names of settings files).  So a secret can be a run of tokens: a dotted web token, a password with marks, the lines
of a key, a quoted passphrase.  The best tagging is found by the Viterbi recursion.

The field is trained here, on a bounded sample of the texts labelled by the patterns and on made-up texts.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_rows, lean, mix, slices
from .langid import forward_backward

#: The base patterns, in the order that ties take.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")

#: Substrings one of which any text with an assign or access match has (A-Z lower-cased; as is).
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LONG_HEX = re.compile(rb"[0-9a-f]{24}")
#: Words that name secrets, and file name endings that hold settings.
_KEYWORD = re.compile(rb"pass|pwd|secret|token|key|auth|bearer|credential|private|login|signature", re.IGNORECASE)
_SETTINGS = re.compile(rb"\x00[\t-\r ]*(?:env|ini|cfg|conf|yml|yaml|json|toml|properties|pem|tf|sh|py|js)(?=\x00)", re.IGNORECASE)

#: A token is a run of bytes that secrets are mostly made of (letters, digits, + / _ - and all beyond ASCII), or one other byte that is no white space.
_SPACE = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
_RUN = np.isin(np.arange(256), list((string.ascii_letters + string.digits + "+/_-").encode())) | (np.arange(256) >= 128)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OUT, _BEGIN, _IN = 0, 1, 2
_NEVER = -30.0  # the weight of what can't be: a text that begins inside, inside after outside

#: What a neighbour sees of a token.
_CLASSES = ("edge", "assign", "quote", "dot", "mark", "keyword", "word", "title", "upper", "number", "mixed", "long", "path", "dashes", "settings", "letters")
_EDGE, _ASSIGN, _MARKS, _KEY, _MIXED, _LONG, _SET = 0, 1, (1, 2, 3, 4), 5, 10, 11, 14
_C = len(_CLASSES)
#: Numbers of values of the context features, see ``context_codes``.
_SIZES = (_C * 3 * _C, _C * 3 * _C, _C * _C, _C * _C, 12 * _C, 2 * _C)
#: The same for the features of the whole text, see ``file_codes``.
_FILE_SIZES = (4, 3, 2, 2)


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, by start, then kind; code points, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    low = raw.lower()
    out = []
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _LONG_HEX.search(raw):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


#: Numbers of values of the features of a token's look, see ``describe``.
_LOOKS = (16, 13, 80, 16, 6, 9, 6, 7, 2, 2, 2, 4, 5, 257)
_VOWEL = np.isin(np.arange(256), list(b"aeiouyAEIOUY")) | (np.arange(256) >= 128)
_KIND_OF = np.select([(np.arange(256) >= a) & (np.arange(256) <= b) for a, b in ((48, 57), (65, 90), (97, 122), (128, 255))], [1, 2, 3, 4], 0)
_HEX_DIGIT = np.isin(np.arange(256), list(b"0123456789abcdef"))
#: What is counted of a token's bytes, four counts of 16 bits in each of two sums.
_COUNTED = [[_KIND_OF == k for k in (1, 2, 3, 4)], [_VOWEL, _HEX_DIGIT, np.arange(256) == 47, np.isin(np.arange(256), (45, 95))]]
_PACKED = [sum(w.astype(np.int64) << (16 * i) for i, w in enumerate(ws)) for ws in _COUNTED]


def find_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, text number, start, length, hash, gap) of the tokens; texts stand end to end with a line break after each.

    gap: 0 glued to the token before, 1 after white space, 2 after a line break.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    run, space = _RUN[raw], _SPACE[raw]
    begins = ~space
    begins[1:] &= ~(run[1:] & run[:-1])
    start = np.flatnonzero(begins)
    # a run ends where the next byte is of another kind
    ends = ~space
    ends[:-1] &= ~(run[1:] & run[:-1])
    length = np.flatnonzero(ends) + 1 - start
    doc = np.searchsorted(np.cumsum(size), start, side="right")
    # polynomial hashes of all tokens from sums over the bytes; powers by place in the token
    place = np.arange(len(raw)) - np.maximum.accumulate(np.where(begins, np.arange(len(raw)), 0))
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, _STEP))
    terms = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.where(space, np.uint64(0), power[place]))
    last = start + length - 1
    h = mix(terms[last] - np.where(start > 0, terms[start - 1], np.uint64(0)) + length.astype(np.uint64)) | np.uint64(1)
    lines = np.cumsum((raw == 10) | (raw == 13))
    before = np.r_[0, last[:-1]] if len(start) else start
    gap = np.where(start == before + 1, 0, np.where(lines[start] > lines[before], 2, 1))
    return raw, doc, start, length, h, gap


def describe(raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(class, feature numbers in the order of ``_LOOKS``) of each token, from their bytes end to end and their lengths.

    The features: which kinds of characters, length, both together, entropy (from eight characters on), share of digits, how often the kind
    changes, share of vowels, longest run without one, hexadecimal, a usual key length, ASCII, slashes, joining marks, the character itself if it is one.
    """
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    if n.max() < 1 << 15:
        sums = [np.add.reduceat(packed[raw], first) for packed in _PACKED]
        digits, upper, lower, high, vowels, hexes, slashes, joins = (s >> (16 * i) & 0xFFFF for s in sums for i in range(4))
    else:
        digits, upper, lower, high, vowels, hexes, slashes, joins = (np.add.reduceat(w[raw].astype(np.int64), first) for ws in _COUNTED for w in ws)
    rest = n - digits - upper - lower
    kind = _KIND_OF[raw]
    far = (n >= 8)[owner]  # shorter tokens count as one of no entropy
    pair, times = np.unique((owner[far] * 256 + raw[far]).astype(np.int64), return_counts=True)
    share = times / n[pair >> 8]
    bits = -np.bincount(pair >> 8, share * np.log2(share), minlength=len(n))
    turn = np.zeros(len(raw), np.int64)
    turn[1:] = (kind[1:] != kind[:-1]) & (owner[1:] == owner[:-1]) & ~((kind[:-1] == 2) & (kind[1:] == 3))
    turns = np.add.reduceat(turn, first) / n
    place = np.arange(len(raw))
    barrier = _VOWEL[raw] | (kind != 2) & (kind != 3)
    past = np.maximum.accumulate(np.where(barrier, place, np.where(place == first[owner], place - 1, -1)))
    clump = np.maximum.reduceat(place - past, first)
    shape = (digits > 0) + 2 * (upper > 0) + 4 * (lower > 0) + 8 * (rest > 0)
    looks = [shape, np.minimum(n // 4, 12), shape * 5 + np.minimum(n // 8, 4), np.minimum((bits * 2).astype(np.int64), 15), 5 * digits // n, (turns * 8).astype(np.int64), 5 * vowels // n]
    looks += [np.minimum(clump, 6), (hexes == n).astype(np.int64), np.isin(n, (16, 20, 24, 32, 36, 40, 64)).astype(np.int64), (high == 0).astype(np.int64), np.minimum(slashes, 3), np.minimum(joins, 4), np.where(n == 1, raw[first].astype(np.int64) + 1, 0)]
    # the class that neighbours see
    letters, ascii_ = (upper + lower + high == n), high == 0
    body_upper, body_lower = upper - (kind[first] == 2), lower - (kind[first] == 3)
    inner = (body_upper > 0) & (body_lower > 0) & ascii_
    of_letters = np.select([inner & (n >= 20), inner & (n >= 8), (upper == n) & (n > 1), kind[first] == 2, n >= 12], [_LONG, _MIXED, 8, 7, 15], 6)
    of_byte = lambda c: np.add.reduceat((raw == c).astype(np.int64), first) if (raw == c).any() else np.zeros(len(n), np.int64)
    many = (slashes > 1) | ((joins > 1) & ((of_byte(45) > 1) | (of_byte(95) > 1)))
    out = np.select([letters | ~ascii_, digits == n, many], [of_letters, 9, 12], np.where(n >= 12, _LONG, _MIXED))
    # words of their own, found in all tokens at once, zero bytes between them
    spread = np.zeros(len(raw) + len(n) + 1, np.uint8)
    spread[place + owner + 1] = raw
    line, where = spread.tobytes(), first + np.arange(len(n)) + 1
    named = np.zeros(len(n), bool)
    named[np.searchsorted(where, [m.start() for m in _KEYWORD.finditer(line)], side="right") - 1] = True
    out[named & (digits == 0) & (n < 32)] = _KEY
    out[np.searchsorted(where, [m.start() + 1 for m in _SETTINGS.finditer(line)])] = _SET
    out[(joins + slashes + of_byte(43) == n)] = 13
    one = np.flatnonzero((n == 1) & (kind[first] == 0) & ~np.isin(raw[first], list(b"+/_-")))
    char = raw[first][one]
    out[one] = np.select([np.isin(char, list(b"=:")), np.isin(char, list(b"\"'`")), char == 46], [_ASSIGN, 2, 3], 4)
    return out, looks


class _Tokens:
    """Hash of a token -> row of its class and feature numbers, or of ``own`` of these; remembers about ``most``.

    The hashes stand in a table of fixed size, each at the first free place from where its upper bits point to.
    """

    def __init__(self, own=None, most: int = 300_000):
        self.own, self.most = own, most
        self.bits = max(8, (4 * most - 1).bit_length())
        self.reset()

    def reset(self) -> None:
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.kind, self.values = np.zeros(0, np.int64), None

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash or of the free place where it would go, whether it is there)."""
        place = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            held = self.keys[place[open_]]
            open_ = open_[(held != 0) & (held != h[open_])]
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
        return place, self.keys[place] == h

    def rows(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray) -> np.ndarray:
        place, known = self._probe(h)
        if not known.all():
            new, first = np.unique(h[~known], return_index=True)
            if len(self.kind) + len(new) > self.most and len(self.kind):
                if len(new) > self.most:  # a batch with more different tokens than are remembered
                    self.most = 2 * len(new)
                    self.bits = (4 * self.most - 1).bit_length()
                self.reset()
                return self.rows(raw, start, length, h)
            if 2 * (len(self.kind) + len(new)) > 1 << self.bits:
                self.most = 2 * len(new)
                self.bits = (4 * self.most - 1).bit_length()
                self.reset()
                return self.rows(raw, start, length, h)
            at = np.flatnonzero(~known)[first]
            n = length[at]
            gather = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            kind, looks = describe(raw[gather], n)
            values = np.stack(looks, 1) if self.own is None else self.own(looks)
            row = np.arange(len(self.kind), len(self.kind) + len(new), dtype=np.int32)
            self.kind = np.r_[self.kind, kind]
            self.values = values if self.values is None else np.concatenate([self.values, values])
            waiting = np.arange(len(new))
            while len(waiting):  # of several that want one free place one gets it
                spot, _ = self._probe(new[waiting])
                self.keys[spot], self.at[spot] = new[waiting], row[waiting]
                waiting = waiting[self.keys[spot] != new[waiting]]
            place, _ = self._probe(h)
        return self.at[place].astype(np.int64)


def context_codes(kind: np.ndarray, gap: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Numbers of the context features of each token of many texts end to end, in the order of ``_SIZES``.

    With the token's own class: the class before and the gap between; the class after and that gap; the classes
    two before and two after; how far back on the line a keyword is, and whether an assignment follows it; whether the line before
    has a keyword.
    """
    n = len(kind)
    place = np.arange(n)

    def near(by: int) -> np.ndarray:
        out = np.full(n, _EDGE)
        if abs(by) < n:
            a, b = (slice(-by, None), slice(None, by)) if by < 0 else (slice(None, -by), slice(by, None))
            out[a] = np.where(doc[a] == doc[b], kind[b], _EDGE)
        return out

    before, after = near(-1), near(1)
    later = np.r_[gap[1:], 0] if n else gap
    first = np.r_[True, doc[1:] != doc[:-1]] if n else np.zeros(0, bool)
    begins = first | (gap == 2)
    line = np.maximum.accumulate(np.where(begins, place, 0)) if n else place
    last_of = lambda what: np.r_[-1, np.maximum.accumulate(np.where(what, place, -1))[:-1]] if n else place
    key, assign = last_of(kind == _KEY), last_of(kind == _ASSIGN)
    far = np.digitize(place - key, (2, 3, 5, 9))  # 0: next to it
    named = np.where(key >= line, (far + 1) * 2 + (assign > key), 0)
    number = np.cumsum(begins) - 1
    has = np.bincount(number, kind == _KEY, minlength=1) > 0
    above = np.r_[False, has[:-1]][number] & (doc[np.maximum(line - 1, 0)] == doc) & (line > 0)
    return [(before * 3 + gap) * _C + kind, (after * 3 + later) * _C + kind, near(-2) * _C + kind, near(2) * _C + kind, named * _C + kind, above * _C + kind]


def file_codes(kind: np.ndarray, doc: np.ndarray, docs: int) -> list[np.ndarray]:
    """Numbers of the features of each whole text, in the order of ``_FILE_SIZES``: share of marks, share of mixed tokens, a keyword, the name of a settings file."""
    held = np.bincount(doc * _C + kind, minlength=docs * _C).reshape(docs, _C)
    size = np.maximum(held.sum(1), 1)
    dotted = np.r_[False, (kind[1:] == _SET) & (kind[:-1] == 3) & (doc[1:] == doc[:-1])][: len(kind)]
    settings = np.bincount(doc[dotted], minlength=docs) > 0
    marks, mixed = held[:, list(_MARKS)].sum(1) / size, held[:, [_MIXED, _LONG]].sum(1) / size
    return [np.minimum((marks * 8).astype(np.int64), 3), np.minimum((mixed * 20).astype(np.int64), 2), (held[:, _KEY] > 0).astype(np.int64), settings.astype(np.int64)]


@dataclass
class SecretField:
    """Weights[feature number, tag] of each feature of a token's look, of its context, and (with the token's class) of its text; transitions[from, to]."""

    looks: list[np.ndarray]
    contexts: list[np.ndarray]
    files: list[np.ndarray]
    transitions: np.ndarray

    def own(self, looks: list[np.ndarray]) -> np.ndarray:
        return sum(w[code] for w, code in zip(self.looks, looks))

    def scores(self, texts: list[bytes], table: _Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, score of each tag, start, end) of all tokens of the texts; places in bytes of the texts end to end."""
        raw, doc, start, length, h, gap = find_tokens(texts)
        if not len(start):
            return doc, np.zeros((0, 3), np.float32), start, start
        row = table.rows(raw, start, length, h)
        kind = table.kind[row]
        # what the whole text adds is the same for all its tokens of a class
        of_text = sum(w.reshape(-1, _C, 3)[code] for w, code in zip(self.files, file_codes(kind, doc, len(texts))))
        out = np.take(table.values, row, axis=0)
        out += np.take(of_text.reshape(-1, 3), doc * _C + kind, axis=0)
        for weights, code in zip(self.contexts, context_codes(kind, gap, doc)):
            out += np.take(weights, code, axis=0)
        return doc, out, start, start + length

    def tags(self, doc: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The best tagging of each text (Viterbi).

        A token is outside in every best tagging if outside beats both other tags by more than any change of tags around it can
        bring (then a secret that went on after it would begin there).  The lattice falls apart at such tokens, and the recursion over
        the stretches between them is exact for the whole text; no token is left out for its look.
        """
        hop = self.transitions
        n = len(scores)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        ends = np.r_[doc[1:] != doc[:-1], True]
        gain = np.where(ends, -np.inf, np.r_[scores[1:, _IN] - scores[1:, _BEGIN], 0.0])
        onward = max(0.0, *(hop[_IN] - hop[_BEGIN]))
        unsure = np.zeros(n, bool)
        for tag in (_BEGIN, _IN):
            enter = max(hop[p, tag] - hop[p, _OUT] for p in ((_OUT, _BEGIN, _IN) if tag == _BEGIN else (_BEGIN, _IN)))
            leave = max(0.0, hop[tag, _OUT] - hop[_OUT, _OUT], hop[tag, _BEGIN] - hop[_OUT, _BEGIN])
            most = enter + np.maximum(leave, hop[tag, _IN] - hop[_OUT, _BEGIN] + onward + gain)
            unsure |= scores[:, _OUT] - scores[:, tag] <= most + 1e-4
        at = np.flatnonzero(unsure)
        breaks = np.flatnonzero((np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])) + 1 if len(at) else np.zeros(0, np.int64)
        first, last = at[np.r_[0, breaks]] if len(at) else at, at[np.r_[breaks, len(at)] - 1] if len(at) else at
        alone = (first == last) & ~ends[last]  # one token between two outside: outside or a secret by itself
        one = first[alone]
        tags[one] = scores[one, _BEGIN] + hop[_OUT, _BEGIN] + hop[_BEGIN, _OUT] > scores[one, _OUT] + 2 * hop[_OUT, _OUT]
        first, last = first[~alone], last[~alone]
        viterbi(scores, hop, first, last - first + 1, ~ends[last], tags)
        return tags

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets of one text; code points."""
        return next(self.spans_of([text.encode("utf-8", "replace")], _Tokens(self.own)))

    def spans_of(self, texts: list[bytes], table: _Tokens) -> Iterator[list[tuple[int, int]]]:
        """The secrets of each text (UTF-8); code points."""
        doc, scores, start, end = self.scores(texts, table)
        tags = self.tags(doc, scores)
        hit = np.flatnonzero(tags != _OUT)
        first = np.searchsorted(doc[hit], np.arange(len(texts) + 1))
        base = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        for i, text in enumerate(texts):
            out: list[tuple[int, int]] = []
            for k in hit[first[i] : first[i + 1]].tolist():
                span = (int(start[k] - base[i]), int(end[k] - base[i]))
                if tags[k] == _IN:
                    out[-1] = (out[-1][0], span[1])
                else:
                    out.append(span)
            if out and not text.isascii():
                points = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
                out = [(int(points[a]), int(points[b])) for a, b in out]
            yield out


def viterbi(scores: np.ndarray, hop: np.ndarray, first: np.ndarray, length: np.ndarray, closed: np.ndarray, tags: np.ndarray) -> None:
    """Write the best tags of stretches, each after a token outside; ``closed``: one outside follows it, too.  All stretches go side by side."""
    if not len(first):
        return
    order = np.argsort(-length, kind="stable")
    first, length, closed = first[order], length[order], closed[order]
    running = lambda t: int(np.searchsorted(-length, -t, side="left"))  # noqa: E731  (stretches longer than t come first)
    best = (hop[_OUT] + scores[first]).astype(np.float64)
    back = []
    for t in range(1, int(length[0])):
        k = running(t)
        all_ = best[:k, :, None] + hop
        back.append(all_.argmax(1).astype(np.int8))
        best[:k] = all_.max(1) + scores[first[:k] + t]
    tag = (best + np.where(closed[:, None], hop[:, _OUT], 0.0)).argmax(1)
    tags[first + length - 1] = tag
    for t in range(int(length[0]) - 1, 0, -1):
        k = running(t)
        tag[:k] = back[t - 1][np.arange(k), tag[:k]]
        tags[first[:k] + t - 1] = tag[:k]


def _made_up(count: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts of a few lines with and without secrets, and where the secrets are."""
    rng = random.Random(seed)
    pick = lambda chars, a, b=None: "".join(rng.choice(chars) for _ in range(rng.randint(a, b or a)))
    low, alnum, any64 = string.ascii_lowercase, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    url64 = string.ascii_letters + string.digits + "_-"
    syllables = "an ber co den el far go hin is ka lo mer nu or pa que ra sol ti un ver wa xi yo zen th st er".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def password() -> str:
        body = word() + rng.choice(["", str(rng.randint(0, 9999))]) + rng.choice(["", word().title()]) + str(rng.randint(0, 99))
        body = body.translate(str.maketrans({"e": "3"})) if rng.random() < 0.3 else body
        return body.title() + pick("!@#$%&*?", 0, 2) + rng.choice(["", pick(alnum, 1, 4)]) if rng.random() < 0.6 else pick(alnum + "!@#$%&*", 8, 14)

    secrets_ = [
        lambda: pick(alnum, 16, 44), lambda: pick(any64, 24, 60) + rng.choice(["", "=", "=="]), lambda: pick("0123456789abcdef", rng.choice([16, 20, 32, 40, 64])), lambda: pick(low, 14, 24),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "pat-", "SG."]) + pick(alnum, 20, 36),
        lambda: "eyJ" + pick(url64, 16, 30) + "." + pick(url64, 30, 80) + "." + pick(url64, 30, 43), lambda: pick(alnum, 8, 20) + "." + pick(alnum, 12, 24), lambda: "-".join(pick(alnum, 4, 8) for _ in range(rng.randint(2, 4))),
        password, password, password, lambda: "-".join(pick(low, 4, 8) for _ in range(4)),
    ]
    names = "key auth_token client_secret pwd db_pwd credential access_key session_token passphrase PASS DB_PASS AUTH_KEY login_key private_key signature userPassword apiToken".split()
    leads = [" = ", "=", ": ", ' = "', ' "', " ", ":", " => ", '": "', " is "]
    harmless = [
        lambda: f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: f"https://www.example.com/{word()}/{rng.randint(1, 9999)}/{word()}-{word()}-{rng.randint(1, 99)}?{word()}={rng.randint(1, 99)}",
        lambda: f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}:00", lambda: f"{word()}_{word()}_{rng.randint(1, 99)}", lambda: word().title() + word().title() + word().title(),
        lambda: word() + word() + word() + str(rng.randint(0, 99)), lambda: "+" + pick(string.digits, 12), lambda: f"{rng.randint(1000, 9999)}x{rng.randint(1000, 9999)}px", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        lambda: f"/usr/{word()}/{word()}-{rng.randint(1, 9)}.{rng.choice(['py', 'conf', 'so'])}", lambda: "-".join(word() for _ in range(4)), lambda: f"{word()}: {words(2, 6)}", lambda: f"{word()} = {rng.randint(1, 9999)}", lambda: pick(string.digits, 12, 19),
        lambda: f"{pick(string.ascii_uppercase, 2)}{pick(string.digits, 5, 9)}", lambda: word() * 6, lambda: f"{word()}!!! {word()}$$$ {word()}&&&", lambda: f"({word()}, {word()}) [{rng.randint(1, 99)}]", lambda: f"192.168.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
        lambda: f"\"{words(1, 4)}\" {rng.choice(['said', 'meint', 'dit'])} {word().title()}", lambda: f"{rng.randint(1, 99)}.{rng.randint(100, 999)}.{rng.randint(100, 999)}-{rng.randint(0, 9)}", lambda: "=" * rng.randint(3, 40), lambda: f"+{rng.randint(1, 99)} ({rng.randint(10, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}", lambda: f"{word()}={word()};", lambda: f"{rng.randint(1, 400)} {word()}, {rng.randint(1, 400)}%",
    ]
    talk = ["the key to {0} is {1}", "your password must be {0} and {1}", "a token of {0}: {1}", "keys, {0} and {1}.", "the secret {0} of {1}", "private {0}, {1}", "press any key: {0}", "Key {0}: {1}", "pass the {0} to {1}", "login is {0}", "the author is {0} {1}", "authentication by {0}, see {1}", "password: {0} {1} {0}", "token = {0}"]
    out = []
    for _ in range(count):
        text, spans = "", []

        def put(lead: str, value: str, after: str) -> None:
            nonlocal text
            spans.append((len(text) + len(lead), len(text) + len(lead) + len(value)))
            text += lead + value + after

        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            kind = rng.randrange(20)
            text += words(0, 6) + rng.choice([" ", "\n", ". ", ", "]) if rng.random() < 0.8 else ""
            if kind < 7:
                lead = rng.choice(names) + rng.choice(leads)
                put(lead, rng.choice(secrets_)(), '"' if '"' in lead[-2:] else "")
            elif kind == 7:
                put(rng.choice(["Authorization: Bearer ", "Bearer ", "Authorization: Basic ", "auth: Token "]), rng.choice([secrets_[0], secrets_[1], secrets_[3], secrets_[6]])(), "")
            elif kind == 8:
                put(f"{rng.choice(['postgres', 'mysql', 'amqp', 'https'])}://{word()}:", password(), f"@{word()}.example.com:{rng.randint(80, 9999)}/{word()}")
            elif kind == 9:
                put(rng.choice(["-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\n"]), "\n".join(pick(any64, 64) for _ in range(rng.randint(2, 5))) + "\n" + pick(any64, 20, 60) + rng.choice(["", "="]), rng.choice(["\n-----END RSA PRIVATE KEY-----", "\n-----END PRIVATE KEY-----"]))
            elif kind == 10:
                put("", rng.choice([secrets_[2], secrets_[4], secrets_[5], secrets_[6]])(), "")
            elif kind == 11:
                put(rng.choice(['passphrase = "', 'passphrase: "', "pass phrase '"]), " ".join(pick(low, 4, 8) for _ in range(4)), rng.choice(['"', "'"]))
            elif kind < 14:
                text += rng.choice(talk).format(word(), words(1, 3))
            else:
                text += rng.choice(harmless)()
            text += rng.choice(["", "", "."]) + rng.choice([" ", "\n"]) + words(0, 5) + rng.choice([" ", "\n", ". "])
        out.append((text, spans))
    return out


def train(texts: list[str], *, lines: int = 3000, rounds: int = 80, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> SecretField:
    """Fit on made-up texts and on texts labelled by the base patterns, all tokens of them.

    The patterns don't know all secrets: what stands behind a keyword on a line of a given text and is no plain word, and which they
    don't match, counts neither for nor against.
    """
    examples = _made_up(lines, seed)
    made = len(examples)
    for text in texts:
        spans = []
        for a, kind, b in base_spans(text):
            m = ASSIGN.match(text, a) if kind == 0 else None
            spans.append((m.start(2), b) if m else (a, b))
        examples.append((text, spans))
    table = _Tokens(most=1 << 20)
    texts_ = [text.encode("utf-8", "replace") for text, _ in examples]
    raw, doc, begin, length, h, gap = find_tokens(texts_)
    gold = np.full(len(begin), _OUT)
    base = np.cumsum([0, *(len(t) + 1 for t in texts_)])
    for i, (text, spans) in enumerate(examples):
        for a, b in spans:
            a, b = (int(base[i]) + len(text[:x].encode("utf-8", "replace")) for x in (a, b))
            inside = np.arange(np.searchsorted(begin + length, a, side="right"), np.searchsorted(begin, b))
            gold[inside[1:]] = _IN
            gold[inside[:1]] = np.where(gold[inside[:1]] == _OUT, _BEGIN, gold[inside[:1]])
    n = len(gold)
    hops = np.zeros((3, 3))
    sizes = (*_LOOKS, *_SIZES, *(size * _C for size in _FILE_SIZES))
    held = [np.zeros((size, 3)) for size in sizes]
    if n:
        row = table.rows(raw, begin, length, h)
        kind = table.kind[row]
        codes = [*context_codes(kind, gap, doc), *(code[doc] * _C + kind for code in file_codes(kind, doc, len(texts_)))]
        unknown = (doc >= made) & (gold == _OUT) & (codes[4] >= _C) & np.isin(kind, (4, _MIXED, _LONG, 12, 15))
        truth, fixed = np.eye(3)[gold], np.zeros((n, 3))
        start = np.r_[True, doc[1:] != doc[:-1]]
        fixed[start, _IN] = _NEVER
        pairs = np.bincount((gold[:-1] * 3 + gold[1:])[~start[1:]], minlength=9).reshape(3, 3).astype(float)
        sums = lambda where, g, size: np.stack([np.bincount(where, g[:, y], minlength=size) for y in range(3)], 1)
        squares, square_hops = [np.full_like(w, 1e-8) for w in held], np.full_like(hops, 1e-8)
        k = len(_LOOKS)
        for _ in range(rounds):
            scores = fixed + sum(w[table.values[:, i]] for i, w in enumerate(held[:k]))[row]
            for w, code in zip(held[k:], codes):
                scores += w[code]
            allowed = hops.copy()
            allowed[_OUT, _IN] = _NEVER
            p, joint = forward_backward(scores, start, allowed, pairs=True)
            g = truth - p
            g[unknown] = 0.0
            by_token = sums(row, g, len(table.values))
            grads = [*(sums(table.values[:, i], by_token, size) for i, size in enumerate(_LOOKS)), *(sums(code, g, size) for code, size in zip(codes, sizes[k:]))]
            for w, s, grad in zip(held, squares, grads):
                grad = grad / n - decay * w
                s += grad**2
                w += rate * grad / np.sqrt(s)
            grad = (pairs - joint) / n - decay * hops
            square_hops += grad**2
            hops += rate * grad / np.sqrt(square_hops)
    hops[_OUT, _IN] = _NEVER
    held = [w.astype(np.float32) for w in held]
    a, b = len(_LOOKS), len(_LOOKS) + len(_SIZES)
    return SecretField(held[:a], held[a:b], held[b:], hops)


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most_docs: int = 200, most_bytes: int = 1 << 20, **options) -> SecretField:
    """Train with at most ``most_docs`` texts and ``most_bytes`` bytes, those with the smallest hashes of key and text (texts longer than that apart); no rows are fine too.

    This bounded sample is the one place where not all rows are read; ``scan_secrets`` reads every text.
    """
    rows = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string")).alias("h"), F.col(text).cast("string").alias("t"))
    rows = rows.filter(F.col("t").isNotNull() & (F.octet_length("t") <= most_bytes))
    hashes = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(most_docs).collect()]
    if not hashes:
        return train([], **options)
    room = most_bytes
    texts = []
    few = rows.filter((F.col("h") <= hashes[-1]) & F.col("h").isin(hashes)).dropDuplicates(["h"]).orderBy("h").collect()
    for r in few:
        room -= len(r["t"].encode("utf-8", "replace"))
        if room >= 0:
            texts.append(r["t"])
    return train(texts, **options)


def scan_secrets(docs: DataFrame, field: SecretField | None, *, text: str = "text", redact: str | None = None) -> DataFrame:
    """The rows of ``docs`` plus n_assign, n_access, n_hex, base_sha256, n_crf and spans.

    Spans are ``kind:start:end`` by start, then kind, joined with commas; base_sha256 digests those of the fixed
    patterns.  The field's spans (kind crf) are added where they overlap none of these.  Null and empty texts
    have no spans.  With ``redact`` the text's spans are replaced by it (overlapping ones together) and the span columns left out; null stays null.
    Input columns with one of the new names are replaced; repeated rows stay repeated.
    """
    new = ["n_assign", "n_access", "n_hex", "base_sha256", "n_crf", "spans"]
    body = docs.drop(*new) if redact is None else docs
    names = body.columns
    where = names.index(text)
    shared = body.sparkSession.sparkContext.broadcast(None if field is None else (field.looks, field.contexts, field.files, field.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared.value is None else SecretField(*shared.value)
        table = None if own is None else _Tokens(own.own)
        for batch in slices(batches, text, 1 << 19):
            rows = []
            nulls = batch.column(where).is_null().to_pylist()
            texts = [raw.decode("utf-8", "replace") for raw in byte_rows(batch.column(where))]
            raws = [t.encode() for t in texts]
            tagged = iter([[]] * len(raws)) if own is None else own.spans_of(raws, table)
            for raw, t, null, found in zip(raws, texts, nulls, tagged):
                base = base_spans(t, raw)
                more = [(a, 3, b) for a, b in found if not any(a < e and s < b for s, _, e in base)]
                if redact is not None:
                    parts, end = [], 0
                    for a, _, b in sorted(base + more):
                        if a >= end:
                            parts += [t[end:a], redact]
                        end = max(end, b)
                    rows.append(None if null else "".join(parts) + t[end:])
                    continue
                show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
                rows.append((*(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(show(base).encode()).hexdigest(), len(more), show(base + more)))
            if redact is not None:
                columns = [*batch.columns]
                columns[where] = pa.array(rows, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)
            else:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [*names, *new])

    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.StringType()]
    fields = [*body.schema.fields] + ([T.StructField(n, t) for n, t in zip(new, kinds)] if redact is None else [])
    return body.mapInArrow(lean(run), T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]))
