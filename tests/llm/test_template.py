"""Entries of template words."""

import xxhash

from fellgrid.llm import decontam

#: Odd words: marks on either side or inside, numbers, units, names, capitals without small letters, marks alone.
WORDS = "Haus haus. HAUS, the The. what What? WHAT! ñandú Ñandú; él Él A a. I 12 12. $3,50 3rd 5kg 5KG, one One. ONE! USA USA, UNESCO U.S. McLean O'Brien \"Tom\" (Tom) Tom's x=y ... -- ¿Qué Qué? 100% % km km. KM 10km/h «mot» ß Straße 𝐀b ǅu Ⅷ a_b _a_ e-mail , « \x1e 日本 日本。 ٣ á İst".split(" ")


def entry_of(word):
    """A word's entry by the rules for one word."""
    bare = decontam._EDGE.sub("", word)
    low, kind = bare.lower(), decontam._PLAIN
    glued = decontam._GLUED.fullmatch(low)
    if low in decontam.NUMBER_WORDS or decontam._NUMBER.fullmatch(bare) or (glued and glued[2] in decontam.UNITS):
        kind = decontam._NUM
    elif len(bare) > 1 and bare[0].isupper():
        if low in decontam.STARTERS:
            kind = decontam._STARTER
        elif bare[-1].islower():
            kind = decontam._NAME
        elif len(bare) <= 5 and bare.isupper() and bare.isalpha():
            kind = decontam._CAPITALS
    return xxhash.xxh3_64_intdigest(low.encode()) | 1 if low else 0, kind, low in decontam.UNITS, word[-1:] in ".!?:\x1e", word.endswith(bare), low


def test_template_words_are_learnt_together(monkeypatch):
    made = decontam.Template()
    made.of([" ".join(WORDS[:20]).encode(), " ".join(WORDS[10:]).encode()])  # the second has known words and new ones
    made.of([" ".join(WORDS).encode() + b" later"])
    for word in [*WORDS, "later"]:
        n = made[word.encode()]
        assert (int(made.hash[n]), made.kind[n], made.unit[n], made.stop[n], made.open[n], made.value[n]) == entry_of(word), word
    assert len(made) == len({*WORDS, "later"}) == len(made.value) and not made.new
    # words of letters, marks after them, take no regular expression
    real, calls = decontam._EDGE, []

    class Edge:
        def sub(self, new, word):
            calls.append(word)
            return real.sub(new, word)

    monkeypatch.setattr(decontam, "_EDGE", Edge())
    decontam.Template().of(["Das Haus, the house. La maison! Ñandú? (no) 12".encode()])
    assert sorted(calls) == ["(no)", "12"]
