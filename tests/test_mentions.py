"""Mentions against plain searches of the texts, name by name."""

import random
import re

from pyspark.sql import functions as F

from chronogaz.operators import mentions as M

LETTER = re.compile(f"[{M.LETTERS}]")
CLOSE, OPEN = set("\"”’')]}"), set("\"“‘([{")


def plain_variants(name):
    name = " ".join(name.split())
    first, _, rest = name.partition(" ")
    if first.lower() in M.CONNECTORS and rest:
        return list(dict.fromkeys([name, name[0].upper() + name[1:], name[0].lower() + name[1:]]))
    return [name] if name else []


def allowed(name):
    return all(w != w.lower() or w.lower() in M.CONNECTORS for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", name))


def places_of(text, name):
    """(start, end) of whole words."""
    pattern = re.compile("(?=(" + re.sub(r"(\\ )+|\s+", r"\\s+", re.escape(name)) + "))")
    out = []
    for m in pattern.finditer(text):
        a, z = m.start(1), m.end(1)
        if not (a and LETTER.match(text[a - 1])) and not (z < len(text) and LETTER.match(text[z])):
            out.append((a, z))
    return out


def capital(word):
    word = word.lstrip("'’\"“‘")
    return bool(word) and word[0] != word[0].lower()


def starts_sentence(text, at):
    i = at - 1
    while i >= 0 and text[i].isspace():
        i -= 1
    while i >= 0 and text[i] in CLOSE:
        i -= 1
    return i < 0 or text[i] in ".!?"


def skipped(text, a, z):
    body = lambda c: bool(LETTER.match(c)) or c in "'’"
    if a and text[a - 1] in " -":
        i = a - 2
        while i >= 0 and (text[i] == "." or text[i] in CLOSE):
            i -= 1
        j = i
        while j >= 0 and body(text[j]):
            j -= 1
        if j < i and capital(text[j + 1 : i + 1]) and not starts_sentence(text, j + 1):
            return True

    def word_at(i):
        j = i
        while j < len(text) and body(text[j]):
            j += 1
        return text[i:j]

    if z < len(text) and text[z] in " -":
        i = z + 1
        while i < len(text) and text[i] in OPEN:
            i += 1
        if capital(word_at(i)):
            return True
    return text[z : z + 4] == " of " and capital(word_at(z + 4))


def plain_mentions(texts, own, names):
    spelled, owners = {}, {}
    for place, name in names:
        if allowed(name):
            for v in plain_variants(name):
                if v.lower() not in {c.lower() for c in M.COUNTRIES}:
                    owners.setdefault(v.lower(), set()).add(place)
                    spelled[v] = place
    spelled = {v: p for v, p in spelled.items() if len(owners[v.lower()]) == 1}
    every = {}
    for place, name in names:
        every.setdefault(place, set()).update(plain_variants(name))
    found = set()
    for key, text in texts:
        place = own.get(key)
        mine = sorted((a, -len(n), z) for n in every.get(place, ()) for a, z in places_of(text, n))
        masks = []
        for a, _, z in mine:
            if all(z <= b or a >= c for b, c in masks):
                masks.append((a, z))
        blocked = {v.lower() for v, p in spelled.items() if p != place and any(places_of(n, v) for n in every.get(place, ()))}
        for v, p in spelled.items():
            if p != place and v.lower() not in blocked:
                found |= {(key, p, a, z) for a, z in places_of(text, v) if all(z <= b or a >= c for b, c in masks) and not skipped(text, a, z)}
    return found


def with_words(text, a, z):
    """A mention's first word and number of words, from its characters."""
    n = lambda t: len(re.findall(f"[{M.LETTERS}]+", t))
    return n(text[:a]) + 1, n(text[a:z])


def case():
    rng = random.Random(6)
    heads, tails = ["Blue", "Old", "Mount", "Sea", "Ur"], ["Hill", "Lake", "Town", "Gate", "Ur"]
    names = [(i, " ".join(rng.sample(heads, rng.randint(1, 2)) + rng.sample(tails, rng.randint(1, 2)))) for i in range(30)]
    names += [(i, f"The {rng.choice(heads)} of {rng.choice(tails)}") for i in range(0, 30, 3)] + [(i, f"{rng.choice(heads)}-{rng.choice(tails)}") for i in range(0, 30, 4)]
    names += [(1, "Egypt"), (2, "north  Hill"), (3, ""), (4, "Ur"), (5, "O'Ur Gate"), (6, "the Sea")]
    glue = [" ", " ", " and ", ". ", ", ", "'s ", " of ", "  ", "-", " (", ") ", "! \"", "\" ", " near ", ".) "]
    texts = [(i, "".join(rng.choice([rng.choice(names)[1], rng.choice(heads), rng.choice(tails), "the", "x"]) + rng.choice(glue) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    own = {i: rng.randrange(30) for i in range(140)}  # some texts are about no place
    return names, texts, own


def test_mentions_and_choice(spark):
    names, texts, own = case()
    want = plain_mentions(texts, own, names)
    text = dict(texts)
    spots = {(k, p, *with_words(text[k], a, z)) for k, p, a, z in want}
    got = M.mentions(spark.createDataFrame([*texts, (999, None)], "doc long, text string"), spark.createDataFrame(list(own.items()), "doc long, place long"), spark.createDataFrame(names, "place long, name string"), "doc", "text")
    rows = got.collect()
    assert {(r.doc, r.place, r.pos, r.n) for r in rows} == spots and len(spots) > 100
    assert any(r.n > 2 for r in rows)
    taken = set()
    for k in text:
        end, seen = 0, set()
        for r in sorted((r for r in rows if r.doc == k), key=lambda r: (r.pos, -len(r.name), r.place)):
            if r.pos >= end and r.place not in seen:
                taken.add((k, r.place, r.pos, r.n))
                end = r.pos + r.n
                seen.add(r.place)
    assert {tuple(r) for r in M.chosen(got, "doc").collect()} == taken


def test_no_names_or_texts(spark):
    names, texts = spark.createDataFrame([(1, "Ur")], "place long, name string"), spark.createDataFrame([(1, "to Ur")], "doc long, text string")
    own = spark.createDataFrame([(1, 2)], "doc long, place long")
    assert M.mentions(texts, own, names, "doc", "text").count() == 1
    assert M.mentions(texts.limit(0), own, names, "doc", "text").count() == 0
    assert M.mentions(texts, own.limit(0), names.limit(0), "doc", "text").count() == 0
    assert M.chosen(M.mentions(texts, own, names.where(F.lit(False)), "doc", "text"), "doc").count() == 0


def test_only_openings_leave_a_text(spark):
    names = spark.createDataFrame([("Old Town",), ("Rome",)], "name string")
    texts = spark.createDataFrame([(1, "We saw many things. 'Old' men left Rome's Old Town " + "and more " * 500), (2, None), (3, "Rome"), (4, "'twas")], "doc long, text string")
    got = {(r.doc, r.pos): r for r in M.openings(texts, "doc", "text", names).collect()}
    assert sorted(got) == [(1, 5), (1, 8), (1, 10), (3, 1)]
    own = got[1, 10]
    assert (own.before.word, own.before.head_cap, own.before.head_starts, own.run[0].gap, len(own.run)) == ("s", True, False, " ", 4)
    assert got[3, 1].before is None and got[3, 1].run[0].head_starts and not got[1, 5].run[0].head_starts is None
    hits = M.matches(M.openings(texts, "doc", "text", names), names, "doc")
    assert {tuple(r) for r in hits.collect()} == {(1, 8, 1, "Rome"), (1, 10, 2, "Old Town"), (3, 1, 1, "Rome")}


def test_a_name_of_two_places_is_left_out_without_a_join(spark, capsys):
    d = M.dictionary(spark.createDataFrame([(1, "The Hill"), (2, "the Hill"), (3, "The Dale"), (3, "the Dale")], "place long, name string"))
    assert {tuple(r) for r in d.collect()} == {(3, "The Dale", "the dale"), (3, "the Dale", "the dale")}
    d.explain()
    assert "Join" not in capsys.readouterr().out


def test_only_what_may_be_a_name_leaves_a_text(spark):
    """And a line's end between words does not make a name a part of a longer one."""
    names = spark.createDataFrame([("The Old Town",), ("Ur",), ("-x",), (None,)], "name string")
    texts = spark.createDataFrame([(1, "the The Old Man " * 500 + "in The Old  Town"), (2, None), (3, "to Great \nUr"), (4, "to Great Ur"), (5, "Ur of Ur"), (6, "-x")], "doc long, text string")
    got = {tuple(r) for r in M.spots(texts, "doc", "text", names).collect()}
    assert got == {(1, 2002, 3, "The Old Town", True), (3, 3, 1, "Ur", True), (4, 3, 1, "Ur", False), (5, 1, 1, "Ur", False), (5, 3, 1, "Ur", True)}
    own, places = spark.createDataFrame([(1, 9)], "doc long, place long"), names.selectExpr("hash(name) as place", "name")
    rows = M.mentions(texts, own, places, "doc", "text").collect()
    assert {(r.doc, r.pos, r.name) for r in rows} == {(1, 2002, "The Old Town"), (3, 3, "Ur"), (5, 3, "Ur")}


def test_names_that_compose_are_one_places_or_none(spark):
    """A name with a mark and one with its letter put together are one name."""
    names = spark.createDataFrame([(1, "Sete\u0301"), (2, "Set\u00e9"), (3, "B\u00e2le"), (4, "Ur")], "place long, name string")
    texts = spark.createDataFrame([(1, "to Set\u00e9, B\u00e2le"), (2, "to Ur")], "doc long, text string")
    own = spark.createDataFrame([(1, 9)], "doc long, place long")
    assert {(r.doc, r.place) for r in M.mentions(texts, own, names, "doc", "text").collect()} == {(1, 3), (2, 4)}
