"""Mentions of names of any length in texts.

A text's words, with the gap before each (runs of white space as one space), stay in its row: texts are read once, in Arrow
batches, against the checksums of all names, and only what may be a name leaves them, to be joined to the names themselves.
Names that no text holds are neither shuffled nor folded into the dictionary.
Names begin and end with a letter or a digit; others have no mentions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogaz.functions import text as X
from chronogaz.functions.normal import may_compose
from chronogaz.operators.graph import checkpointed

# Words that may be lower-case in a name; what may stand between a word and its neighbour; countries.
CONNECTORS = ("the", "of", "on", "in", "and", "beyond")
OPENING, CLOSING = "\"“‘(\\[{", "\"”’')\\]}"
COUNTRIES = ("Türkiye", "Greece", "Italy", "Israel", "Jordan", "Lebanon", "Syria", "Egypt", "Cyprus", "Malta", "Iraq", "Iran", "Albania", "North Macedonia", "Libya", "West Bank", "Golan Heights")
LETTERS = "A-Za-z0-9À-ÖØ-öø-ÿ"
#: Bits of the table of checksums; with more names than it tells apart, more runs of words go to the join, and none is lost.
BITS = 1 << 26
#: Texts that are in Python at once, and words whose checksums a task remembers.
ROWS, WORDS = 64, 1 << 20


def _capital(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return first != F.lower(first)


def _split(text: Column) -> Column:
    """Array of words, each after the gap before it."""
    return F.regexp_extract_all(text, F.lit(f"[^{LETTERS}]*[{LETTERS}]+"), F.lit(0))


def _gap(piece: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(piece, f"^[^{LETTERS}]*", 0), r"\s+", " ")


def _raw(piece: Column) -> Column:
    return F.regexp_extract(piece, f"^[^{LETTERS}]*", 0)


def _word(piece: Column) -> Column:
    return F.regexp_extract(piece, f"[{LETTERS}]+$", 0)


def openings(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, text) and (name) -> (key, pos from 1, before, run): each word at which a name may begin, as one does with it; before:
    the word before it (null at the start), run: it and the words that follow, two more than the longest name has.

    A word is (raw gap, gap, word, cap, head_cap, head_starts): cap tells a capital; the head is the first piece of a word with
    apostrophes, head_starts whether it opens a sentence. A text's words stay in its row: only openings leave it, and the
    names' first words, a vocabulary, go to all tasks."""
    piece = _split(F.col("name"))
    depth = (names.agg(F.max(F.size(piece))).first()[0] or 0) + 2
    first = F.broadcast(names.select(F.xxhash64(_word(F.get(piece, F.lit(0)))).alias("_first")).where("_first is not null").distinct())
    opens = lambda x, at_start: F.regexp_like(_raw(x), F.lit(rf"[.!?][{CLOSING}]*\s*$")) | (at_start & F.regexp_like(_raw(x), F.lit(rf"^[{CLOSING}]*\s*$")))
    head = lambda x: ~_raw(x).isin("'", "’")
    # after a letter that is the last, but for one before an apostrophe and a letter: a head and what hangs on it stay together
    whole = F.split(F.coalesce(F.col(text), F.lit("")), f"(?<=[{LETTERS}])(?![{LETTERS}])(?!['’][{LETTERS}])")
    groups = F.transform(whole, lambda g, j: F.struct(_split(g).alias("p"), (j == 0).alias("s")))
    hung = F.flatten(F.transform("_g", lambda g: F.transform(g["p"], lambda x: F.struct(x.alias("x"), F.get(g["p"], F.lit(0)).alias("h"), g["s"].alias("s")))))
    # texts are dealt out first, as a file of few is one task's
    dealt = df.select(key, text).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.select(key, groups.alias("_g")).select(key, hung.alias("_p")).select(key, "_p", F.posexplode("_p").alias("_i", "_x"))
    rows = rows.join(first, F.xxhash64(_word(F.col("_x.x"))) == F.col("_first"), "left_semi")
    full = lambda w: F.struct(_raw(w["x"]).alias("raw"), _gap(w["x"]).alias("gap"), _word(w["x"]).alias("word"), _capital(_word(w["x"])).alias("cap"), F.when(head(w["h"]), _capital(_word(w["h"]))).alias("head_cap"), F.when(head(w["h"]), opens(w["h"], w["s"])).alias("head_starts"))
    before = F.when(F.col("_i") > 0, full(F.get("_p", F.col("_i") - 1)))
    return rows.select(key, (F.col("_i") + 1).alias("pos"), before.alias("before"), F.transform(F.slice("_p", F.col("_i") + 1, F.lit(depth)), full).alias("run"))


def _forms(names: DataFrame) -> DataFrame:
    """(place, name) -> the same: each name as it may stand in a text; its white space is single. A name may come more than once."""
    clean = names.select("place", F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name")).where("name <> ''")
    return clean.select("place", F.explode(X.name_variants(F.col("name"), CONNECTORS)).alias("name"))


def variants(names: DataFrame) -> DataFrame:
    """(place, name) -> (place, name, norm): each name as it may stand in a text, and folded; its white space is single."""
    return _forms(names).withColumn("norm", X.key_fold(F.col("name"))).distinct()


def dictionary(names: DataFrame, countries: tuple[str, ...] = COUNTRIES) -> DataFrame:
    """(place, name) -> (place, name, norm): variants of names that one place alone has, that are no country's, and in which
    no word but a connector is lower-case."""
    return _alone(variants(names), countries)


def _alone(rows: DataFrame, countries: tuple[str, ...] = COUNTRIES) -> DataFrame:
    """The dictionary of variants: a part of them will do that holds all variants of each norm in it."""
    small = F.filter(F.regexp_extract_all("name", F.lit(r"\p{L}+(?:['’]\p{L}+)?"), F.lit(0)), lambda w: (w == F.lower(w)) & ~F.lower(w).isin(*CONNECTORS))
    rows = rows.where((F.size(small) == 0) & ~F.col("norm").isin(*[c.lower() for c in countries]))
    alone = rows.groupBy("norm").agg(F.min("place").alias("place"), F.max("place").alias("_z"), F.collect_set("name").alias("names")).where("place = _z")
    return alone.select("place", F.explode("names").alias("name"), "norm")


def _whole() -> Column:
    """Names that begin and end with a letter."""
    return F.regexp_like("name", F.lit(f"^[{LETTERS}]")) & F.regexp_like("name", F.lit(f"[{LETTERS}]$"))


def matches(opened: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Openings and (name) -> (key, pos, n, name): every place where a name's words stand, overlaps too."""
    known = names.where(_whole()).select(F.regexp_replace("name", r"\s+", " ").alias("name")).distinct()
    depth = names.agg(F.max(F.size(_split(F.col("name"))))).first()[0] or 0
    # the words up to each of those that follow, for as many words as names have
    upto = lambda d: F.concat(F.get("run", F.lit(0))["word"], F.array_join(F.flatten(F.transform(F.slice("run", F.lit(2), d - 1), lambda w: F.array(w["gap"], w["word"]))), ""))
    sizes = F.sequence(F.lit(1), F.least(F.lit(max(depth, 1)), F.size("run")))
    runs = opened.select(key, "pos", F.explode(F.transform(sizes, lambda d: F.struct(d.alias("n"), upto(d).alias("name")))).alias("r"))
    return runs.select(key, "pos", "r.n", "r.name").join(known, "name", "left_semi").select(key, "pos", "n", "name")


_SPLIT, _SPACES = re.compile(f"([{LETTERS}]+)"), re.compile(r"[ \t\n\x0b\f\r]+")
_ENDS, _STARTS = re.compile(rf"[.!?][{CLOSING}]*[ \t\n\x0b\f\r]*\Z"), re.compile(rf"[{CLOSING}]*[ \t\n\x0b\f\r]*")
_BEFORE, _AFTER = re.compile(rf"[.{CLOSING}]*[ -]"), re.compile(rf"[ -][{OPENING}]*")
_END = zlib.crc32(b"\n")


def checksums(names: DataFrame) -> tuple[np.ndarray, int]:
    """(name), white space single -> BITS bits and the words of the longest name. Bits are set at the checksums of each name,
    and of its first word and its first two after a line's end, which no name has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, depth = np.zeros(BITS // 8, np.uint8), 0
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                parts = _SPLIT.split(name or "")
                if len(parts) > 1 and not parts[0] and not parts[-1]:
                    depth = max(depth, len(parts) // 2)
                    sums += [zlib.crc32(name.encode()), zlib.crc32(parts[1].encode(), _END), zlib.crc32("".join(parts[1:4]).encode(), _END)]
            c = np.array(sums, np.int64) % BITS
            np.bitwise_or.at(table, c >> 3, (1 << (c & 7)).astype(np.uint8))
        words = table.view("<i8")
        at = np.flatnonzero(words)
        for i in np.array_split(at, len(at) // 10_000 + 1):
            yield pa.record_batch([pa.array(i, pa.int64()), pa.array(words[i], pa.int64()), pa.array(np.full(len(i), depth), pa.int64())], ["i", "w", "n"])

    rows = names.select(F.make_valid_utf8("name").alias("name")).mapInArrow(run, "i long, w long, n long")
    words = rows.groupBy("i").agg(F.bit_or("w").alias("w"), F.max("n").alias("n")).toArrow()
    table = np.zeros(BITS // 64, "<i8")
    table[words["i"].to_numpy()] = words["w"].to_numpy()
    return table.view(np.uint8), max(words["n"].to_pylist(), default=0)


def _capitalised(word: str) -> bool:
    return word[0] != word[0].lower()


def _alone_at(raws: list[str], words: list[str], i: int, n: int) -> bool:
    """Whether n words from i on are no part of a longer capitalised name, and not followed by "of" and a capitalised word."""
    if i and _BEFORE.fullmatch(raws[i]):
        h = i - 1  # the head: the first piece of a word with apostrophes
        while h >= 0 and raws[h] in ("'", "’"):
            h -= 1
        if h >= 0 and _capitalised(words[h]) and not (_ENDS.search(raws[h]) or (h == 0 and _STARTS.fullmatch(raws[h]))):
            return False
    z = i + n
    if z < len(words) and _capitalised(words[z]) and _AFTER.fullmatch(raws[z]):
        return False
    return not (z + 1 < len(words) and raws[z] == raws[z + 1] == " " and words[z] == "of" and _capitalised(words[z + 1]))


def spots(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, text) and (name) -> (key, pos from 1, n, name, alone): every run of words that has a name's checksum, so all names
    that stand in the text and a few runs that are none; alone: it is no part of a longer name."""
    table, depth = checksums(names)
    shared = texts.sparkSession.sparkContext.broadcast(table.tobytes())

    def found(text: str, bits: bytes, seen: set[str], opens: set[str]):
        has = lambda c: bits[c % BITS >> 3] >> (c & 7) & 1
        parts = _SPLIT.split(text)
        raws, words = parts[0:-1:2], parts[1::2]
        if len(seen) > WORDS:
            seen.clear(), opens.clear()
        fresh = set(words) - seen
        seen |= fresh
        opens.update(w for w in fresh if has(zlib.crc32(w.encode(), _END)))
        for i in [i for i, w in enumerate(words) if w in opens]:
            name, c = words[i], zlib.crc32(words[i].encode())
            for n in range(1, min(depth, len(words) - i) + 1):
                if n > 1:
                    gap = raws[i + n - 1]
                    piece = (gap if gap == " " else _SPACES.sub(" ", gap)) + words[i + n - 1]
                    name, c = name + piece, zlib.crc32(piece.encode(), c)
                if has(c):
                    yield i + 1, n, name, _alone_at(raws, words, i, n)
                if n == 2 and not has(zlib.crc32(name.encode(), _END)):
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen, opens = shared.value, set(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [(j, *r) for j, t in enumerate(part.column(1).to_pylist()) if t for r in found(t, bits, seen, opens)]
                if rows:
                    j, pos, n, name, alone = zip(*rows)
                    yield pa.record_batch([part.column(0).take(pa.array(j)), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(name, pa.string()), pa.array(alone, pa.bool_())], [key, "pos", "n", "name", "alone"])

    # texts are dealt out first, as a file of few is one task's; Python cannot read broken UTF-8
    dealt = texts.select(key, F.make_valid_utf8(F.col(text)).alias(text)).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(texts.dtypes)[key]
    return dealt.mapInArrow(run, f"`{key}` {kind}, pos int, n int, name string, alone boolean")


def mentions(texts: DataFrame, own: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """texts: (key, text); own: (key, place) the place a text is about; names: (place, name) -> (key, place, pos, n, name).

    Left out are mentions of the text's own place, of names that stand inside one of its names, those that overlap its names
    where they stand in the text, parts of longer capitalised names, and those followed by "of" and a capitalised word."""
    # names are dealt out, as a file of few is one task's, and read again for each use
    forms = checkpointed(_forms(names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    own = checkpointed(own.select(F.col(key).alias("_o"), F.col("place").alias("_own")))
    hits = checkpointed(spots(texts, key, text, forms))
    # names that share a norm with one in a text; whether a name is one place's alone shows in them
    held = checkpointed(hits.select("name").distinct().select(X.key_fold(F.col("name")).alias("norm")).distinct())
    # only what may be held or is not folded by case alone goes on to be folded
    plain, odd = F.lower(F.trim("name")), may_compose(F.col("name"))
    likely = forms.withColumn("_l", F.when(odd, F.col("name")).otherwise(plain)).join(held.withColumnRenamed("norm", "_h"), F.col("_l") == F.col("_h"), "left").where(odd | F.col("_h").isNotNull())
    every = checkpointed(likely.select("place", "name", X.key_fold(F.col("name")).alias("norm")).join(held, "norm", "left_semi").distinct())
    spelled = checkpointed(_alone(every))
    named = hits.join(own, F.col(key) == F.col("_o"), "left").drop("_o")
    # its own names hide what they cover: the earlier first, of those that start together the longer
    mine = named.join(every.select(F.col("place").alias("_own"), "name"), ["_own", "name"], "left_semi").select(key, F.col("pos").alias("at"), "n", F.length("name").alias("long"))
    longest = mine.groupBy(key, "at").agg(F.max(F.struct("long", "n")).alias("m")).select(key, "at", "m.n")
    spans = F.array_sort(F.collect_list(F.struct("at", "n")))
    free = lambda acc, x: F.when((F.size(acc) == 0) | (x["at"] >= F.element_at(acc, -1)["at"] + F.element_at(acc, -1)["n"]), F.concat(acc, F.array(x))).otherwise(acc)
    masks = longest.groupBy(key).agg(spans.alias("s"))
    masks = masks.select(F.col(key).alias("_k"), F.aggregate("s", F.slice("s", F.lit(1), F.lit(0)), free).alias("masks"))
    # names inside the own place's names, as whole words
    about = checkpointed(forms.join(own.select(F.col("_own").alias("place")).distinct(), "place", "left_semi").distinct())
    inside = matches(openings(about.select("name").distinct().select(F.col("name").alias("_n")), "_n", "_n", spelled.select("name")), spelled.select("name"), "_n").select("_n", "name").distinct()
    blocked = about.join(inside, about["name"] == inside["_n"]).select(F.col("place").alias("_own"), inside["name"].alias("name")).join(spelled.select("name", "norm"), "name").select("_own", "norm").distinct()
    rows = named.where("alone").join(spelled, "name").where("_own is null or place <> _own")
    rows = rows.join(checkpointed(blocked), ["_own", "norm"], "left_anti").join(masks, F.col(key) == F.col("_k"), "left")
    over = F.exists("masks", lambda m: (m["at"] < F.col("pos") + F.col("n")) & (F.col("pos") < m["at"] + m["n"]))
    return rows.where(~F.coalesce(over, F.lit(False))).select(key, "place", "pos", "n", "name")


def chosen(rows: DataFrame, key: str) -> DataFrame:
    """(key, place, pos, n, name) -> one mention for each place of a text: in order of place in the text, the longer name
    first, none that overlaps one taken before."""
    order = F.array_sort(F.collect_list(F.struct("pos", (-F.length("name")).alias("long"), "place", "n")))
    listed = rows.groupBy(key).agg(order.alias("m"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        free = (F.size(acc) == 0) | (x["pos"] >= last["pos"] + last["n"])
        return F.when(free & ~F.exists(acc, lambda y: y["place"] == x["place"]), F.concat(acc, F.array(x))).otherwise(acc)

    kept = F.aggregate("m", F.slice("m", F.lit(1), F.lit(0)), step)
    return listed.select(key, F.explode(kept).alias("c")).select(key, "c.place", "c.pos", "c.n")
