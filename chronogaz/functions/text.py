"""Text Column expressions: four different folds, edits, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronogaz.functions.normal import nfc

# Accented Latin letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def search_fold(x: Column) -> Column:
    """Without the accents above, lower case; every letter keeps its place, so that a hit can be marked in the text."""
    return F.lower(F.translate(x, ACCENTED, PLAIN))


def ascii_fold(x: Column) -> Column:
    """Lower case; anything but a-z and 0-9 becomes one space."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def key_fold(x: Column) -> Column:
    """Composed, trimmed, lower case."""
    return F.lower(F.trim(nfc(x)))


def space_fold(x: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def one_edit(a: Column, b: Column) -> Column:
    """Equal, one insertion, deletion or change, or one swap of any two places."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i, j = F.get(places, F.lit(0)), F.get(places, F.lit(1))
    at = lambda s, k: F.substr(s, k, F.lit(1))
    swapped = (F.length(a) == F.length(b)) & (F.size(places) == 2) & (at(a, i) == at(b, j)) & (at(a, j) == at(b, i))
    return (F.levenshtein(a, b, 1) >= 0) | F.coalesce(swapped, F.lit(False))


def year_text(y: Column) -> Column:
    """44 BC, AD 50."""
    return F.when(y < 0, F.concat(F.abs(y).cast("string"), F.lit(" BC"))).otherwise(F.concat(F.lit("AD "), y.cast("string")))


def range_text(a: Column, b: Column) -> Column:
    """Both ends, one of them, or neither."""
    return (
        F.when(a.isNull() & b.isNull(), F.lit(""))
        .when(b.isNull(), F.concat(F.lit("from "), year_text(a)))
        .when(a.isNull(), F.concat(F.lit("until "), year_text(b)))
        .otherwise(F.concat(year_text(a), F.lit(" to "), year_text(b)))
    )


def name_variants(name: Column, connectors: tuple[str, ...]) -> Column:
    """The name, and if it opens with a connector word, with that word in both cases."""
    opens = F.lower(F.split_part(name, F.lit(" "), F.lit(1))).isin(*connectors) & F.contains(name, F.lit(" "))
    rest = F.substr(name, F.lit(2))
    both = F.array(name, F.concat(F.upper(F.substr(name, F.lit(1), F.lit(1))), rest), F.concat(F.lower(F.substr(name, F.lit(1), F.lit(1))), rest))
    return F.array_distinct(F.when(opens, both).otherwise(F.array(name)))


def country_label(name: Column, countries: Column) -> Column:
    """Distinct countries that the name does not hold as whole words, in their order: "A, B and C"; none gives null."""
    own = F.filter(F.array_distinct(countries), lambda c: ~F.regexp_like(name, F.concat(F.lit("(^|[^A-Za-z])"), c, F.lit("([^A-Za-z]|$)"))))
    head = F.array_join(F.slice(own, F.lit(1), F.size(own) - 1), ", ")
    return F.when(F.size(own) == 1, F.get(own, F.lit(0))).when(F.size(own) > 1, F.concat(head, F.lit(" and "), F.element_at(own, -1)))


def media_verdict(url: Column, page: Column) -> Column:
    """Whether a media URL lies in the folders that its decoded file name hashes to, and its page names the same file."""
    part = lambda i: F.element_at(F.split(url, "/"), i)
    file = F.try_url_decode(part(-1))
    h = F.md5(file.cast("binary"))
    named = F.try_url_decode(F.regexp_extract(page, "File:(.*)$", 1))
    folders = (F.substring(h, 1, 1) == part(-3)) & (F.substring(h, 1, 2) == part(-2))
    return F.when(file.isNull() | named.isNull(), "bad escape").when(~folders, "hash folders").when(file != named, "page names another file").otherwise("ok")
