"""Canonical forms of text (NFD and NFC) as Column expressions.

Spark has no function for them, so the standard library's is applied to Arrow batches inside the tasks; its time grows with
a text's length. Texts of letters that neither form can change do not leave the JVM.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are in Python at once, as letters take up to four bytes there.
ROWS = 64
# Below these letters nothing can change: the first with parts, and the first mark (nothing below it is put together).
_FIRST_APART, _FIRST_MARK = "\\x{c0}", "\\x{300}"


def _reaches(x: Column, first: str) -> Column:
    return F.regexp_like(x, F.lit(f"[{first}-\\x{{10ffff}}]"))


def may_compose(x: Column) -> Column:
    """Whether NFC may change it; all other texts are their own composed form."""
    return _reaches(x, _FIRST_MARK)


def _form(x: Column, form: str, first: str) -> Column:
    def normalized(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(i, ROWS).to_pylist() for i in range(0, len(texts), ROWS))
        return pa.concat_arrays([pa.array([t if t is None else unicodedata.normalize(form, t) for t in p], pa.string()) for p in parts] or [pa.array([], pa.string())])

    changes = _reaches(x, first)
    # null where nothing changes; Python cannot read broken UTF-8, so it gets U+FFFD for that, as Spark's regexes do
    made = F.arrow_udf(normalized, "string")(F.when(changes, F.make_valid_utf8(x)))
    return F.when(changes, made).otherwise(x)


def nfd(x: Column) -> Column:
    """Letters taken apart into base letters and marks, marks in canonical order."""
    return _form(x, "NFD", _FIRST_APART)


def nfc(x: Column) -> Column:
    """The canonical form with letters put together."""
    return _form(x, "NFC", _FIRST_MARK)


def without_marks(x: Column) -> Column:
    """Decomposed and without marks."""
    return F.regexp_replace(nfd(x), r"\p{M}+", "")


def folded(x: Column) -> Column:
    """Without marks, lower case: the form that searches compare."""
    return F.lower(without_marks(x))
