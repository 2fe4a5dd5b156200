"""Canonical forms against the standard library's."""

import hashlib
import random
import time
import unicodedata

from pyspark.sql import functions as F

from chronogaz.functions import normal


def test_every_code_point_and_random_texts(spark):
    rng = random.Random(5)
    plain = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    odd = [c for c in plain if unicodedata.combining(c) or unicodedata.normalize("NFD", c) != c]
    marks = [c for c in plain if unicodedata.combining(c)]
    hangul = [chr(i) for i in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), 0xAC00, 0xAC01, 0xAC1C)]
    indic = ["ে", "া", "ৗ", "ெ", "ா", "େ", "ା", "ୖ", "\U000110a5", "\U000110ba"]
    latin = [*"aeiousƷéấ΅", "́", "̂", "̣", "ͅ", "̈", "̆"]
    texts = [" ".join(odd[i : i + 50]) for i in range(0, len(odd), 50)] + ["".join(plain[i : i + 1000]) for i in range(0, len(plain), 1000)]
    for pool, n in ((latin, 400), (hangul, 200), (indic, 100), (marks, 50), (odd + ["a", "e", " "] * 300, 200)):
        texts += ["".join(rng.choices(pool, k=rng.randrange(1, 12))) for _ in range(n)]
    texts += ["", "plain", "é" * 5000, "a" + "̣́" * 300, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r.i: r for r in df.select("i", normal.nfd(F.col("t")).alias("d"), normal.nfc(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        want = (None, None) if t is None else (unicodedata.normalize("NFD", t), unicodedata.normalize("NFC", t))
        assert (got[i].d, got[i].c) == want, [hex(ord(c)) for c in t[:40]]


def test_texts_full_of_marks_take_seconds(spark):
    text = "e\u0301 a\u0308\u0323c " * 600_000  # of 6 MB, a mark at every second letter
    df = spark.createDataFrame([(text,)], "t string").select(normal.nfc(F.col("t")).alias("c"))
    began = time.time()
    got = df.select(F.md5(F.encode("c", "UTF-8")).alias("h"), F.octet_length("c").alias("n")).first()
    took, want = time.time() - began, unicodedata.normalize("NFC", text).encode()
    assert (got.h, got.n) == (hashlib.md5(want).hexdigest(), len(want)) and took < 10


def test_broken_utf8_is_replaced(spark):
    got = spark.sql("select cast(x'6165CC81FF' as string) as t").select(normal.nfc(F.col("t")).alias("c"), normal.nfd(F.col("t")).alias("d")).first()
    assert tuple(got) == ("a\u00e9\ufffd", "ae\u0301\ufffd")
