"""Ranked name search and dictionary mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronogaz.functions.normal import folded
from chronogaz.functions.text import one_edit, search_fold
from chronogaz.operators.graph import checkpointed, running


def ranked_search(names: DataFrame, queries: tuple[str, ...], top: int, key: str = "name") -> DataFrame:
    """(name) and a few query strings -> (q, name, rank, pos): exact 0, prefix or word start 1, typo 2 from 5 letters on.

    Every name meets every query of the stated set once, as columns of its own row; only matches become rows."""
    f = F.col("_f")
    hits = []
    for q in queries:
        x = F.lit(q)
        rank = F.when(f == x, 0).when(f.startswith(q) | F.contains(f, F.lit(" " + q)), 1)
        if len(q) >= 5:
            rank = rank.when(_any_near(F.split(f, " "), x), 2)
        hits.append(F.struct(x.alias("q"), rank.cast("long").alias("rank"), F.when(f.startswith(q), 0).otherwise(1).alias("pref")))
    cols = dict.fromkeys(("name", key))
    rows = names.withColumn("_f", search_fold(F.col("name"))).select(*cols, "_f", F.explode(F.filter(F.array(*hits), lambda h: h["rank"].isNotNull())).alias("h"))
    w = Window.partitionBy("q").orderBy("rank", "pref", "_f", key)
    return rows.select(*cols, "_f", "h.*").withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= top)


def _any_near(words, q):
    return F.exists(words, lambda w: one_edit(w, q))


def index_quantile(values: DataFrame, by: str, value: str, n: str, share: float, limit: float) -> DataFrame:
    """(by, n, worst, p95, n_long) from values with their counts: the value at place floor((n - 1) * share) in order."""
    totals = values.groupBy(by).agg(F.sum(n).alias("_all"), F.sum(F.when(F.col(value).isNotNull(), F.col(n)).otherwise(0)).alias("_m"), F.max(value).alias("worst"), F.sum(F.when(F.col(value) > limit, F.col(n)).otherwise(0)).alias("n_long"))
    upto = running(values.where(F.col(value).isNotNull()), by, value, n).withColumnRenamed("upto", "_hi")
    ranked = upto.join(totals.select(by, "_m"), by)
    place = F.floor((F.col("_m") - 1) * share) + 1
    at = ranked.where((F.col("_hi") >= place) & (F.col("_hi") - F.col(n) < place)).select(by, F.col(value).alias("p95"))
    return totals.join(at, by, "left").select(by, F.col("_all").alias("n"), "worst", "p95", "n_long")


def same_names(named: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, name) -> (a, b, name), a < b: different ids of one name, without the allowed pairs (a, b)."""
    a, b = (named.select(F.col("id").alias(s), "name") for s in "ab")
    return a.join(b, "name").where("a < b").join(allowed, ["a", "b"], "left_anti").select("a", "b", "name")


def passages(refs: DataFrame, verses: DataFrame, book: str, verse: str, text: str) -> DataFrame:
    """(book, first, last) -> (book, found, passage, error): the verses there are in order; a passage only if none is missing."""
    rows = refs.withColumn(verse, F.explode(F.sequence("first", "last")))
    got = rows.join(verses.select(book, verse, F.col(text).alias("t"), F.lit(1).alias("there")), [book, verse], "left")
    g = got.groupBy(book).agg(F.count("*").alias("need"), F.count("there").alias("n"), F.bool_and(F.col("there").isNotNull() | ~F.col(verse).isin(F.col("first"), F.col("last"))).alias("both"), F.array_sort(F.collect_list(F.when(F.col("there") == 1, F.struct(verse, "t")))).alias("p"))
    found = F.when(F.col("n") > 0, F.array_join(F.transform("p", lambda x: x["t"]), " "))
    error = F.when(F.col("n") == 0, "no verse").when(F.col("n") < F.col("need"), F.when(F.col("both"), "missing interior verse").otherwise("missing end verse"))
    return g.select(book, found.alias("found"), F.when(F.col("n") == F.col("need"), found).alias("passage"), error.alias("error"))


def without_names(df: DataFrame, text: str, names: str) -> DataFrame:
    """Rows whose folded text holds none of the row's names as a substring; a row without names holds none."""
    return df.withColumn("_f", search_fold(F.col(text))).where(~F.coalesce(F.exists(names, lambda n: F.contains(F.col("_f"), F.lower(n))), F.lit(False))).drop("_f")


REFERENCE = r"^((?:[1-3] )?[A-Z][A-Za-z ]*) ([0-9]+):([0-9]+)(?:-([0-9]+))?$"


def references(df: DataFrame, ref: str, books: DataFrame) -> DataFrame:
    """Adds to df, less ref: code, chapter, first_verse, last_verse, verdict of a reference; books: (book, code), a fixed list."""
    part = lambda i: F.regexp_extract(ref, REFERENCE, i)
    number = lambda i: F.nullif(part(i), F.lit("")).cast("long")
    rows = df.withColumns({"book": part(1), "chapter": number(2), "first_verse": number(3), "last_verse": F.coalesce(number(4), number(3))}).join(F.broadcast(books), "book", "left")  # some seventy books
    verdict = F.when(F.col("book") == "", "not a reference").when(F.col("code").isNull(), "unknown book").when(F.col("last_verse") < F.col("first_verse"), "ends before it starts").otherwise("ok")
    return rows.withColumn("verdict", verdict).drop("book", ref)


def _left_out(rows: DataFrame, name: str) -> DataFrame:
    """(name, key): each name with itself and with every form that lacks one letter."""
    places = F.sequence(F.lit(1), F.length(name))
    without = lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1))
    return rows.select(name, F.explode(F.array_distinct(F.concat(F.array(name), F.when(F.length(name) > 0, F.transform(places, without)).otherwise(F.array().cast("array<string>"))))).alias("key"))


def near_words(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(q) and (word), distinct each -> (q, word): equal, within one edit, or within one swap of any two places."""
    # small rows of which many are made, so they are dealt out first
    queries = queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "q")
    edits = _left_out(queries, "q").join(_left_out(words, "word"), "key").select("q", "word").distinct().where(F.levenshtein("q", "word", 1) >= 0)
    places, at = F.sequence(F.lit(1), F.length("q")), lambda i: F.substr("q", i, F.lit(1))
    swap = lambda i, j: F.concat(F.substr("q", F.lit(1), i - 1), at(j), F.substr("q", i + 1, j - i - 1), at(i), F.substr("q", j + 1))
    made = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: (j > i) & (at(j) != at(i))), lambda j: swap(i, j))))
    swapped = queries.where(F.length("q") > 1).select("q", F.explode(F.array_distinct(made)).alias("word"))
    return edits.unionByName(swapped.join(words, "word", "left_semi").select("q", "word")).distinct()


#: Letters of a search's key: only names and words that open with the first letters of some search are looked at further.
KEY = 4
#: A typo is looked for in searches and words of this many letters and more.
TYPO = 5


def _opened(starts: DataFrame, asked: DataFrame) -> DataFrame:
    """(start) and (fq), distinct each -> (start, fq): the searches with which a start opens.

    A start meets searches by its whole opening of each length that is asked for, so rows grow with its letters, whatever
    number of searches and starts share their first letters."""
    key = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(KEY), F.length("start"))), lambda k: F.substr("start", F.lit(1), k)))
    likely = starts.withColumn("key", key).join(asked.select(F.substr("fq", F.lit(1), F.lit(KEY)).alias("key")).distinct(), "key", "left_semi").select("start").distinct()
    lengths = asked.select(F.length("fq").alias("k")).distinct()  # as many as the longest search has letters, at most
    return likely.join(F.broadcast(lengths), F.col("k") <= F.length("start")).withColumn("fq", F.substr("start", F.lit(1), F.col("k"))).join(asked, "fq").select("start", "fq")


def search(names: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(name) and any number of searches (q) -> (q, name, rank, pos): the best names of each search by exact match 0, the
    name's or one of its words' opening letters 1, a typo in the letters of the name or a word 2; then names that open so
    first, then by folded name.

    Both sides are folded. They meet by their openings and by letters left out, so only near candidates become rows.
    Null and empty names and searches have no match; repeated ones count once."""
    words, only = (lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), (lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    # folded once, as each is read several times
    n = checkpointed(names.select("name").distinct().select("name", folded(F.col("name")).alias("f"))).where("f <> ''")
    q = checkpointed(queries.select("q").distinct().select("q", folded(F.trim("q")).alias("fq"))).where("fq <> ''")
    starts = n.select("name", "f", F.explode(F.array_distinct(F.concat(F.array("f"), words(F.col("f"))))).alias("start"))
    met = _opened(starts.select("start").distinct(), q.select("fq").distinct()).join(q, "fq").join(starts, "start")
    opens = met.select("q", "name", "f", F.when(F.col("f") == F.col("fq"), 0).otherwise(1).alias("rank"), F.when(F.startswith("f", "fq"), 0).otherwise(1).alias("pref"))
    letters = n.select("name", "f", F.explode(F.array_distinct(F.transform(F.concat(F.array("f"), words(F.col("f"))), only))).alias("word")).where(F.length("word") >= TYPO)
    asked = q.select(F.col("q").alias("asked"), only(F.col("fq")).alias("q")).where(F.length("q") >= TYPO)
    near = near_words(asked.select("q").distinct(), letters.select("word").distinct())
    typos = near.join(asked, "q").join(letters, "word").select(F.col("asked").alias("q"), "name", "f", F.lit(2).alias("rank"), F.lit(0).alias("pref"))
    best = opens.unionByName(typos).groupBy("q", "name", "f").agg(F.min(F.col("rank") * 2 + F.col("pref")).alias("r"))
    w = Window.partitionBy("q").orderBy("r", "f", "name")
    ranked = best.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= top)
    return ranked.select("q", "name", F.floor(F.col("r") / 2).alias("rank"), "pos")


def near_names(names: DataFrame) -> DataFrame:
    """(name) -> (one, other), one < other: distinct names within one edit, or one swap of any two places.

    Names within one edit share a name with one letter left out, or one of them is the other's; names within a swap are found
    by making the swaps. Rows grow with the letters of a name, not with the pairs of names."""
    rows = names.where("name is not null").select("name").distinct()
    places = F.sequence(F.lit(1), F.length("name"))
    cut = _left_out(rows, "name")
    a, b = cut.withColumnRenamed("name", "one"), cut.withColumnRenamed("name", "other")
    edits = a.join(b, "key").where("one < other").select("one", "other").distinct().where(F.levenshtein("one", "other", 1) >= 0)
    at = lambda i: F.substr("name", i, F.lit(1))
    swap = lambda i, j: F.concat(F.substr("name", F.lit(1), i - 1), at(j), F.substr("name", i + 1, j - i - 1), at(i), F.substr("name", j + 1))
    later = lambda i: F.transform(F.filter(places, lambda j: (j > i) & (at(j) > at(i))), lambda j: swap(i, j))
    swapped = rows.where(F.length("name") > 1).select(F.col("name").alias("one"), F.explode(F.array_distinct(F.flatten(F.transform(places, later)))).alias("other"))
    swaps = swapped.join(rows.select(F.col("name").alias("other")), "other", "left_semi").select("one", "other")
    return edits.unionByName(swaps).distinct()
