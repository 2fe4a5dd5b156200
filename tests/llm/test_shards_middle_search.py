"""Operators 11 to 13 against plain versions over lists of rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from chronogaz.llm import fill_middle, lexical_search, queries, sharding

EMPTY = "doc_id long, text string"


def rows():
    rng = random.Random(11)
    some = ["alpha", "Beta", "gamma", "é", "naïve", "x1", "THE", "the", "of", "zeta", "日本", "𝔘ni"]
    texts = [" ".join(rng.choice(some[: rng.randint(2, 12)]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts = [t.replace(" of ", "\n") if i % 2 else t for i, t in enumerate(texts)]
    texts += [None, "", "\n", "\n\n\n", "a\nb", "a\r\nb\n", "one line", "has <P> in it\nand more", "<S>", "tail <M>", "<", "<P\n>", "é\né\n𝔘\n", " ", "--", "the " * 4000, "x\n" * 70_000, "\n" * 3000 + "y" * 70_000 + "\n" * 66_000]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(3, texts[3]), (3, texts[3]), (3, "the other three"), (None, "the null"), (None, None), (2**63 - 1, "the last"), (-5, "the first")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs")) + "/t"
    extra = [(d, t, 1, 2, "s", 0) for d, t in rows()]
    spark.createDataFrame(extra, "doc_id long, text string, n int, slot int, form string, row long").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_sharding", "op12_fill_middle", "op13_lexical_search"])
def test_twins(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def plain_place(x, n, a, b, seed=sharding.SEED):
    while True:
        left, right = divmod(x, b)
        for k in range(sharding.ROUNDS):
            added = int(hashlib.md5(f"{seed}:{k}:{left if k % 2 else right}".encode()).hexdigest()[:15], 16)
            if k % 2:
                right = (right + added) % b
            else:
                left = (left + added) % a
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 11, 31, 64, 101, 997, 5003])
def test_places_are_a_permutation_that_can_be_undone(spark, n):
    a, b = sharding.sides(n)
    assert n <= a * b < n + a
    df = spark.range(n).withColumn("p", sharding.permuted(F.col("id"), n)).withColumn("back", sharding.row_at(F.col("p") % 8, F.floor(F.col("p") / 8), n))
    got = df.collect()
    assert sorted(r.p for r in got) == list(range(n)) and all(r.back == r.id for r in got)
    assert all(r.p == plain_place(r.id, n, a, b) for r in got)
    if n > 900:  # neighbours part, and another seed gives another order
        assert abs(np.corrcoef([r.id for r in got], [r.p for r in got])[0, 1]) < 0.15
        other = spark.range(n).select(sharding.permuted(F.col("id"), n, "other").alias("p")).collect()
        assert sum(x.p == y.p for x, y in zip(got, other)) < 20


def test_walks_end_where_few_values_fit(spark, monkeypatch):
    """With sides that leave many values from n on, walks take many steps."""
    monkeypatch.setattr(sharding, "sides", lambda n: (8, 8))
    got = spark.range(9).select(sharding.permuted(F.col("id"), 9).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(9)) and [r.p for r in got] == [plain_place(i, 9, 8, 8) for i in range(9)]


def test_sharding(spark, docs, tmp_path):
    got = sharding.shard_digest(docs).collect()
    want = sorted(((d is not None, d or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), d) for d, t in rows())
    n = len(want)
    a, b = sharding.sides(n)
    plain = sorted((w[3], w[1], w[2], *divmod(plain_place(i, n, a, b), 8)[::-1], i) for i, w in enumerate(want) if w[3] is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot, r.row_no) for r in got if r.doc_id is not None) == plain
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for parts in (1, 13):  # the layout of the input does not matter
        docs.repartition(parts).write.parquet(f"{tmp_path}/{parts}")
        again = sharding.shard_digest(spark.read.parquet(f"{tmp_path}/{parts}")).collect()
        assert sorted(again, key=str) == sorted(got, key=str)
    assert sharding.shard_digest(spark.createDataFrame([], EMPTY)).count() == 0
    same = spark.createDataFrame([(7, "same")] * 1000, EMPTY)
    assert sorted(r.row_no for r in sharding.shard_digest(same).collect()) == list(range(1000))


def test_shards_are_written_with_their_rows(spark, docs, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == sorted(["doc_id", "text", "n", "form", "row", "slot", "row_no", "shard"])
    key = lambda r: (r.doc_id, r.text)
    assert sorted(map(key, back.collect()), key=str) == sorted(map(key, docs.collect()), key=str)


def test_no_python_in_the_sharding_plan(spark, sf):
    plan = queries.op11_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_middle(doc_id, text, seed=7):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, sha = len(units), lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100:
        return (doc_id, n, "plain", None, None, sha(text or ""), sha(text or ""))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return (doc_id, n, form, len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(text))


def test_fill_middle(spark, docs):
    got = fill_middle.fim_digest(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_middle(d, t) for d, t in rows()), key=str)
    assert fill_middle.fim_digest(spark.createDataFrame([], EMPTY)).count() == 0
    out = fill_middle.transform(docs)
    assert out.columns == ["doc_id", "text", "slot", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert all(fill_middle.restored(r.output, r.form) == (r.text or "") for r in out.collect())
    assert {r.form for r in fill_middle.transform(docs, fim_rate=0).collect()} == {"plain"}


def test_boundary_sets(spark, docs):
    rng = np.random.default_rng(5)
    sets = [np.array([0]), np.arange(200_000), np.sort(rng.choice(1 << 20, 3000, False)), np.sort(rng.choice(1 << 18, 1 << 17, False)), np.append(np.arange(70_000), [90_000, 1 << 30, (1 << 32) - 1])]
    kinds = set()
    for values in sets:
        for cuts in (made := fill_middle.Cuts.of(values), fill_middle.Cuts.load(made.dump())):
            kinds |= set(cuts.kinds.tolist())
            ranks = np.unique(np.append(rng.integers(0, len(values), 400), [0, len(values) - 1]))
            assert len(cuts) == len(values) and [cuts.select(int(r)) for r in ranks] == values[ranks].tolist()
        with pytest.raises(IndexError):
            cuts.select(len(values))
    assert kinds == {fill_middle.ARRAY, fill_middle.BITMAP, fill_middle.RUN}
    for r in fill_middle.boundaries(docs).select("text", "cuts").collect():
        cuts = fill_middle.Cuts.load(bytes(r.cuts))
        ends = np.append(0, np.cumsum([len(u) for u in re.findall(r"[^\n]*\n|[^\n]+", r.text or "")]))
        assert len(cuts) == len(ends) and all(cuts.select(i) == ends[i] for i in {0, len(ends) // 2, len(ends) - 1})


def plain_search(docs, items, best=10):
    docs = [(d, Counter(words(t))) for d, t in docs]
    docs = [(d, c, c.total()) for d, c in docs if c]
    n, total = len(docs), sum(x for _, _, x in docs)
    df, out = Counter(t for _, c, _ in docs for t in c), []
    for item, text in items:
        scored = []
        for d, c, size in docs:
            m = 10 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:best])]
    return sorted(out, key=str)


ITEMS = [(1, "alpha naïve THE"), (2, "the of"), (3, None), (4, ""), (5, "unknown words"), (6, "日本 x1 x1 zeta beta gamma"), (7, "y x"), (7, "the"), (None, "first last null other three"), (8, "--")]


@pytest.mark.parametrize("how", [{}, {"segment": 3000, "block": 4, "query_bytes": 200}, {"segment": 1, "block": 1}, {"segment": 20_000, "block": 7}])
def test_search(spark, docs, how):
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, rank int")
    got = lexical_search.search(docs, items, **how)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows(), ITEMS)


def test_search_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], EMPTY)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_windows_and_blocks_reject_without_reading(spark):
    """Long lists of a frequent word are hardly read once ten documents hold the rare one; results stay those of a full walk."""
    rng = random.Random(2)
    part = lexical_search._Segment()
    texts = ["common " * rng.randint(1, 3) + "filler " * rng.randint(1, 9) + ("rare " if i % 17 == 3 and i < 400 else "") for i in range(6000)]
    for i, t in enumerate(texts):
        part.add(i, t.encode())
    n, total = len(texts), sum(part.sizes)
    import pyarrow as pa

    head, *rest = part.batches(0, n, total, 16, pa.int64())
    m = np.array(head.to_pylist()[0]["m"], np.int64)
    made = {r["term"]: r for b in rest for r in b.to_pylist()}
    lists = {t: lexical_search._List(r["heads"], r["data"], r["top"], m) for t, r in made.items()}
    query = [(lexical_search.weight(n, made[t]["df"]), lists[t]) for t in (b"common", b"rare")]
    docs, scores = lexical_search.best_of_segment(query, n, windows=(64, 64))
    want = plain_search(list(enumerate(texts)), [(0, "common rare")])
    assert sorted((0, i + 1, d, s) for i, (d, s) in enumerate(zip(docs.tolist(), scores.tolist()))) == sorted(want)
    assert lists[b"common"].read < len(lists[b"common"].heads) / 4
