import random

import corpus_pipeline
from pyspark.sql import functions as F

from chronogaz.llm import jaccard_dedup

COLUMNS = "doc_id long, text string, source string"


def shingles(text):
    ws = (text or "").split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_keepers(rows):
    """Smallest doc_id of each component of the graph of pairs with Jaccard of 0.8 or more."""
    sets, of = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not union or both / union >= 0.8:
                pairs += bool(union and both < union)
                of[max(top(i), top(j))] = min(top(i), top(j))
    return {rows[top(i)][0] for i in range(len(rows))}, pairs


def planted():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for n in (5, 8, 30, 60, 120, 400):
        for _ in range(2):
            base = [word() for _ in range(n)]
            texts.append(base)
            for edits in range(1, max(2, n // 25)):
                copy = list(base)
                for at in rng.sample(range(n), edits):
                    copy[at] = word()
                texts += [copy, copy[: n - edits]]
    hot = [word() for _ in range(100)]  # one group whose members are near each other in chains
    for _ in range(80):
        hot[rng.randrange(100)] = word()
        texts.append(list(hot))
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    return rows + [(len(rows), "", "s"), (len(rows) + 1, None, "s"), (len(rows) + 2, " \n ", "s"), (len(rows) + 3, "one two", "s"), (len(rows) + 4, "One  two", "s")]


def test_near_duplicate_stage(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    want, pairs = brute_keepers([(d, t and t.lower(), s) for d, t, s in rows])
    assert pairs > 50 and len(want) < len(rows) - 50
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_near_duplicate_stage_takes_simhash_groups(spark, monkeypatch):
    """Operator 8's groups alone, without any MinHash shard: pairs within its radius are found, and checked exactly."""
    from chronogaz.llm.simhash_dedup import RADIUS, fingerprint_of

    rng = random.Random(5)
    rows = []
    for i in range(0, 40, 2):
        ws = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
        rows += [(i, " ".join(ws), "s"), (i + 1, " ".join([*ws, "end"]), "s")]
    rows += [(40, "a b a b a b a b a b", "s"), (41, "a b a b a b a b a b a", "s"), (42, "x y z", "s"), (43, "x y z w", "s")]
    apart = lambda i: (fingerprint_of(rows[i][1].encode()) ^ fingerprint_of(rows[i + 1][1].encode())).bit_count()
    near = [i for i in range(0, 40, 2) if apart(i) <= RADIUS]
    assert len(near) >= 10
    monkeypatch.setattr(jaccard_dedup, "ROUNDS", jaccard_dedup.ROUNDS[:1])
    got = {r.doc_id for r in jaccard_dedup.keep_one(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == set(range(44)) - {i + 1 for i in near} - {41}


def test_near_duplicate_stage_in_parts(spark):
    rows = planted()[:150]
    want, _ = brute_keepers([(d, t and t.lower(), s) for d, t, s in rows])
    got = jaccard_dedup.keep_one(spark.createDataFrame(rows, COLUMNS), size=7)
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_near_duplicate_stage_rows(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base, "a"), (1, base, "a"), (1, "other text", "a"), (None, base + " x", "a"), (None, "alone", "b"), (None, "alone", "b"), (7, base.replace("w50", "y"), "a")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect())) == sorted([(1, base), (1, "other text"), (0, "alone")])
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([], COLUMNS), "").count() == 0


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.where(F.col("doc_id").isNull()).count() == 0 and out.count() > 100


def test_stages_in_order(spark, sf):
    """Each stage on what the one before kept, against what it must keep, with clashing columns, nulls and repeats."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(60):
        ws = [word() for _ in range(50)]
        if i % 6 == 1:
            ws[10:10] = passage[5:20]
        if i % 6 == 2:
            ws = rows[-2][1].split()
            ws[25] = word()
        if i % 6 == 3:
            ws += ["you", "are", "a", "stupid", "idiot", "moron", "idiot", "scum"]
        rows.append((i, " ".join(ws), None if i % 10 == 0 else "xyz"[i % 3], i, i, "k"))
    rows += [(None, "no id at all", "x", 1, 1, "k"), (60, None, "y", 1, 1, "k"), (61, "", "y", 1, 1, "k"), (7, rows[7][1], "y", 1, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, node int, key string")
    out = spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/sf{rng.random()}"
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 6 == 3)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage)), (None, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    now, got = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.cut(stage(spark, now, out))
        assert now.columns == docs.columns
        got[name] = [r.doc_id for r in now.collect()]
    toxic = {i for i in range(60) if i % 6 == 3}
    clean = [r[0] for r in rows if r[0] not in toxic]
    assert sorted(map(str, got["toxicity"])) == sorted(map(str, clean))
    keep, _ = brute_keepers([(d if d is not None else 10**9, t, s) for d, t, s, *_ in rows if d not in toxic])
    assert {10**9 if d is None else d for d in got["near_duplicates"]} == keep
    assert set(got["decontamination"]) == set(got["near_duplicates"]) - {i for i in range(60) if i % 6 == 1}
    assert set(got["mix"]) <= set(got["decontamination"]) and len(got["mix"]) > len(got["decontamination"])
    tokens = corpus_pipeline.STAGES[-1][1](spark, now, out).orderBy("start").collect()
    assert sorted(str(r.doc_id) for r in tokens) == sorted(map(str, got["mix"]))
    assert [r.start for r in tokens] == [sum(x.n_tokens for x in tokens[:i]) for i in range(len(tokens))]
    assert corpus_pipeline.run(spark, out).count() == len(tokens)
    docs.limit(0).write.mode("overwrite").parquet(f"{out}/documents.parquet")
    assert corpus_pipeline.run(spark, out).count() == 0
