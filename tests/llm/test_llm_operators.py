import hashlib
import random
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import contamination, dedup, licenses, simhash, tokens, words
from pyspark.sql import functions as F

from chronogaz.llm import decontaminate, html_extraction, language_id, license_scan, media_columns, simhash_dedup, source_mix, suffix_dedup, token_output, toxicity
from chronogaz.llm import queries as Q

EMPTY = "doc_id long, text string"


def nasty():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgéü ") for _ in range(rng.randint(1, 9))).strip() or "x"
    base = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    passage = " ".join(word() for _ in range(60))
    for i in range(25, 60):
        a, b = rng.choice(base), rng.choice(base)
        rows.append((i, rng.choice([a, a[: len(a) // 2] + " " + passage + " " + b[len(b) // 3 :], b.upper(), passage, a + "  " + b, a.replace("a", "ä", 1)])))
    rows += [(60, None), (61, ""), (62, "   \n\t "), (63, "-" * 300), (64, "x" + "-" * 180 + "y"), (65, "a" * 49), (66, "a" * 50), (67, "b" + "a" * 50), (68, "ab" * 400), (69, "<|endoftext|> and  two \n spaces ² ½ 'll we'll"), (70, " lead"), (71, "trail "), (72, "z" + "ab" * 390)]
    rows += [(100 + i, "Licensed under the Apache License, Version 2.0. MIT license; CC-BY x " * (i % 3)) for i in range(6)]
    rows.append((200, " ".join(word() for _ in range(20000)) + " " + passage))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(d, t, "s", "fp", 1, 2) for d, t in nasty()]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, fp string, size int, row int").repartition(5)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_dedup(spark, docs, real, sf):
    for df in (docs, real):
        assert got(suffix_dedup.dedup_digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(dedup(rows_of(df)), key=str)
    assert suffix_dedup.dedup_digest(spark.createDataFrame([], EMPTY)).count() == 0


def test_dedup_hot_groups(spark, docs):
    """Small limits: every anchor group counts as hot or is split over many buckets."""
    want = sorted(dedup(rows_of(docs)), key=str)
    for kw in ({"hot": 1}, {"hot": 3, "shard_bytes": 3000, "bucket_rows": 50}, {"shard_bytes": 500}):
        assert got(suffix_dedup.dedup_digest(docs, **kw), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_media(spark, docs):
    out = {r.doc_id: r for r in media_columns.media_digest(docs).collect()}
    for d, t in rows_of(docs):
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = out[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
    muxed = media_columns.mux(docs, "text")
    back = media_columns.payloads(muxed).where("doc_id = 200").first()
    assert bytes(back.payload).rstrip() == back.text.encode().rstrip()
    table = media_columns.packets(muxed).where("doc_id = 200").orderBy("packet_no").collect()
    assert [p.byte_end - p.byte_start for p in table] == [192] * len(table) and table[-1].timestamp_ms > table[0].timestamp_ms


def test_media_rows(spark):
    odd = spark.createDataFrame([(1, "ab", 7, 8), (1, "ab", 7, 8), (None, None, 7, 8), (2, "", 7, 8)], "doc_id long, text string, track int, packet int")
    out = media_columns.media_digest(odd).collect()
    assert len(out) == 4 and len({(r.payload_sha256, r.media_sha256, r.feature) for r in out}) == 2 and sorted(r.n_bytes for r in out) == [0, 0, 2, 2]
    table = media_columns.packets(media_columns.mux(odd, "text"))
    assert table.columns.count("track") == 1 and {"packet", "packet_no", "byte_start"} <= set(table.columns) and {r.track for r in table.collect()} == {1} and table.count() == 4
    assert media_columns.media_digest(odd.limit(0)).count() == 0 and media_columns.packets(media_columns.mux(odd.limit(0), "text")).count() == 0
    full = media_columns.mux_bytes(b"q" * 192 * 8 * 32 * 3)
    cues = media_columns.cue_points(full)
    assert len(cues) == 3 and [t for t, _ in cues] == sorted({p[1] // 6144 * 6144 for p in media_columns.parse(full)})


def test_media_times(spark):
    rows = [(n, "x" * (192 * n)) for n in (1, 7, 8, 9, 20, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = media_columns.packets(media_columns.mux(df, "text"))
    times = {r.doc_id: r.t for r in table.groupBy("doc_id").agg(F.array_sort(F.collect_list("timestamp_ms")).alias("t")).collect()}
    assert times == {n: [24 * i for i in range(n)] for n, _ in rows}
    assert {r.doc_id: r.duration_ms for r in media_columns.media_digest(df).collect()} == {n: 24 * n for n, _ in rows}
    # a scale of two milliseconds; a track without a default duration
    m = media_columns
    track = lambda n, more: m.element(m.TRACK, m.uint(m.NUMBER, n) + more)
    head = m.element(m.INFO, m.uint(m.SCALE, 2_000_000)) + m.element(m.TRACKS, track(1, m.uint(m.FRAME_TIME, 5_500_000)) + track(2, b""))
    block = lambda n: m.element(m.SIMPLE_BLOCK, bytes([128 + n]) + b"\x00\x03\x84\x02abc")
    body = m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 100) + block(1) + block(2))
    found = m.parse(m._head(0)[0] + m.element(m.SEGMENT, head + body))
    assert [p[:2] for p in found] == [(1, 206), (1, 211), (1, 217), (2, 206), (2, 206), (2, 206)]


def test_media_lacing_and_damage():
    m = media_columns
    frames = [b"a" * 300, b"b" * 5, b"c" * 40]
    xiph = b"\x81\x00\x05\x82\x02" + b"\xff\x2d\x05" + b"".join(frames)
    size = lambda n: m.vint(n, 2)
    signed = lambda d: m.vint(d + (1 << 13) - 1, 2)
    ebml = b"\x81\x00\x06\x06\x02" + size(300) + signed(5 - 300) + b"".join(frames)
    body = m.uint(m.TIMESTAMP, 1000) + m.element(m.SIMPLE_BLOCK, xiph) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, ebml))
    data = m._head(0)[0] + m.SEGMENT.to_bytes(4, "big") + b"\xff" + m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    found = m.parse(data)
    assert [data[a:b] for _, _, a, b, _, _ in found] == frames * 2
    assert [p[1] for p in found] == [1005] * 3 + [1006] * 3
    full = m.mux_bytes(b"q" * 19200)
    assert len(m.parse(full)) == 100 and len(m.parse(full[: len(full) // 2])) < 100 and m.parse(b"") == [] and m.parse(b"\0\0") == []


def test_tokens(spark, docs, real):
    for df in (docs, real):
        assert got(token_output.token_digest(df), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(tokens(rows_of(df), token_output.tokenizer_path()), key=str)
    assert token_output.token_digest(spark.createDataFrame([], EMPTY)).count() == 0
    out = token_output.write_tokens(real, token_output.shared_dir(spark), encoding="delta")
    assert token_output.read_tokens(spark, out, ("doc_id", "n_tokens"), (5, 9)).count() == 5


def test_tokens_of_repeated_and_null_ids(spark):
    rows = [(5, "x y z"), (5, "a"), (5, None), (None, "n one"), (None, "n"), (5, "a"), (2, "two two"), (9, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(4)
    for r in (token_output.token_digest(df).orderBy("start").collect(),):
        assert [x.start for x in r] == np.cumsum([0] + [x.n_tokens for x in r])[:-1].tolist()
        assert [x.doc_id for x in r] == [None, None, 2, 5, 5, 5, 5, 9]
    assert sorted(x.ids_crc32 for x in r) == sorted(c for _, _, _, c in tokens([(0, t) for _, t in rows], token_output.tokenizer_path()))
    out = token_output.write_tokens(df, token_output.shared_dir(spark), text_in_file=1)
    files = token_output.read_tokens(spark, out).select("part", F.col("_metadata.row_index").alias("row"), "doc_id", F.size("tokens").alias("n"), "n_tokens").orderBy("part", "row").collect()
    assert [(x.doc_id, x.n) for x in files] == [(x.doc_id, x.n_tokens) for x in r] and all(x.n == x.n_tokens for x in files)


def test_contamination(spark, docs, real, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.contamination(real, bench), *cols) == sorted(contamination(rows_of(real), items), key=str)
    own = [(1, nasty()[40][1]), (2, "apache license"), (3, None), (4, "!!"), (11, nasty()[3][1]), (5, "version")]
    ben = spark.createDataFrame(own, "item_id long, text string")
    want = sorted(contamination(rows_of(docs), own), key=str)
    assert got(decontaminate.contamination(docs, ben), *cols) == want
    assert got(decontaminate.contamination(docs, ben, block_bytes=40), *cols) == want
    bad = {w[0] for w in want if w[5]}
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, ben).collect()} == {d for d, _ in nasty()} - bad


def test_contamination_rows(spark):
    """Shards with few words, repeated and null doc_ids, several blocks, true longest matches, clashing columns."""
    one = "a b c d e"
    items = [(1, one + " f g h i j k l"), (2, "v w x y z"), (3, "k l v w x y z"), (None, "solo"), (3, "k l v w x y z")]
    rows = [(1, "word", "q"), (1, "v w x y z", "q"), (None, "", "q"), (None, None, "q"), (None, "a b c d e f g h i j k l v w x y z", "q"), (1, "solo", "q"), (7, "z a b c d e f g h i j k q v w x y", "q"), (7, "b c d e f g h i j k l", "q")]
    ben = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    want = sorted(((d, t, r.n_words, r.n_hit, r.items, r.longest) for d, t, _ in rows for r in [plain_longest(t, items)]), key=str)
    for parts in (1, 8):
        for block in (8 << 20, 10):
            m = decontaminate.matches(docs.repartition(parts), ben, block_bytes=block).collect()
            got_ = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"]), (r.longest_match, r.longest_at, r.longest_item)) for r in m), key=str)
            assert got_ == sorted(((d, n, h, i, x) for d, _, n, h, i, x in want), key=str)
            kept = decontaminate.remove_contaminated(docs.repartition(parts), ben, block_bytes=block)
            assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(d), t or "") for d, t, _ in rows if not plain_longest(t, items).n_hit)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.longest_match) for r in decontaminate.contamination(docs, none).collect()} == {(0, 0)}
    assert decontaminate.contamination(docs.limit(0), ben).count() == 0 and decontaminate.remove_contaminated(docs, none).count() == len(rows)


def plain_longest(text, items, n=10):
    ws, hit, found, best = words(text), set(), set(), (0, 0, "")
    for item, t in items:
        iw = words(t)
        for i in range(len(ws)):
            for j in range(len(iw)):
                k = 0
                while i + k < len(ws) and j + k < len(iw) and ws[i + k] == iw[j + k]:
                    k += 1
                if k >= n or 0 < k == len(iw) < n:
                    hit |= set(range(i, i + k))
                    found.add("" if item is None else str(item))
                    best = min(best, (-k, i, "" if item is None else str(item)))
    longest = (-best[0], best[1], best[2]) if best[0] else (0, None, None)
    return types.SimpleNamespace(n_words=len(ws), n_hit=len(hit), items=tuple(sorted(found)), longest=longest)


def test_language(spark, sf):
    out = Q.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and out.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, True), (2, "", True), (3, "12 -- 34", True)], "doc_id long, text string, held_out boolean")
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.fit(spark.createDataFrame([], EMPTY + ", lang string")) is None


def plain_places(text):
    """The hashed places of a text's byte n-grams, one at a time."""
    raw, out = text.lower().encode(), set()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            out.add((int.from_bytes(raw[i : i + n], "big") * int(language_id._MUL[n - 1]) & 0xFFFFFFFF) >> 19)
    return out


def test_language_kernel_equals_sets(spark):
    texts = {"en": ["the cat and the hat", "of mice and men", "this is the end"], "de": ["der Hund und die Katze", "das Ende ist nah", "über den Fluß"], "fr": ["le chat et le chien", "la fin du monde", "où est la gare"]}
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for lang, ts in texts.items() for t in ts)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(set(np.flatnonzero(p)) == plain_places(t) for (_, t, _), p in zip(rows, language_id.presence([t for _, t, _ in rows])))
    marks = [set(np.flatnonzero(model.marks[:, k])) for k in range(model.marks.shape[1])]
    ask = ["the hound and the end", "die Katze", "le monde", "é", "a" * 5000]
    got_ = {r.doc_id: r for r in language_id.predict(spark.createDataFrame([(i, t, False, "x") for i, t in enumerate(ask)], "doc_id long, text string, held_out boolean, lang string"), model).collect()}
    for i, t in enumerate(ask):
        own = plain_places(t)
        k = np.array([len(own & m) / (len(own) * len(m)) ** 0.5 for m in marks])
        s = k @ model.weights.astype(float) + model.bias
        e = np.exp(language_id.SHARP * (s - s.max()))
        assert got_[i].lang_pred == model.langs[int(s.argmax())] and abs(got_[i].score - e.max() / e.sum()) < 1e-4
    assert [got_[i].lang_pred for i in range(3)] == ["en", "de", "fr"]
    assert language_id.predict(spark.createDataFrame([], EMPTY + ", held_out boolean"), model).count() == 0


def test_mix(spark, sf):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", None, "Z"] if i % 3 else ["a"]), rng.randint(0, 40)) for i in range(900)] + [(5, "a", 9), (None, "b", 4), (901, "empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    a = source_mix.mix(df, F.col("n"), range_rows=50)
    assert got(a, "doc_id", "size", "taken") == got(source_mix.mix(df.repartition(7), F.col("n")), "doc_id", "size", "taken")
    p = a.toPandas()
    total = p["size"].sum()
    by = p.groupby(p.source.fillna("~")).agg(n=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * total) < 1e-6 and (by.target <= 2 * by.n + 1e-9).all() and (by.taken == np.floor(by.target)).all()
    assert (p.taken <= 2 * p["size"]).all()
    names = sorted(by.index)  # "~" stands for null, last
    w = dict(zip(names, [3, 1, 2] * 9))
    free = [s for s in names if by.target[s] < 2 * by.n[s] - 1e-9]
    assert len({round(by.target[s] / w[s], 6) for s in free}) <= 1
    docs = spark.createDataFrame([(1, "a b c", "x", "q"), (2, None, "x", "q"), (3, "d", None, "q")], "doc_id long, text string, source string, taken string")
    assert source_mix.mixed_rows(docs).columns == docs.columns
    assert source_mix.mix(spark.createDataFrame([], "doc_id long, source string, n long"), F.col("n")).count() == 0
    assert source_mix.mixed_rows(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, f"a b {i} " * 9, "x", i, i, i, i) for i in range(40)] + [(1, "c", "y", 0, 0, 0, 0)], "doc_id long, text string, source string, n_rows int, _key int, range int, row int")
    got_ = source_mix.mix(odd, source_mix.word_count(F.col("text")), range_rows=4)
    assert got_.columns == odd.columns + list(source_mix.RESULT) and got_.count() == 41 and source_mix.mixed_rows(odd).columns == odd.columns
    assert got(got_, "n_rows", "taken") == got(source_mix.mix(odd.repartition(5), source_mix.word_count(F.col("text")), range_rows=4), "n_rows", "taken")


def test_licenses(spark, docs, real):
    for df in (docs, real):
        assert got(license_scan.license_scan(df), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(licenses(rows_of(df), license_scan.PHRASES), key=str)


def plain_blocks(text, name, template, containment=0.8, span=1.5):
    """Runs of overlapping windows that hold enough of a template's tokens, every window counted."""
    ws, tw = words(text), words(template)
    toks, width, out = set(tw), -int(-len(tw) * span // 1), []
    for i in range(len(ws)):
        at = [k for k in range(i, min(len(ws), i + width)) if ws[k] in toks]
        if len({ws[k] for k in at}) >= containment * len(toks) - 1e-9 and at[0] == i:
            # the shortest end at which the window that opens here has enough, and all later ones
            for k in at:
                n = len({ws[j] for j in at if j <= k})
                if n >= containment * len(toks) - 1e-9:
                    out.append((i, k + 1))
    runs = []
    for a, z in sorted(out):
        if runs and a < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], z))
        else:
            runs.append((a, z))
    L = license_scan
    told = lambda a, z: set(L.NEEDS.get(name, ())) <= {w.decode() for w in ws[a:z]} and not set(L.BARS.get(name, ())) & {w.decode() for w in ws[max(0, a - 3) : z + 3]}
    return {(name, a, z - 1) for a, z in runs if told(a, z)}


def test_license_blocks(spark, docs):
    rng = random.Random(9)
    T = license_scan.TEMPLATES
    wrap = lambda t, n: "\n".join(" ".join(w) for w in (t.split()[i : i + n] for i in range(0, len(t.split()), n)))
    rows = [(1, "x\nRELEASED under the MIT licence\nLicensed under the Apache License, Version 2.0"), (2, "under the the the"), (3, None), (4, "")]
    rows += [(10 + i, "intro words " * 20 + wrap(t, 7) + " and so on " * 30) for i, t in enumerate(T.values())]
    for i in range(40):  # words lost and put in, so that containment lies about the threshold
        t = rng.choice(list(T.values())).split()
        rows.append((100 + i, " ".join(w for x in t for w in ([x] if rng.random() < 0.85 else []) + (["filler"] if rng.random() < 0.3 else []))))
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], EMPTY + ", template string").repartition(3)
    found = {(r.doc_id, r.template, r.first_word, r.last_word) for r in license_scan.block_matches(df).collect()}
    want = {(d, *b) for d, t in rows for name, text in T.items() for b in plain_blocks(t, name, text)}
    assert found == want and len(want) > 30 and {n for d, n, _, _ in found if d < 100} == set(T)
    labels = {r.doc_id: r["labels"] for r in license_scan.license_scan(df).collect()}
    assert all({n for x, n, _, _ in want if x == d} <= set(labels[d].split(",")) for d, _ in rows) and labels[3] == labels[4] == ""
    assert license_scan.license_scan(df.limit(0)).count() == 0 and license_scan.block_matches(df.limit(0)).count() == 0


def test_simhash(spark, docs, real):
    for df in (docs, real):
        assert got(simhash_dedup.near_duplicates(df), "doc_id", "fingerprint", "component_id") == sorted(simhash(rows_of(df)), key=str)
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_keep_one(spark, docs):
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in simhash(rows_of(docs))}


def test_simhash_links_of_split_shards(spark):
    rng = random.Random(5)
    near = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({(n ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4)))) & ((1 << 64) - 1) for n in near for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for tree in (4000, 20, 4):
        assert {tuple(r) for r in simhash_dedup.links(df, 2, tree).collect()} == want


def test_toxicity(spark, sf):
    big = sf.replace("0.001", "0.01")
    out = Q.op9_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95 and held[held.toxic == 1].predicted.mean() > 0.6  # some labels have no cue
    none = toxicity.fit(spark.createDataFrame([], EMPTY), spark.createDataFrame([], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "you are an idiot", 0), (4, "I will kill you", 1), (5, "not an idiot", 1), (5, "not an idiot", 1)], EMPTY + ", score int")
    s = {r.doc_id: r.score for r in toxicity.score(odd, none).collect()}
    assert s[1] == s[2] < 0.5 < s[3]
    kept = toxicity.drop_toxic(odd, none)
    assert kept.columns == odd.columns and [(r.doc_id, r.score) for r in kept.orderBy("doc_id").collect()] == [(1, 0), (2, 1), (5, 1), (5, 1)]
    assert toxicity.drop_toxic(odd.limit(0), none).count() == 0 and toxicity.score(odd.limit(0), none).count() == 0


def test_grammar_contexts():
    lex, grammar = toxicity.Lexicon({"vej*": 1.0}), toxicity.Grammar(toxicity.BASE)
    at = lambda t: ["".join(sorted(o)) for c in lex.clauses(t, grammar) for o, _, _ in c]
    assert at("such an idiot") == [""] and at("you idiot") == ["t"] and at("idiot, you") == ["t"] and at("you say you are no idiot, you") == ["nrt"]
    assert at("not an idiot") == ["n"] and at("not here. idiot") == [""] and at("they said idiot") == ["rt"] and at("vejtion") == [""] and at("fine words") == []
    assert at("du idiot") == ["t"] and at("pas un idiot") == ["n"] and at("dijo idiot") == ["r"]


def test_clause_scores_are_weights_along_the_path():
    """Every clause's score against the weights of its words and contexts, multiplied out by hand."""
    model = toxicity.ToxicityModel({"vej*": 0.5}, {"t": 0.5, "n": -2.0, "r": -1.0}, toxicity.BASE_WEIGHTS)
    e = np.exp
    got_ = model.clause_scores("You vejtion! Fine words. He said: not an idiot; they said no moron, you vejer")
    want = [0.5 * e(0.5), e(-2.0), e(0.5 - 2.0 - 1.0) + 0.5 * e(0.5 - 2.0 - 1.0)]
    assert np.allclose(got_, want)
    f = toxicity.clause_features(model.lexicon.clauses("You vejtion! not an idiot", model.grammar))
    assert np.allclose(f, [max(want[:2]), np.log1p(sum(want[:2])), np.log(3), 1])


def test_html(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>a</li></ul></nav><div class="ad">buy</div><article><header><h1>Head &amp; x</h1></header><p><b>One<br>two<p>three &lt;\n 4</p><div class="comments"><p>me</p></div></article><footer>&copy; z</footer>'
    bare = "<body><p>shared one two three four five six seven eight nine ten eleven twelve</p><p>own {} text</p>"
    rows = [(1, "http://a/x", page), (2, "http://a/y", None), (3, "http://b/1", bare.format("q")), (4, "http://b/2", bare.format("r")), (5, "http://c/2", bare.format("r")), (6, None, "plain <b>text</b> <a hre")]
    out = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].text == "Head & x\nOne two\nthree < 4" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "" and out[3].text == "own q text" and out[4].text == "own r text" and "shared one" in out[5].text and out[6].text == "plain text"


def plain_pages(rows, least=12, share=0.3):
    """The shared-run rule, page by page, over what the parser reads."""
    H = html_extraction
    parsed = [(p, H.re.sub(r"^\w+://([^/]*).*", r"\1", u or ""), H.blocks(h or "")) for p, u, h in rows]
    on, of = {}, {}
    for p, host, bs in parsed:
        of[host] = of.get(host, 0) + 1
        for t, z in bs:
            ws = t.split(" ")
            for i in range(max(1, len(ws) - least + 1)):
                if z != H.ARTICLE:
                    on.setdefault((host, tuple(ws[i : i + least])), set()).add(p)
    out = {}
    for p, host, bs in parsed:
        named = any(z in (H.ARTICLE, H.SUSPECT) for _, z in bs)
        kept, most = [], []
        for t, z in bs:
            ws = t.split(" ")
            if z not in ((H.ARTICLE, H.SUSPECT) if named else (H.OUTSIDE, H.SUSPECT, H.SUSPECT_OUTSIDE)):
                continue
            gone, n_pages = set(), 1
            for i in range(max(1, len(ws) - least + 1)) if z != H.ARTICLE else ():
                n = len(on[host, tuple(ws[i : i + least])])
                n_pages = max(n_pages, n)
                enough = 2 if z != H.OUTSIDE else max(3, of[host] / 2) if len(ws) < least else max(2, share * of[host])
                gone |= set(range(i, min(i + least, len(ws)))) if n >= enough else set()
            kept.append(" ".join(w for i, w in enumerate(ws) if i not in gone))
            most.append((n_pages, t))
        if not any(kept) and not named:
            kept = [t for n, t in most if n == min(most)[0]]
        out[p] = "\n".join(k for k in kept if k)
    return out


def test_html_by_host_suffix_arrays(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randrange(6)) for _ in range(n))
    menu, terms, story, rows = "Home News Sport", say(30), [say(40), say(5)], []
    for i in range(24):
        host = "abc"[i % 3 > 0] + ".org" if i < 20 else "one.net"
        own = [say(rng.randrange(1, 40)) for _ in range(3)]
        body = story if i in (3, 6) else own + ([own[0][:20] + " " + terms] if i % 2 else [])
        mid = f'<main><p>{say(20)}</p><div class="share-price">{say(4)}</div><div class="share-it">{menu} and {terms}</div><p>{terms}</p></main>' if i % 5 == 0 else "".join(f"<p>{t}</p>" for t in body)
        rows.append((i, f"http://{host}/{i}", f'<div>{menu}</div><nav>{say(3)}</nav>{mid}<div class="site-footer">{terms}</div><p>{terms}</p>'))
    rows += [(30, "http://a.org/x", None), (31, "http://a.org/y", ""), (32, None, f"<p>{terms}")]
    df = spark.createDataFrame([(*r, 1, "h", "t") for r in rows], "page_id long, url string, html string, row int, host string, text string")
    want = plain_pages(rows)
    for parts in (1, 7):
        got_ = {r.page_id: r.text for r in html_extraction.extract(df.repartition(parts)).collect()}
        assert got_ == want
    assert story[0] in want[3] and story[0] in want[6] and terms not in want[1] and menu not in want[1] and terms in want[0] and len(want[0].split("\n")) > 2
    assert html_extraction.extract(df.limit(0)).count() == 0
    twice = html_extraction.extract(df.where("page_id < 3").unionByName(df.where("page_id = 1"))).where("page_id = 1").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_html_names():
    z = html_extraction._named
    assert [z(x) for x in ("comments", "site-nav top", "cookieBanner", "share-price table", "related-work", "post", "ad-slot-3", "shareholder")] == [2, 2, 2, 1, 1, 0, 2, 0]
    got_ = html_extraction.blocks('<main><p>a</p><article class="teaser">b</article><div id="related-work">c</div></main><p>d')
    assert [t for t, z in got_ if z == html_extraction.ARTICLE] == ["a"] and ("c", html_extraction.SUSPECT) in got_ and ("d", html_extraction.OUTSIDE) in got_


def test_piece_encoder_equals_the_tokenizer():
    import random

    rnd = random.Random(1)
    texts = ["", " ", "  ", " a", "a ", "a  b", "a\nb", "a\n", "a\n\n", "\n a", "a \n b", "x  y", "x  y", "<|endoftext|>", "a <|endoftext|> b", "it's  we'll 12 3", "a\x1cb c", "a\x1c c"]
    texts += ["".join(rnd.choice("ab1. \n'é　") for _ in range(rnd.randrange(40))) for _ in range(2000)]
    enc = token_output.PieceEncoder(token_output.tokenizer_path(), 0)
    for _ in range(2):  # the second time from the table of known pieces
        ids, counts = enc.encode(pa.array(texts))
        want = [enc.tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
