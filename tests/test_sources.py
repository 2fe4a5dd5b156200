"""Readers and writers of records on small files."""

import json

import pytest

from chronogaz.sources import records as R


def put(folder, name, value):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))


def schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def test_records_and_bad_files(spark, tmp_path):
    d = tmp_path / "r"
    put(d, "a.json", {"id": "a", "n": 1})
    put(d, "b.json", json.dumps({"id": "b", "n": 2, "extra": True}, indent=2))
    put(d, "c.json", '{"id": "c", ')
    good, bad = R.read_records(spark, str(d), schema(spark, "id string, n int"))
    assert sorted(map(tuple, good.collect())) == [("a", 1, "a.json"), ("b", 2, "b.json")]
    assert [r.path for r in bad.collect()] == ["c.json"]


def test_features_vertices_edges(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 0]]
    shapes = [("Polygon", [square]), ("MultiPolygon", [[square], [square, square]]), ("LineString", [[0, 0], [1, 1]]), ("Point", [3, 4])]
    put(tmp_path / "f", "x.geojson", {"type": "FeatureCollection", "features": [{"type": "Feature", "id": f"f{i}", "properties": {"k": "v"}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(shapes)]})
    f = R.read_features(spark, str(tmp_path / "f"))
    assert [(r.id, r.kind, len(r.rings), r.properties["k"]) for r in f.orderBy("at").collect()] == [("f0", "Polygon", 1, "v"), ("f1", "MultiPolygon", 3, "v"), ("f2", "LineString", 1, "v"), ("f3", "Point", 1, "v")]
    assert R.vertices(f).count() == 4 + 12 + 2 + 1
    assert [tuple(r)[2:] for r in R.edges(f).where("at = 2").collect()] == [(0, 0, 0.0, 0.0, 1.0, 1.0)]
    assert R.edges(f).count() == 3 + 9 + 1


def test_corpus_last_line_wins(spark, tmp_path):
    put(tmp_path / "c", "v.txt", "MAT 1:1 first\nnot a verse\nXXX 1:1 unknown\nMAT 1:2 next\nMAT 1:1 last\n")
    codes = spark.createDataFrame([("MAT", "Matthew")], "code string, book string")
    assert sorted(map(tuple, R.read_corpus(spark, str(tmp_path / "c"), codes).collect())) == [("Matthew", 1, 1, "last"), ("Matthew", 1, 2, "next")]


def test_lookup_and_sidecars(spark, tmp_path):
    put(tmp_path / "l", "x.jsonl", '{"slug":"a","n":1}\n{"slug":"a","n":2}\n{"n":3}\n')
    assert list(map(tuple, R.read_lookup(spark, str(tmp_path / "l"), schema(spark, "slug string, n int"), "slug").collect())) == [("a", 2)]
    put(tmp_path / "s", "one.json", {"id": "body", "cost": 1.5})
    put(tmp_path / "s", "two.json", {"cost": 2.5})
    rows = R.read_sidecars(spark, str(tmp_path / "s"), schema(spark, "id string, cost double"), "id")
    assert sorted(map(tuple, rows.select("id", "cost").collect())) == [("body", 1.5), ("two", 2.5)]


def test_optional_layers(spark, tmp_path):
    s, at = schema(spark, "id long"), str(tmp_path / "layer")
    assert R.optional_layer(spark, at, s).count() == 0
    spark.range(3).write.parquet(at)
    assert R.optional_layer(spark, at, s).count() == 3
    with pytest.raises(FileNotFoundError):
        R.optional_layer(spark, at, s, needs=str(tmp_path / "none"))


def test_sinks_round_trip(spark, tmp_path):
    parents = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "id long, name string")
    children = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (2, 1, None)], "id long, seq int, v string")
    whole = R.nested(parents, children, "id", "items", ["seq"])
    got = {r.id: [tuple(i) for i in r["items"]] for r in whole.collect()}
    assert got == {1: [(1, "x"), (2, "y")], 2: [(1, None)], 3: []}
    R.write_index(whole, str(tmp_path / "index"), "id", ["name"])
    assert [r.id for r in spark.read.schema("id long, name string").json(str(tmp_path / "index")).orderBy("id").collect()] == [1, 2, 3]
    R.write_payloads(whole, str(tmp_path / "pay"), "id")
    rows = {r.id: json.loads(r.payload) for r in spark.read.schema("id long, payload string").json(str(tmp_path / "pay")).collect()}
    assert rows[1]["items"][1]["v"] == "y" and rows[3]["items"] == []
    R.write_layers({"parents": parents, "children": children}, str(tmp_path / "layers"))
    assert spark.read.parquet(str(tmp_path / "layers/children")).count() == 3
